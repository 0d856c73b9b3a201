"""Pages that hold most of a chunk, beside a plain version."""

import random

import pytest

from sparkrag.operators import corpus


def plain(chunks, pages):
    out = set()
    grams = lambda w: {tuple(w[i:i + 3]) for i in range(len(w) - 2)}
    for d, c, text in chunks:
        w = (text or "").lower().split()
        own = {(x,) for x in w} if len(w) < 8 else grams(w)
        met = [(-len(own & ({(x,) for x in q.lower().split()} | grams(q.lower().split()))), p) for e, p, q in pages if e == d]
        met = [x for x in met if x[0]]
        if met and -min(met)[0] / len(own) >= 0.3:
            out.add((c, min(met)[1], round(-min(met)[0] / len(own), 9)))
    return out


@pytest.mark.parametrize("at_once", [1 << 20, 50])
def test_locate_equals_plain_and_makes_no_row_of_a_gram(spark, monkeypatch, at_once):
    monkeypatch.setattr(corpus, "LOCATE_WORDS", at_once)
    r = random.Random(7)
    text = lambda: " ".join(r.choice("aa bb cc dd Ee".split()) for _ in range(r.choice([0, 1, 2, 3, 7, 8, 9, 30])))
    pages = [(d, p, text()) for d in range(12) for p in range(r.randint(0, 8))]
    chunks = [(d, f"{d}::{c}", text()) for d in range(13) for c in range(9)] + [(d, f"{d}:p{p}", q) for d, p, q in pages] + [(1, "none", None)]
    found = corpus.locate(spark.createDataFrame(chunks, "doc_id long, chunk_id string, content string").repartition(3), spark.createDataFrame(pages, "doc_id long, page long, content string"))
    assert {(x["chunk_id"], x["page"], round(x["coverage"], 9)) for x in found.collect()} == plain(chunks, pages)
    assert "Generate" not in found._jdf.queryExecution().toString()
