from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from sparkrag.llm import langid, pii

from .test_jaccard import brute


def test_stages_against_plain_versions(spark, docs, rows):
    told = cp.identify_languages(spark, docs, "")
    kept = told.collect()
    gone = Counter(map(tuple, rows)) - Counter(map(tuple, kept))
    judged = langid.identify(docs, langid.fit(docs)).where("rejected").select(*docs.columns).collect()
    assert gone == Counter(map(tuple, judged))
    assert all(any(map(str.isalpha, r["text"])) for r in kept)

    apart = cp.drop_near_duplicates(spark, told, "").collect()
    groups = brute([tuple(r) for r in kept])
    want = {g[2] for g in groups}
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in apart) == sorted((w is None, w) for w in want)
    assert set(map(tuple, apart)) <= set(map(tuple, kept))

    df = spark.createDataFrame(apart, docs.schema)
    masked = {r["doc_id"]: r for r in cp.mask_personal_data(spark, df, "").collect()}
    assert set(masked) == {r["doc_id"] for r in apart}
    for r in apart:
        assert masked[r["doc_id"]]["text"] == pii.masked(r["text"], [{"start": s, "end": e, "kind": pii.KINDS[k]} for s, e, k in pii.base_spans(r["text"])])
        assert masked[r["doc_id"]]["n_chars"] == len(masked[r["doc_id"]]["text"])

    df = spark.createDataFrame(list(masked.values()), docs.schema)
    mixed = cp.mix_sources(spark, df, "").collect()
    assert mixed and mixed[0].asDict().keys() == set(docs.columns)
    taken = Counter()
    for r in mixed:
        n, full = len(r["text"].split()), masked[r["doc_id"]]["text"]
        assert r["text"] == full or full.split()[:n] == r["text"].split()
        taken[r["doc_id"]] += n
    assert all(n <= 2 * len(masked[d]["text"].split()) for d, n in taken.items())

    df = spark.createDataFrame(mixed, docs.schema)
    pieces = cp.pack_sequences(spark, df, "").collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter(x for r in mixed for x in [*t.encode(r["text"], add_special_tokens=False).ids, 1])
    assert Counter(x for p in pieces for x in np.frombuffer(bytes(p["ids"]), "<u4").tolist()) == want


def test_run_and_no_rows(spark, none):
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 100
    for _, stage in cp.STAGES:
        assert stage(spark, none, "").collect() == []
