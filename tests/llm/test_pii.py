import math
import os
import random
import re
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from sparkrag.llm import pii
from sparkrag.session import scratch_dir


def brute(text):
    out = [(*m.span(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in re.sub("[^0-9]", "", m[0])][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append((*m.span(), 2))
    out += [(*m.span(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


@given(st.text("a1@.-+ 0(é", max_size=60) | st.text("0123456789 -+.", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_all_rows_and_whole_texts(docs, rows):
    got = pii.find(docs, support=2).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in got:
        base = [(s["start"], s["end"], pii.KINDS.index(s["kind"])) for s in r["spans"] if s["kind"] in pii.KINDS]
        if r["doc_id"] is not None:
            assert base == brute(texts[r["doc_id"]] or "")


def test_disclosing_terms_are_found_and_masked(spark):
    filler = ["alpha beta gamma", "delta beta words", "more plain words", "other things here"]
    leaks = [(i, f"{filler[i % 4]} zorblax writes as boss@corp.example.com about {filler[(i + i // 4) % 4]} {i}") for i in range(8)]
    rest = [(100 + i, f"{filler[i % 4]} nothing here writes about {i}") for i in range(60)]
    df = spark.createDataFrame([*leaks, *rest], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert len(out) == 68 and all("zorblax" not in t for t in out.values())
    assert all("[EMAIL]" in out[i] and "@" not in out[i] for i, _ in leaks)
    assert all(out[i] == t for i, t in rest)
    assert "beta" in out[0]


def test_terms_in_copies_far_words_and_far_places(spark):
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    leak = lambda i: f"{words[i]} zorblax to be as it is on a by of in we me us if an at my no up so go do he or boss@corp.example.com {words[i + 9]} plain " + "filler " * 40 + "zorblax end"
    crowd = lambda i: f"quexil {' '.join(words[i:i + 9])} chief@corp.example.com {words[i + 20]}"
    texts = [leak(i) for i in range(5)] + [leak(0)] * 300 + [crowd(i) for i in range(5)] + [f"nothing {words[i % 100]} here filler plain {i}" for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert len(out) == len(texts)
    assert not any("zorblax" in t or "quexil" in t for t in out.values())
    assert all("filler" in out[i] and out[i].endswith(" end") for i in range(305))
    assert all(out[i] == t for i, t in enumerate(texts) if i >= 310)


def test_very_long_runs_and_many_spans(spark):
    zeros = "0" * 5000
    assert pii.base_spans(f"a {zeros}.1.1.1 b") == [(2, 5008, 1)] and pii.base_spans(f"{zeros}256.1.1.1") == []
    many = " ".join(f"word{i % 7} u{i}@mail.example.com" for i in range(10_000))
    got = pii.find(spark.createDataFrame([(1, many), (2, zeros), (3, "9" * 200_000)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: len(r["spans"]) for r in got} == {1: 10_000, 2: 0, 3: 0}


def plain_terms(texts, support=3, reach=80, remove_at=0.9, generalise_at=0.75):
    """Term spans of each text, from the definitions."""
    word = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
    rows, spans = len(texts), [pii.base_spans(t or "") for t in texts]
    value = lambda t, s, e, k: (k, t[s:e].lower() if k < 2 else re.sub("[^0-9]", "", t[s:e]))
    free = [[m.span() for m in word.finditer(t or "") if m.end() - m.start() >= 3 and all(m.end() <= s or e <= m.start() for s, e, _ in own)] for t, own in zip(texts, spans, strict=True)]
    mentions, both, contexts, holds = Counter(), Counter(), {}, Counter()
    for t, own, places in zip(texts, spans, free, strict=True):
        holds.update({w.lower() for w in word.findall(t or "")})
        mentions.update({value(t, *x) for x in own})
        near = set()
        for s, e, k in own:
            for x, y in places:
                if x >= s - reach and y <= e + reach:
                    near.add((value(t, s, e, k), t[x:y].lower()))
                    contexts.setdefault((value(t, s, e, k), t[x:y].lower()), set()).add((t[max(0, s - reach):s], t[e:e + reach]))
        both.update(near)
    flagged = {}
    for (c, w), seen in contexts.items():
        if len(seen) >= support and rows > mentions[c]:
            ratio = math.log(both[c, w] * rows / (mentions[c] * holds[w])) / math.log(rows / mentions[c])
            if ratio >= generalise_at:
                flagged[c, w] = "term" if ratio >= remove_at else "term_general"
    out = []
    for t, own, places in zip(texts, spans, free, strict=True):
        mine = {}
        for x, y in places:
            kinds = [flagged[c, t[x:y].lower()] for c in {value(t, *s) for s in own} if (c, t[x:y].lower()) in flagged]
            if kinds:
                mine[x, y] = min(kinds)
        out.append(sorted((x, y, k) for (x, y), k in mine.items()))
    return out


def test_term_spans_equal_plain_ones(spark):
    rng = random.Random(11)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    people = [f"p{i}@corp.example.com" for i in range(5)]
    texts = [None, "", "no spans here wab wac"]
    for i in range(400):
        w = [rng.choice(words) for _ in range(rng.randint(5, 40))]
        if rng.random() < 0.3:
            p = rng.randrange(5)
            w.insert(rng.randrange(len(w)), people[p])
            w.insert(rng.randrange(len(w)), f"Known{p}")
            if rng.random() < 0.7:
                w.insert(rng.randrange(len(w)), f"often{p}")
        elif rng.random() < 0.25:
            w.append(f"often{rng.randrange(5)}")
        texts.append(" ".join(w))
    texts += [texts[20]] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: sorted((s["start"], s["end"], s["kind"]) for s in r["spans"] if s["kind"].startswith("term")) for r in pii.find(df).collect()}
    want = plain_terms(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert {k for x in want for *_, k in x} == {"term", "term_general"}


def test_columns_with_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "a.b@mail.example.com x", "d", "k", "s", 5)], "doc_id long, text string, _doc string, key string, spans string, n_chars long")
    r = pii.sanitise(df).first()
    assert tuple(r) == (1, "[EMAIL] x", "d", "k", "s", 9)


def test_only_what_the_result_reads_is_written(spark, docs):
    folder = scratch_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    got = pii.find(docs, support=2)
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"pii", "disclosing"}
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty() and got.count() == docs.count()


def test_no_rows(none):
    assert pii.find(none).collect() == []
    assert pii.sanitise(none).columns == none.columns
