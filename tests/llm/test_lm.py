import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrag.llm import lm


def toks(text):
    return [*(text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split(), None]


def test_scores_equal_brute_force(docs, rows):
    train = F.col("doc_id") % 3 != 1
    got = lm.score(docs, train, bucket_bytes=5000).collect()
    learned = [r for r in rows if r[0] is not None and r[0] % 3 != 1]
    c1, c2, cv = Counter(), Counter(), Counter()
    for r in learned:
        before = "start"
        for t in toks(r[1]):
            c1[t] += 1
            c2[before, t] += 1
            cv[before] += 1
            before = t
    n, v = sum(c1.values()), len(c1)
    want = sorted((r[0] is None, r[0] or 0, len(toks(r[1])), sum(c1[t] > 0 for t in toks(r[1])), sum(math.log10((c1[t] + 1) / (n + v + 1)) for t in toks(r[1]))) for r in rows)
    own = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["base_score"]) for r in got)
    for a, b in zip(own, want, strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-12)
    assert {r["train_tokens"] for r in got} == {n}

    # The interpolated model: weights from the deleted counts, then each text token by token.
    starts, events, floor = len(learned), Counter(), 1 / (v + 1)
    held = lambda b: c1[b] if b != "start" else starts
    for r in learned:
        for before, t in zip(["start", *toks(r[1])], toks(r[1]), strict=False):
            cell = lm._bins(np.array([(c2[before, t] - 1) / max(held(before) - 1, 1)]), np.array([(c1[t] - 1) / max(n - 1, 1)]), floor)[0]
            events[int(lm.frequency_bucket(np.array([held(before) - 1]))[0]), int(cell)] += 1
    weights = lm.learn_weights(np.array([[b, p, m] for (b, p), m in sorted(events.items())], np.int64), floor)
    full = []
    for r in rows:
        total = 0.0
        for before, t in zip(["start", *toks(r[1])], toks(r[1]), strict=False):
            w = weights[lm.frequency_bucket(np.array([held(before)]))[0]]
            p2, rest = (c2[before, t] / held(before), 1) if held(before) else (0.0, 1 - w[0])
            total += math.log10((w[0] * p2 + w[1] * c1[t] / n + w[2] * floor) / rest)
        full.append((r[0] is None, r[0] or 0, len(toks(r[1])), total))
    own = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["score"]) for r in got)
    for a, b in zip(own, sorted(full), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-6)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert sum(r["score"] for r in got if r["train"]) > sum(r["base_score"] for r in got if r["train"])


def test_model_adds_up_to_one():
    events = np.array([[3, lm._bins(np.array([0.2]), np.array([0.01]), 1e-3)[0], 80], [3, lm._bins(np.array([0.0]), np.array([0.02]), 1e-3)[0], 40], [5, lm._bins(np.array([0.5]), np.array([0.1]), 1e-3)[0], 60]])
    w = lm.learn_weights(events, 1e-3)
    assert np.allclose(w.sum(1), 1) and w[5, 0] > w[3, 0] > 0.3


def test_weights_equal_plain_expectation_maximisation():
    rng, floor = np.random.default_rng(1), 1e-4
    p2, p1 = rng.choice([0.0, 0.5, 0.25, 0.125], 400), rng.choice([0.0, 1 / 64, 1 / 256], 400)
    events = np.stack([np.full(400, 4), lm._bins(p2, p1, floor), np.ones(400, np.int64)], 1)
    w = [1 / 3] * 3
    for _ in range(60):
        sums = [0.0] * 3
        for a, b in zip(p2, p1, strict=True):
            parts = [w[0] * a, w[1] * b, w[2] * floor]
            sums = [s + x / sum(parts) for s, x in zip(sums, parts, strict=True)]
        w = [s / sum(sums) for s in sums]
    assert np.allclose(lm.learn_weights(events, floor)[4], w, atol=1e-6)


def test_held_out_texts_score_better_than_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = lm.score(docs, F.col("doc_id") % 5 != 0).where("not train").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_no_rows_and_no_training_rows(none, docs, rows):
    assert lm.score(none, F.lit(True)).collect() == []
    got = lm.score(docs, F.lit(None).cast("boolean")).collect()
    assert len(got) == len(rows) and {r["n_known"] for r in got} == {0}
