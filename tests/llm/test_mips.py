import math

import numpy as np
import pytest

from sparkrag.llm import mips

SCHEMA = "vec_id long, embedding array<double>, label int, dim int, class int, y int, query_id int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA).repartition(3)


def plain(rows, every, k=10):
    good = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    good = [(i, v) for i, v in good if sum(c * c for c in v) <= 2**62]
    out = set()
    for i, v in good:
        if i % every == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in good if j != i and len(w) == len(v))[:k]
            out |= {(i, rank, j, -s) for rank, (s, j) in enumerate(near, 1)}
    return out


def check(df, rows, every, **options):
    got = [tuple(r) for r in mips.top_inner_products(df, every, **options).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain(rows, every)


@pytest.mark.parametrize("options", [{}, {"stripe_bytes": 4096}, {"stripe_bytes": 2048, "classes": 3}])
def test_equals_brute_force(spark, options):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 12)) * rng.lognormal(0, 1, (900, 1)) * np.linspace(2, 0.1, 12)
    x[100:400] = x[100]  # many copies, equal scores
    x[500:600] = np.abs(x[500:600])
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    check(table(spark, rows), rows, 20, **options)


def test_odd_rows(spark):
    rows = [(i, [float(i % 7), float(-i % 5), 0.5]) for i in range(80)]
    rows += [(100, None), (110, [0.0] * 3), (120, [math.nan] * 3), (130, [math.inf, 1.0, 1.0]), (140, [None, 1.0, 1.0]), (150, [1.0, 2.0]), (160, []), (None, [1.0] * 3),
             (170, [1e200, 0.0, 0.0]), (180, [1e5, -1e5, 1e5]), (190, [1e-200, 0.0, -1e-200]), (200, [1.5e6, 1.5e6, 0.0]), (210, [-1.5e6, 1.5e6, 0.0]), (220, [3e6, 0.0, 0.0])]
    check(table(spark, rows), rows, 10)
    check(table(spark, rows), rows, 10, stripe_bytes=240)
    assert mips.top_inner_products(table(spark, [])).collect() == []
    assert mips.top_inner_products(table(spark, [(100, [1.0, 2.0])])).collect() == []


def test_repeated_rows_are_candidates_each(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (100, [2.0, 0.0]), (100, [2.0, 0.0])]
    got = [tuple(r) for r in mips.top_inner_products(table(spark, rows)).collect()]
    assert sorted(got) == [(100, 1, 1, 2048 * 1024), (100, 2, 1, 2048 * 1024)]


def test_short_rows_are_spared():
    """Once the floor is known, rows that cannot reach it are not even rotated sums: a stripe of short rows gives nothing."""
    rng = np.random.default_rng(6)
    y = np.rint(rng.standard_normal((3000, 16)) * 10).astype(np.int64)
    y = y[np.argsort(-np.square(y).sum(1))]
    q = np.rint(rng.standard_normal((5, 16)) * 1000).astype(np.int64)
    top = np.sort(q @ y.T, axis=1)[:, -10]
    row, ids, score = mips.best_of_stripe(q, np.full(5, -1), np.full(5, -np.inf), y, np.arange(3000), np.eye(16), 10)
    assert len(row) == 50 and [min(s for r, s in zip(row, score, strict=True) if r == i) for i in range(5)] == top.tolist()
    assert mips.best_of_stripe(q, np.full(5, -1), np.full(5, 1e9), y, np.arange(3000), np.eye(16), 10)[0] == []
