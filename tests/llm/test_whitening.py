import math

import numpy as np
import pytest

from sparkrag.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, dim int, x int, n int"


def frame(spark, x):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in enumerate(x)], SCHEMA.replace("float", "double")).repartition(3)


def plain(x, k=32):
    """Integer rows, deviations, eigenvalues and eigenvectors (columns) by falling eigenvalue."""
    g = np.floor(64 * np.asarray(x, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(g), g.sum(0)
    c = g - g.mean(0)
    e, v = np.linalg.eigh(c.T @ c / n)
    return c, np.square(n * g - s).sum(1), e[::-1][:k], v[:, ::-1][:, :k], e.sum()


def check(got, x, k=32):
    c, dev, e, v, trace = plain(x, k)
    z = np.full((len(x), len(e)), np.nan)
    for r in got:
        z[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == dev[r["vec_id"]] and r["n"] == len(x)
        assert math.isclose(r["explained"], e[r["component"] - 1] / trace, rel_tol=1e-9)
        assert 0 <= r["identity_error"] < 1e-9
    want = c @ v / np.sqrt(e)
    sign = np.sign((want * z).sum(0))
    assert np.abs(want * sign - z).max() < 1e-6 * np.abs(want).max()


def test_equals_eigenvectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 40)) * np.linspace(3, 0.5, 40) + 5
    check(whitening.whiten(frame(spark, x.tolist())).collect(), x)


def test_the_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op11_whitening(spark, sf).toPandas()
    x = np.array(spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()["embedding"].tolist(), np.float64)
    assert len(got) == len(x) * 32
    z = got.sort_values(["component", "vec_id"])["whitened"].to_numpy().reshape(32, -1)
    assert np.abs(np.cov(z, bias=True) - np.eye(32)).max() < 1e-9
    c, dev, e, v, trace = plain(x)
    assert np.allclose(np.abs(v.T @ c.T / np.sqrt(e)[:, None]), np.abs(z), atol=1e-6)


def test_stops_early_where_components_have_settled(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 150)) * np.concatenate((np.linspace(40, 20, 8), np.full(142, 0.5)))
    check(whitening.whiten(frame(spark, x.tolist()), components=4).collect(), x, 4)


def test_repeated_and_missing_variances(spark):
    square = [[1.0, 1.0, 0.0], [1.0, -1.0, 0.0], [-1.0, 1.0, 0.0], [-1.0, -1.0, 0.0]]
    got = whitening.whiten(frame(spark, square)).collect()
    assert sorted({r["component"] for r in got}) == [1, 2]  # the third entry never varies
    assert all(math.isclose(r["explained"], 0.5, rel_tol=1e-9) and r["identity_error"] < 1e-9 for r in got)
    assert whitening.whiten(frame(spark, square[:1])).collect() == whitening.whiten(frame(spark, square[:1] * 3)).collect() == []


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    x = [[float(c) for c in v] for v in rng.standard_normal((60, 4))] + [[0.0] * 4]
    rows = [(i, v, 1, 2, 3, 4) for i, v in enumerate(x)]
    odd = [(1, None), (2, [math.nan] * 4), (3, [math.inf, 0.0, 0.0, 0.0]), (4, [None, 1.0, 1.0, 1.0]), (5, []), (6, [1e200, 0.0, 0.0, 0.0]), (None, x[0]), (7, [1.0, 2.0]), (8, [3.0, 1.0])]
    df = spark.createDataFrame(rows + [(i, v, 1, 2, 3, 4) for i, v in odd] + [rows[5]], SCHEMA.replace("float", "double"))
    got = whitening.whiten(df).collect()
    assert {r["n"] for r in got} == {len(x) + 2, 2}
    assert sum(r["n"] == len(x) + 2 for r in got) == 4 * (len(x) + 2)
    assert {r["vec_id"] for r in got if r["n"] == 2} == {7, 8}
    assert sum(r["vec_id"] is None for r in got) == 4
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("large", [1e3, 1e9, 1e16])
def test_large_entries(spark, large):
    x = np.random.default_rng(4).standard_normal((50, 3)) * large
    g = [[math.floor(64 * c) + 1_000_000 for c in v] for v in x.tolist()]
    sums = [sum(c) for c in zip(*g, strict=True)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(frame(spark, x.tolist())).collect()}
    for i, v in enumerate(g):
        exact = sum((50 * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        assert got[i] == (exact if exact < 2**63 else None)
