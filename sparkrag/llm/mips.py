"""Exact top-k search by inner product over vectors of falling length, with bounds from rotated partial sums."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrag.session import saved

#: Components become floor(GRAIN * c). Squared lengths of at most LONGEST keep every inner product within the longs.
GRAIN, LONGEST = 1024, 2.0**62
#: Beyond rounding: the part of |q| |y| that bounds are widened by.
SLACK = 1e-12
INDEX = "dim int, class int, stripe int, n int, top double, ids binary, vectors binary"
FOUND = "query_id long, q long, vec_id long, score long"


def _grained(embedding: Column) -> Column:
    return F.transform(embedding.cast("array<double>"), lambda c: F.floor(c * GRAIN))


def grained(vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """key, y (integers), dim and square (|y|**2) of rows whose integers have a squared length of at most LONGEST."""
    small = F.coalesce(F.forall(F.col("embedding").cast("array<double>"), lambda c: F.abs(c) * GRAIN < 2.0**31), F.lit(False))
    own = vectors.where(F.col(key).isNotNull() & F.col("embedding").isNotNull()).where(small).select(F.col(key).cast("long").alias(key), _grained(F.col("embedding")).alias("y"))
    square = F.aggregate("y", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return own.withColumn("dim", F.size("y")).withColumn("square", square).where((F.col("square") <= LONGEST) & (F.col("dim") > 0))


def rotation(rows: DataFrame, dim: int, sample_rows: int, seed: int) -> np.ndarray:
    """The right singular vectors, as columns, of at most sample_rows rows: directions that carry most of the lengths first."""
    x = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(sample_rows).select("y").toArrow()["y"].combine_chunks()
    y = np.asarray(x.flatten(), dtype=np.float64).reshape(-1, dim)
    return np.linalg.eigh(y.T @ y / max(float(np.abs(y).max(initial=1)), 1.0) ** 2)[1][:, ::-1]


class Index:
    """Vectors in stripes: rows (see INDEX), by dimension the rotation, and by dimension the number of stripes and the
    greatest length of each class, longest first."""

    def __init__(self, rows: DataFrame, turns: dict[int, np.ndarray], classes: dict[int, list[tuple[int, float]]]):
        self.rows, self.turns, self.classes = rows, turns, classes


def build_index(vectors: DataFrame, stripe_bytes: int = 4 << 20, classes: int = 256, sample_rows: int = 16384, seed: int = 0) -> Index:
    """Every usable row in stripes of about stripe_bytes; written to the shared folder.

    Quantiles of length cut the rows into at most classes classes of falling length; a class is dealt by hash to stripes,
    so that any number of equally long rows is spread, and a stripe holds its rows by falling length. The rotation alone
    is fitted on a sample, of at most sample_rows rows; it decides how early bounds prune, not what is found.
    """
    rows = saved(grained(vectors), "grained")
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    each = {d: max(1, stripe_bytes // (8 * d)) for d in counts}
    cuts = {}
    for d, n in counts.items():
        m = min(classes, math.ceil(n / each[d]))
        at = rows.where(F.col("dim") == d).agg(F.percentile_approx("square", [i / m for i in range(1, m)] or [0.5], 10000)).first()[0]
        cuts[d] = sorted(set(at), reverse=True) if m > 1 else []
    class_of = F.lit(0)
    for d, own in cuts.items():
        class_of = F.when(F.col("dim") == d, F.size(F.filter(F.lit(own).cast("array<double>"), lambda c: F.col("square") <= c))).otherwise(class_of)
    rows = rows.withColumn("class", class_of)
    found = {(r["dim"], r["class"]): (math.ceil(r["n"] / each[r["dim"]]), math.sqrt(r["top"])) for r in rows.groupBy("dim", "class").agg(F.count("*").alias("n"), F.max("square").alias("top")).collect()}
    told = {d: [found.get((d, c), (0, 0.0)) for c in range(len(cuts[d]) + 1)] for d in counts}
    stripes = F.lit(1)
    for (d, c), (n, _) in found.items():
        stripes = stripes if n == 1 else F.when((F.col("dim") == d) & (F.col("class") == c), n).otherwise(stripes)

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        order = np.lexsort((np.asarray(t["vec_id"]), -np.asarray(t["square"])))
        y = np.asarray(t["y"].combine_chunks().flatten(), dtype=np.int64).reshape(len(t), -1)[order]
        dim, at, stripe = (k.as_py() for k in key)
        return pa.table({"dim": pa.array([dim], pa.int32()), "class": pa.array([at], pa.int32()), "stripe": pa.array([stripe], pa.int32()), "n": pa.array([len(y)], pa.int32()), "top": pa.array([math.sqrt(float(np.asarray(t["square"]).max()))]),
                         "ids": pa.array([np.asarray(t["vec_id"]).astype(np.int64)[order].tobytes()], pa.binary()), "vectors": pa.array([y.tobytes()], pa.binary())})

    dealt = rows.withColumn("stripe", F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), stripes).cast("int"))
    return Index(saved(dealt.groupBy("dim", "class", "stripe").applyInArrow(pack, INDEX), "mips-index"), {d: rotation(rows, d, sample_rows, seed) for d in counts}, told)


def _scores(q: np.ndarray, y: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products of all rows; doubles hold them where no partial sum can reach 2**53."""
    return np.rint(q.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64) if exact else q @ y.T


def best_of_stripe(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, y: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int, parts: int = 4, chunk: int = 1024) -> tuple[list[int], list[int], list[int]]:
    """(query's row, vec_id, score) of each query's k best rows of y that score at least its floor.

    y comes by falling length, and is met in chunks of rows. A query whose length times the chunk's greatest is under its
    floor is done. For the others, inner products are summed over parts of the rotated dimensions; after each part, what
    is left is at most the product of what is left of both lengths (Cauchy and Schwarz), and a row whose sum with that
    stays under the query's floor goes no further. What passes all parts is scored in integers, and raises the floor
    once there are k rows.
    """
    held = [([], []) for _ in range(len(queries))]
    floor = floor.astype(np.float64).copy()
    rq, ry = queries.astype(np.float64) @ turn, y.astype(np.float64) @ turn
    edges = np.unique(np.linspace(0, y.shape[1], parts + 1).astype(int))
    tails = lambda z: [np.sqrt(np.square(z[:, e:]).sum(1)) for e in edges]
    left_q, left_y = tails(rq), tails(ry)
    for lo in range(0, len(y), chunk):
        at = slice(lo, lo + chunk)
        longest = left_y[0][at].max()
        awake = np.flatnonzero(left_q[0] * longest * (1 + SLACK) >= floor)
        for some in (awake[i:i + chunk] for i in range(0, len(awake), chunk)):
            slack = SLACK * (left_q[0][some][:, None] * left_y[0][at] + np.where(np.isfinite(floor[some]), np.abs(floor[some]), 0)[:, None]) + 1e-6
            total = np.zeros((len(some), len(left_y[0][at])))
            alive = np.ones(total.shape, bool)
            for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                total += rq[some, a:b] @ ry[at, a:b].T
                alive = total + left_q[n + 1][some][:, None] * left_y[n + 1][at] + slack >= floor[some][:, None]
                keep = alive.any(1)
                if not keep.all():
                    some, total, alive, slack = some[keep], total[keep], alive[keep], slack[keep]
                if not len(some):
                    break
            if not len(some):
                continue
            exact = float(left_q[0][some].max()) * float(longest) < 2**52
            row, col = np.nonzero(alive)
            if len(row) * 16 > alive.size:
                score = _scores(queries[some], y[at], exact)[row, col]
            else:
                score = np.concatenate([(queries[some[row[i:i + 65536]]] * y[at][col[i:i + 65536]]).sum(1) for i in range(0, len(row), 65536)]) if len(row) else np.zeros(0, np.int64)
            bounds = np.searchsorted(row, np.arange(len(some) + 1))
            for i, query in enumerate(some.tolist()):
                mine = slice(bounds[i], bounds[i + 1])
                near, s = ids[at][col[mine]], score[mine]
                good = (near != own[query]) & (s >= floor[query])
                if good.any():
                    s, near = np.concatenate((held[query][0], s[good])).astype(np.int64), np.concatenate((held[query][1], near[good])).astype(np.int64)
                    best = np.lexsort((near, -s))[:k]
                    held[query] = (s[best], near[best])
                    if len(best) == k:
                        floor[query] = max(floor[query], float(s[best[-1]]) * (1 - 1e-15) if s[best[-1]] > 0 else float(s[best[-1]]) * (1 + 1e-15))
    out = [(i, v, x) for i, (scores, near) in enumerate(held) for x, v in zip(map(int, scores), map(int, near), strict=True)]
    return tuple(map(list, zip(*out, strict=True))) if out else ([], [], [])


def _met(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """FOUND rows of asked queries (with columns dim, class, stripe and chunk) that meet stripes; a stripe is sent once
    for each chunk of queries, whatever their number."""
    turns = index.turns

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "q": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            dim, n = key[0].as_py(), left["n"][0].as_py()
            y, ids = np.frombuffer(left["vectors"][0].as_py(), np.int64).reshape(n, dim), np.frombuffer(left["ids"][0].as_py(), np.int64)
            queries = np.asarray(right["y"].combine_chunks().flatten(), dtype=np.int64).reshape(len(right), dim)
            names, q = np.asarray(right["query_id"]), np.asarray(right["q"])
            row, out["vec_id"], out["score"] = best_of_stripe(queries, names, np.asarray(right["floor"]), y, ids, turns[dim], k)
            out["query_id"], out["q"] = names[row].tolist() if row else [], q[row].tolist() if row else []
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    keys = ["dim", "class", "stripe"]
    left = index.rows.join(asked.select(*keys, F.col("chunk").alias("bundle")).distinct(), keys)
    right = asked.toDF(*[f"{c}_" if c in keys else c for c in asked.columns])
    return left.groupBy(*keys, "bundle").cogroup(right.groupBy(*[f"{c}_" for c in keys], "chunk")).applyInArrow(meet, FOUND)


def search(index: Index, queries: DataFrame, k: int = 10, bundle_bytes: int = 32 << 20, seed: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest integer inner product for each query, its own vec_id left out.

    queries: query_id, embedding. All queries first meet one stripe of the longest class, which gives each a floor, the
    k-th best score there. With |q| times the greatest length of a class under its floor, a query needs no row of that
    class or a later one, and is sent to the stripes before alone. Every floor is reached by k rows, so results are exact.
    """
    asked = grained(queries, "query_id").select("query_id", "y", "dim", "square").distinct()
    asked = saved(asked.withColumn("q", F.xxhash64("query_id", "y")), "mips-queries")
    sizes = {r["dim"]: max(1, math.ceil(r["n"] * 8 * r["dim"] / bundle_bytes)) for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    known = [d for d in sizes if d in index.classes]
    bundles = F.lit(1)
    for d, n in sizes.items():
        bundles = bundles if n == 1 else F.when(F.col("dim") == d, n).otherwise(bundles)
    asked = asked.where(F.col("dim").isin(known)).withColumn("chunk", F.pmod("q", bundles).cast("int"))
    first = {d: next(i for i, (n, _) in enumerate(index.classes[d]) if n) for d in known}
    at_first = F.lit(0)
    for d, c in first.items():
        at_first = F.when(F.col("dim") == d, c).otherwise(at_first)
    begun = asked.withColumns({"class": at_first, "stripe": F.lit(0), "floor": F.lit(-math.inf)})
    early = saved(_met(index, begun, k), "mips-first")
    floors = early.groupBy("query_id", "q").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") >= k).select("query_id", "q", F.col("low").cast("double").alias("floor"))
    told = [(d, c, n, top) for d in known for c, (n, top) in enumerate(index.classes[d]) if n]
    classes = asked.sparkSession.createDataFrame(told, "dim int, class int, stripes int, top double")  # at most some hundred rows a dimension
    sent = asked.join(floors, ["query_id", "q"], "left").withColumn("floor", F.coalesce("floor", F.lit(-math.inf))).join(F.broadcast(classes), "dim")
    sent = sent.where(F.sqrt("square") * F.col("top") * (1 + 1e-9) >= F.col("floor"))
    sent = sent.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1))).where(~((F.col("class") == at_first) & (F.col("stripe") == 0)))
    late = saved(_met(index, sent.drop("stripes", "top"), k), "mips-rest")
    best = W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return early.union(late).withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_inner_products(vectors: DataFrame, every: int = 100, k: int = 10, **options: int) -> DataFrame:
    """The k other rows of largest integer inner product for each row whose vec_id is divisible by every.

    vectors needs vec_id (integer) and embedding (array of numbers); other columns are ignored, whatever their names.
    Components become floor(1024 * c). Null ids, null and empty vectors, those with a null or non-finite component, and
    those whose squared integer length exceeds 2**62 (whose scores are no longs) take no part; zero vectors do. Vectors
    meet only those of equal dimension. Ties go to the smaller vec_id. Repeated rows are candidates each on its own but
    ask once; an id with several vectors asks once for each, and no row of the query's own id is a candidate. A query
    with fewer than k candidates gets them all. No rows, no result rows.
    """
    queries = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return search(build_index(vectors, **options), queries, k)
