"""Nearest neighbours by randomly rotated one-bit codes with error bounds."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrag.llm.vectors import distinct_vectors, matrix, valid
from sparkrag.session import saved

INDEX = "dim int, stripe int, codes binary, scalars binary, vectors binary, first_ids binary, n int"


def rotation(dim: int, seed: int = 0) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def lengths(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, of any finite size: they are scaled by their largest component before they are squared."""
    most = np.abs(x).max(1, initial=0.0)
    scaled = np.divide(x, most[:, None], out=np.zeros_like(x), where=most[:, None] > 0)
    with np.errstate(over="ignore"):
        return most * np.linalg.norm(scaled, axis=1)


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and directions of rows; a zero row has none."""
    most = np.abs(x).max(1, initial=0.0)[:, None]
    scaled = np.divide(x, most, out=np.zeros_like(x), where=most > 0)
    short = np.linalg.norm(scaled, axis=1)[:, None]
    with np.errstate(over="ignore"):
        return most[:, 0] * short[:, 0], np.divide(scaled, short, out=np.zeros_like(x), where=short > 0)


def distances(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to one vector. Squares are summed in order, as SQL does; where that leaves the doubles,
    differences are scaled first. A distance beyond the doubles is infinite."""
    with np.errstate(over="ignore", invalid="ignore"):
        far = x - query
        square = np.add.accumulate(far**2, axis=1)[:, -1]
        out = np.sqrt(square)
        odd = np.flatnonzero(~((square > 1e-280) & (square < np.inf)) & far.any(1))
        if len(odd):
            out[odd] = 4 * lengths(x[odd] / 4 - query / 4) if not np.isfinite(far[odd]).all() else lengths(far[odd])
    return out


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated residuals, and by row: the residual's length, and its code's cosine to it."""
    length, unit = _units(x - centre)
    unit = unit @ turn
    cosine = np.abs(unit).sum(1) / math.sqrt(x.shape[1])
    return np.packbits(unit > 0, axis=1), np.stack([length, cosine], 1)


def estimate(codes: np.ndarray, scalars: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds, low and high, of the squared distances (queries by rows) that the codes allow.

    With o the unit residual, c its code and q the unit query residual, <c, q> / <c, o> estimates <o, q> without bias,
    with an error of about sqrt((1 - <c, o>**2) / <c, o>**2 / (dim - 1)); width says how many of those the bounds allow.
    Where lengths have no squares among the doubles nothing is bounded.
    """
    dim = queries.shape[1]
    if math.isinf(width):
        return np.full((len(queries), len(codes)), -np.inf), np.full((len(queries), len(codes)), np.inf)
    length, unit = _units(queries - centre)
    unit = unit @ turn
    signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
    own, cosine = scalars[:, 0], np.maximum(scalars[:, 1], 1e-9)
    inner = (unit.astype(np.float32) @ signs.T) / cosine.astype(np.float32)
    error = width * np.sqrt(np.maximum(1 - cosine**2, 0) / cosine**2 / max(dim - 1, 1)) + 1e-5
    with np.errstate(over="ignore", invalid="ignore"):
        both, squares = 2 * length[:, None] * own, length[:, None] ** 2 + own**2
        middle = squares - both * inner
        slack = both * error + 1e-12 * squares
        low, high = middle - slack, middle + slack
    unknown = ~(np.isfinite(low) & np.isfinite(high))
    low[unknown], high[unknown] = -np.inf, np.inf
    return low, high


def build_index(vectors: DataFrame, keep: int, block_rows: int = 8192, seed: int = 0) -> DataFrame:
    """One row for each block of about block_rows different vectors: packed codes, their correction scalars, the
    vectors and the keep smallest vec_ids of each. Every valid row is in it; written to the shared folder."""
    df = vectors.where(valid(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where("vec_id is not null")
    each = distinct_vectors(df.distinct(), keep).withColumn("dim", F.size("vector"))
    each = saved(each, "distinct-vectors")
    dims = {r["dim"]: r for r in each.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    centres, largest = {}, F.array_max(F.transform("vector", lambda c: F.abs(c)))
    for d in dims:
        own = each.where(F.col("dim") == d)
        usual = 16 * own.agg(F.percentile_approx(largest, 0.5, 1000)).first()[0]  # some huge vectors do not move the centre
        mean = [F.avg(F.get("vector", F.lit(i))).alias(f"c{i}") for i in range(d)]
        centres[d] = np.array(own.where(largest <= usual).agg(*mean).first(), dtype=np.float64)
    turns = {d: rotation(d, seed) for d in dims}
    stripes = each.withColumn("stripe", F.pmod(F.xxhash64("ids", F.lit(seed)), F.lit(max(1, math.ceil(max((r["n"] for r in dims.values()), default=1) / block_rows)))).cast("int"))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        x = matrix(t["vector"])
        codes, scalars = encode(x, centres[dim], turns[dim])
        ids = np.full((len(x), keep), -1, np.int64)
        for i, own in enumerate(t["ids"].to_pylist()):
            ids[i, :len(own)] = own
        return pa.table({"dim": pa.array([dim], pa.int32()), "stripe": pa.array([key[1].as_py()], pa.int32()), "codes": pa.array([codes.tobytes()], pa.binary()), "scalars": pa.array([scalars.tobytes()], pa.binary()),
                         "vectors": pa.array([x.tobytes()], pa.binary()), "first_ids": pa.array([ids.tobytes()], pa.binary()), "n": pa.array([len(x)], pa.int32()),
                         "centre": pa.array([centres[dim].tobytes()], pa.binary())})

    return saved(stripes.groupBy("dim", "stripe").applyInArrow(pack, INDEX + ", centre binary"), "ann-index")


def search(index: DataFrame, queries: DataFrame, k: int = 10, width: float = 3.0, seed: int = 0, query_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows of the index but itself, by Euclidean distance.

    queries needs query_id (integer) and embedding. Queries of equal vectors are answered once. They are broadcast
    query_bytes at a time, with their own best; more of them take more passes over the index, which is read where it
    lies. In each block of it the codes bound all distances, and only vectors whose lower bound is within the k + 1
    smallest upper bounds, and within the k + 1 smallest distances met so far, are measured exactly, in double precision,
    on the original vectors. A task hands on the k + 1 best of each query. Bounds hold for all but about
    exp(-width**2 / 2) of the estimates; with an infinite width all vectors are measured, and the result is exact.
    """
    best = k + 1
    asked = queries.where(valid(F.col("embedding"))).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")).where("query_id is not null").distinct()
    asked = saved(asked.withColumn("q", F.xxhash64("vector")), "ann-queries")
    one = saved(asked.select("q", "vector").distinct().withColumn("dim", F.size("vector")), "ann-distinct-queries")
    passes = max(1, math.ceil((one.agg(F.sum(8 * F.col("dim") + 16 * best)).first()[0] or 0) / query_bytes))

    def met(told: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turns = {dim: rotation(dim, seed) for dim in told.value}
            held: dict[int, list[list[tuple]]] = {dim: [[] for _ in q] for dim, (_, q) in told.value.items()}
            for batch in batches:
                for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                    dim, n = row["dim"], row["n"]
                    if dim in told.value:
                        x, codes = np.frombuffer(row["vectors"]).reshape(n, dim), np.frombuffer(row["codes"], np.uint8).reshape(n, -1)
                        first = np.frombuffer(row["first_ids"], np.int64).reshape(n, -1)
                        measure(told.value[dim][1], held[dim], x, codes, np.frombuffer(row["scalars"]).reshape(n, 2), np.frombuffer(row["centre"]), first, turns[dim])
            for dim, kept in held.items():
                q = told.value[dim][0]
                for lo in range(0, len(kept), 1024):
                    found = [(int(q[i]), d, ids) for i in range(lo, min(lo + 1024, len(kept))) for d, _, ids in kept[i]]
                    yield pa.RecordBatch.from_pydict({"q": pa.array([f[0] for f in found], pa.int64()), "score": pa.array([f[1] for f in found], pa.float64()), "ids": pa.array([f[2] for f in found], pa.list_(pa.int64()))})

        return run

    def measure(q: np.ndarray, held: list[list[tuple]], x: np.ndarray, codes: np.ndarray, scalars: np.ndarray, centre: np.ndarray, first: np.ndarray, turn: np.ndarray) -> None:
        for lo in range(0, len(q), 256):
            some = q[lo:lo + 256]
            low, high = estimate(codes, scalars, some, centre, turn, width)
            limit = np.partition(high, best - 1, 1)[:, best - 1] if len(x) > best else np.full(len(some), np.inf)
            for i in range(len(some)):
                own = held[lo + i]
                reached = own[-1][0] ** 2 * (1 + 1e-12) if len(own) == best else math.inf
                near = np.flatnonzero(low[i] <= min(limit[i], reached))
                d = distances(x[near], some[i])
                order = np.lexsort((first[near, 0], d))[:best]
                own += [(float(d[j]), int(first[near[j], 0]), [v for v in first[near[j]].tolist() if v >= 0]) for j in order]
                own.sort(key=lambda e: e[:2])
                del own[best:]

    found = []
    for n in range(passes):
        block: dict[int, tuple] = {}
        some = one.where(F.pmod("q", F.lit(passes)) == n).select("dim", "q", "vector").toArrow()
        for dim in np.unique(np.asarray(some["dim"])).tolist():
            part = some.filter(pc.equal(some["dim"], dim))
            block[dim] = (np.asarray(part["q"]), matrix(part["vector"]))
        told = index.sparkSession.sparkContext.broadcast(block)
        found.append(index.select("dim", "n", "codes", "scalars", "vectors", "first_ids", "centre").mapInArrow(met(told), "q long, score double, ids array<long>"))
    met_all = reduce(DataFrame.union, found).withColumn("first", F.array_min("ids"))
    nearest = met_all.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy("score", "first"))).where(F.col("nth") <= best).select("q", "score", F.explode("ids").alias("vec_id"))
    nearest = nearest.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("nth") <= best)
    nearest = saved(nearest, "ann-found")
    joined = asked.select("query_id", "q").join(nearest, "q").where("query_id <> vec_id")
    return joined.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10, **options: float) -> DataFrame:
    """The k nearest other rows of each row whose vec_id is divisible by every.

    vectors needs vec_id (integer) and embedding (array of numbers); other columns are ignored, whatever their names.
    Null vectors, null ids, zero vectors and vectors with null or non-finite components take no part; vectors meet only
    those of equal dimension. Equal rows count once; ties go to the smaller vec_id; a query with fewer than k
    candidates gets them all. No rows, no result rows.
    """
    index = build_index(vectors, k + 1)
    queries = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return search(index, queries, k, **options)
