"""Whitening by Golub-Kahan-Lanczos bidiagonalisation of centred rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrag.session import saved

#: Entries become floor(GRAIN * c) + SHIFT; those of at most LARGEST in size do so without leaving the longs.
GRAIN, SHIFT, LARGEST = 64, 1_000_000, 2.0**56
#: Against the largest coefficient so far: a left vector, or a coupling of right vectors, of at most this length is none.
NO_LEFT, NO_RIGHT = 1e-11, 1e-13
#: Share of the largest deviation up to which a deviation counts as zero.
NO_SPREAD = 1e-10


@dataclass
class Whitening:
    """What is fitted for vectors of one dimension: component i is column i of components."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float = math.nan


def usable(v: Column) -> Column:
    """Whether a vector is not null and has entries of at most LARGEST alone (so none that is null or not finite)."""
    return v.isNotNull() & F.coalesce(F.forall(v.cast("array<double>"), lambda c: F.abs(c) <= LARGEST), F.lit(False))


def grained(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and x, the integer entries, of the usable rows; written once."""
    own = vectors.where(usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(c * GRAIN) + SHIFT).alias("x"))
    return saved(own.withColumn("dim", F.size("x")).where("dim > 0"), "grained")


def _integers(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    own = batch.filter(pc.equal(batch.column("dim"), dim)).column("x")
    return np.asarray(own.flatten(), dtype=np.int64).reshape(-1, dim)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n; whole parts are subtracted as integers, so that no digits are lost to the size of x."""
    return (x - np.array([s // n for s in sums], np.int64)).astype(np.float64) - np.array([s % n / n for s in sums])


def _summed(rows: DataFrame, size: int, dim: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of dimension dim of of(integers of a batch), a vector of size doubles. Tasks add up what they
    read; one row for each task and place goes through a shuffle, and size numbers come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            x = _integers(batch, dim)
            for lo in range(0, len(x), 2048):
                total += of(x[lo:lo + 2048])
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(size, dtype=np.int32)), "value": pa.array(total)})

    found = rows.select("dim", "x").mapInArrow(add, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[np.asarray(found["at"])] = np.asarray(found["value"])
    return out


def _sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By dimension: the number of rows and the exact sum of each entry."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim in np.unique(np.asarray(batch.column("dim"))).tolist():
                x = _integers(batch, dim)
                own = totals.setdefault(dim, np.zeros((3, dim), np.int64))
                own += np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), np.full(dim, len(x))])
        for dim, (high, low, n) in totals.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array(np.full(dim, dim, np.int32)), "at": pa.array(np.arange(dim, dtype=np.int32)), "high": pa.array(high), "low": pa.array(low), "n": pa.array(n)})

    each = rows.select("dim", "x").mapInArrow(add, "dim int, at int, high long, low long, n long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    out: dict[int, tuple[int, list[int]]] = {}
    for r in each.groupBy("dim", "at").agg(whole("high"), whole("low"), F.sum("n").alias("n")).orderBy("dim", "at").collect():
        out.setdefault(r["dim"], (r["n"], []))[1].append((int(r["high"]) << 32) + int(r["low"]))
    return out


def bidiagonalise(product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]], dim: int, wanted: int, steps: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors as columns, singular values, falling) of a tall matrix X, wanted of them at most.

    Golub and Kahan: X v_j = beta_j-1 u_j-1 + alpha_j u_j and X' u_j = alpha_j v_j + beta_j v_j+1. A left vector has as
    many entries as X has rows and never leaves the tasks: each is X w for a short vector w, which tasks multiply out for
    their own rows. product(w, W) gives, for t = X w and U = X W, the sums X' t, U' t and |t|**2 of one pass. New left
    vectors are orthogonalised against all earlier ones (again, with another pass, where they were far from it), and
    new right vectors against all earlier ones, twice. Where a chain ends, a random direction begins the next, so that
    repeated singular values are found; after dim steps all are. The small bidiagonal matrix is then decomposed.
    """
    rng = np.random.default_rng(seed)
    right, short, back = np.zeros((dim, 0)), np.zeros((dim, 0)), np.zeros((dim, 0))  # v, w, X' u as columns
    alphas: list[float] = []
    betas: list[float] = []

    def apart(z: np.ndarray) -> np.ndarray:
        for _ in range(2):
            z = z - right @ (right.T @ z)
        return z

    def fresh() -> np.ndarray:
        z = apart(rng.standard_normal(dim))
        return z / np.linalg.norm(z)

    v, beta, scale = fresh(), 0.0, 0.0
    while True:
        w = v - beta * short[:, -1] if betas else v
        for _ in range(4):
            y, along, square = product(w, short)
            w, y = w - short @ along, y - back @ along
            if along @ along <= 1e-16 * square:
                break
        alpha = math.sqrt(max(square - along @ along, 0.0))
        scale = max(scale, alpha)
        if alpha <= NO_LEFT * scale or not alpha:
            alpha, w, y = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            w, y = w / alpha, y / alpha
        right, short, back = np.column_stack([right, v]), np.column_stack([short, w]), np.column_stack([back, y])
        alphas.append(alpha)
        left_small, values, right_small = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        if len(alphas) == min(dim, steps):
            break
        z = apart(y - alpha * v)
        beta = float(np.linalg.norm(z))
        scale = max(scale, beta)
        if beta <= NO_RIGHT * scale or not beta:
            v, beta = fresh(), 0.0
        else:
            v = z / beta
            settled = beta * np.abs(left_small[-1, :wanted]) <= 1e-14 * values[0]
            if dim > 4 * wanted and len(alphas) > 2 * wanted and settled.all():
                break
        betas.append(beta)
    return (right @ right_small.T)[:, :wanted], values[:wanted]


def fit(rows: DataFrame, components: int = 32, steps: int | None = None, seed: int = 0) -> dict[int, Whitening]:
    """For each dimension of grained rows, its components of largest variance, to double precision.

    Each step is one pass over the rows, which are read where they lie; nothing but numbers of the size of a vector moves.
    There are as many steps as dimensions, or fewer where there are more than four times as many as components and all
    wanted components have settled to 1e-14 (a direction of exactly the variance of a settled one may then be missed);
    steps bounds them. Components of no spread (1e-10 of the largest) are left out.
    """
    out = {}
    for dim, (n, sums) in _sums(rows).items():

        def product(w: np.ndarray, short: np.ndarray, dim: int = dim, n: int = n, sums: list[int] = sums) -> tuple[np.ndarray, np.ndarray, float]:
            def of(x: np.ndarray) -> np.ndarray:
                c = _centred(x, n, sums)
                t = c @ w
                return np.concatenate((c.T @ t, (c @ short).T @ t, [t @ t]))

            total = _summed(rows, dim + short.shape[1] + 1, dim, of)
            return total[:dim], total[dim:-1], float(total[-1])

        vectors, values = bidiagonalise(product, dim, components, steps or dim, seed)
        kept = values > NO_SPREAD * values[0]
        trace = _summed(rows, 1, dim, lambda x, n=n, sums=sums: np.array([np.square(_centred(x, n, sums)).sum()]))[0]
        vectors, values = vectors[:, kept], values[kept]
        out[dim] = Whitening(n, sums, vectors, values / math.sqrt(n), np.square(values) / (trace or 1.0))
    return out


def measured(rows: DataFrame, models: dict[int, Whitening]) -> dict[int, Whitening]:
    """models with identity_error: the largest entry, in size, of the whitened rows' covariance less the identity."""
    for dim, m in models.items():
        k = m.components.shape[1]

        def of(x: np.ndarray, m: Whitening = m) -> np.ndarray:
            z = _centred(x, m.n, m.sums) @ (m.components / m.deviations)
            return (z.T @ z).ravel()

        if k:
            m.identity_error = float(np.abs(_summed(rows, k * k, dim, of).reshape(k, k) / m.n - np.eye(k)).max())
    return models


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """By row the sum of (n * x - sums)**2, exactly; None beyond the longs."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    far = x - whole
    if x.shape[1] * ((float(np.abs(far).max(initial=0)) + 1) * n) ** 2 < 2**62:
        return np.square(far * n - rest).sum(1).tolist()
    exact = [sum((a * n - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in far.tolist()]
    return [e if e < 2**63 else None for e in exact]


def transform(rows: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """vec_id, dim, deviation and whitened (an array with a number for each component) of grained rows."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(lo, 2048) for lo in range(0, whole.num_rows, 2048)):
                for dim in np.unique(np.asarray(batch.column("dim"))).tolist():
                    m, x = models[dim], _integers(batch, dim)
                    z = _centred(x, m.n, m.sums) @ (m.components / m.deviations)
                    ends = np.arange(len(x) + 1, dtype=np.int32) * z.shape[1]
                    yield pa.RecordBatch.from_pydict({
                        "vec_id": batch.filter(pc.equal(batch.column("dim"), dim)).column("vec_id"), "dim": pa.array(np.full(len(x), dim, np.int32)),
                        "deviation": pa.array(_deviations(x, m.n, m.sums), pa.int64()), "whitened": pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel()))})

    return rows.select("vec_id", "dim", "x").mapInArrow(apply, "vec_id long, dim int, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, components: int = 32, steps: int | None = None, seed: int = 0) -> DataFrame:
    """A row for each usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error.

    vectors needs vec_id (integer) and embedding (array of numbers); other columns are ignored, whatever their names.
    Null vectors, empty ones and those with an entry that is null, not finite or beyond 2**56 in size take no part (what
    those become is no long). Zero vectors, repeated rows and null ids count as rows like others. Vectors of different
    dimensions are whitened apart. Equal variances leave the choice of components open, within the plane they span.
    deviation is null where it is no long. Components without variance have no row, so a single row or equal rows give
    none. No rows, no result rows.
    """
    rows = grained(vectors)
    models = measured(rows, fit(rows, components, steps, seed))
    names = "dim int, n long, explained array<double>, identity_error double"
    told = rows.sparkSession.createDataFrame([(d, m.n, m.explained.tolist(), m.identity_error) for d, m in models.items()], names)  # a row for each dimension
    each = transform(rows, models).join(F.broadcast(told), "dim").select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")
