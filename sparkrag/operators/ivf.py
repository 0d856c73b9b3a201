"""Approximate search: an inverted file of cells, each with one-bit codes of its vectors' residuals."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrag.functions import vectors as V
from sparkrag.operators.best import BestK
from sparkrag.operators.search import top_k
from sparkrag.session import saved, scratch_dir

BLOCK = "block int, n int, ids binary, codes binary, scales binary, cell int"


@dataclass
class IvfIndex:
    """centres of cells, rotations, the number of rows, and by cell the packed codes (blocks), the vectors, and the bundle
    (cell, bundle): cells that have few rows share one."""

    centres: np.ndarray
    turns: list[np.ndarray]
    n: int
    blocks: DataFrame
    vectors: DataFrame
    bundles: DataFrame


def _laid_out(df: DataFrame, label: str) -> DataFrame:
    """df written with a folder for each cell, so that a search reads the folders of the cells it asks."""
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy("cell").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def ivf_index(corpus: DataFrame, cells: int, sample_rows: int = 20000, rotations: int = 2, block_rows: int = 8192, seed: int = 0) -> IvfIndex:
    """Index of a corpus (id, vector), all vectors of one dimension. Cells are fitted by k-means on a sample of at most
    sample_rows unit vectors; every vector goes to its nearest cell. Of what a cell's centre leaves of a unit vector, the
    signs under random rotations are kept, one bit a dimension and rotation, with the scale that makes their estimates of
    inner products unbiased. Blocks of about block_rows rows hold the codes; rows of equal cells are dealt out by hash."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    own = saved(corpus.where("vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")), "ivf-vectors")
    sample = own.orderBy(F.xxhash64("id", F.lit(seed))).limit(sample_rows).select(array_to_vector(V.normalized(F.col("vector"))).alias("features"))
    centres = np.array(KMeans(k=cells, seed=seed).fit(sample).clusterCenters())
    dim = centres.shape[1]
    turns = [np.linalg.qr(np.random.default_rng((seed, i)).standard_normal((dim, dim)))[0] for i in range(rotations)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column("vector"), dim))
            near = (2 * x @ centres.T - np.square(centres).sum(1)).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(near.astype(np.int32))], names=["id", "vector", "cell"])

    vectors = _laid_out(own.mapInArrow(place, "id long, vector array<double>, cell int"), "ivf-cells")
    counts = vectors.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))  # a row for each cell
    dealt = vectors.join(F.broadcast(counts), "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        cell, block = (k.as_py() for k in key)
        left = _unit(_matrix(t["vector"], dim)) - centres[cell]
        length, codes, scales = np.linalg.norm(left, axis=1), [], []
        for turn in turns:
            turned = left @ turn
            codes.append(np.packbits(turned > 0, axis=1))
            scales.append(np.divide(length**2, np.abs(turned).sum(1), out=np.zeros(len(left)), where=length > 0))
        return pa.table({"block": pa.array([block], pa.int32()), "n": pa.array([len(left)], pa.int32()), "ids": pa.array([np.asarray(t["id"]).astype(np.int64).tobytes()], pa.binary()),
                         "codes": pa.array([np.concatenate(codes, 1).tobytes()], pa.binary()), "scales": pa.array([np.stack(scales, 1).tobytes()], pa.binary()), "cell": pa.array([cell], pa.int32())})

    blocks = _laid_out(dealt.groupBy("cell", "block").applyInArrow(pack, BLOCK), "ivf-codes")
    bundles, held = [], 0
    for r in blocks.groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect():  # a row for each cell
        held += r["n"]
        new = not bundles or held > block_rows
        held = r["n"] if new else held
        bundles.append((r["cell"], (bundles[-1][1] if bundles else -1) + new))
    return IvfIndex(centres, turns, own.count(), blocks, vectors, own.sparkSession.createDataFrame(bundles, "cell int, bundle int"))


def candidates(queries: DataFrame, index: IvfIndex, most: int, nprobe: int, chunk_rows: int = 4096) -> DataFrame:
    """query_id, vector, id, cell: the most rows of highest estimated cosine for each query (query_id, vector) in its
    nprobe nearest cells. Only folders of probed cells are read; a cell's queries meet its codes in matrix products, and a
    bundle of cells hands on no more than the most best of each query."""
    centres, turns, dim = index.centres, index.turns, index.centres.shape[1]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _unit(_matrix(batch.column("vector"), dim))
            far = np.square(centres).sum(1) - 2 * q @ centres.T
            near = np.argsort(far, axis=1, kind="stable")[:, :nprobe]
            row = pa.array(np.repeat(np.arange(len(q)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(row), batch.column("vector").take(row), pa.array(near.ravel().astype(np.int32))], names=["query_id", "vector", "cell"])

    own = queries.where("vector is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    probes = saved(own.mapInArrow(probe, "query_id long, vector array<double>, cell int"), "ivf-probes").join(F.broadcast(index.bundles), "cell")
    asked = probes.groupBy("bundle").agg(F.count("*").alias("n"), F.collect_set("cell").alias("cells")).collect()  # at most a row for each cell
    blocks = index.blocks.where(F.col("cell").isin([c for r in asked for c in r["cells"]])).join(F.broadcast(index.bundles), "cell")
    chunks = F.lit(1)
    for r in asked:
        if r["n"] > chunk_rows:
            chunks = F.when(F.col("bundle") == r["bundle"], math.ceil(r["n"] / chunk_rows)).otherwise(chunks)
    probes = probes.withColumn("chunk", F.pmod(F.xxhash64("query_id"), chunks).cast("int"))
    right = probes.join(blocks.select("cell", "block").distinct(), "cell").select("query_id", "vector", F.col("cell").alias("cell_"), "chunk", F.col("block").alias("block_"), F.col("bundle").alias("bundle_"))
    left = blocks.join(probes.select("bundle", F.col("chunk").alias("part")).distinct(), "bundle")

    def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        names, row = np.unique(np.asarray(b["query_id"]).astype(np.int64), return_inverse=True)
        best, cell_of = BestK(len(names), most), {}
        asks = np.asarray(b["cell_"])
        for r in a.to_pylist() if len(b) else []:
            cell, n = r["cell"], r["n"]
            mine = np.flatnonzero(asks == cell)
            if not len(mine):
                continue
            ids, scales = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["scales"]).reshape(n, -1)
            codes = np.frombuffer(r["codes"], np.uint8).reshape(n, -1)
            q = _unit(_matrix(b["vector"].take(pa.array(mine)), dim))
            width = codes.shape[1] // len(turns)
            cell_of |= dict.fromkeys(ids.tolist(), cell)
            for lo in range(0, n, 2048):
                part = slice(lo, lo + 2048)
                estimate = np.zeros((len(q), len(ids[part])))
                for i, turn in enumerate(turns):
                    signs = np.unpackbits(codes[part, i * width:(i + 1) * width], axis=1, count=dim).astype(np.float32) * 2 - 1
                    estimate += (q @ turn).astype(np.float32) @ signs.T * scales[part, i]
                estimate = estimate / len(turns) + (q @ centres[cell])[:, None]
                at, col = np.nonzero(estimate >= best.floor[row[mine], None])
                best.add(row[mine][at], ids[part][col], estimate[at, col])
        return pa.table({"query_id": pa.array(names[best.query], pa.int64()), "id": pa.array(best.id, pa.int64()), "score": pa.array(best.score), "cell": pa.array([cell_of[i] for i in best.id.tolist()], pa.int32())})

    met = left.groupBy("bundle", "block", "part").cogroup(right.groupBy("bundle_", "block_", "chunk")).applyInArrow(meet, "query_id long, id long, score double, cell int")
    ranked = met.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= most)
    return ranked.select("query_id", "id", "cell").join(own, "query_id")


def semantic_ann(queries: DataFrame, index: IvfIndex, k: int, nprobe: int, rerank: int = 50, share: float = 0.1) -> DataFrame:
    """query_id, id, score, rank: about the k best of each query by cosine. Codes choose rerank * k rows of the nprobe
    nearest cells (at most the share of all rows, but k), of which alone the vectors are read and scored exactly."""
    most = max(k, min(rerank * k, int(index.n * share)))
    found = candidates(queries, index, most, nprobe).withColumnRenamed("vector", "asked")
    scored = found.join(index.vectors, ["cell", "id"]).select("query_id", "id", V.cosine(F.col("asked"), F.col("vector")).alias("score"))
    return top_k(scored, k)
