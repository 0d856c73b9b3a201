"""Documents packed into blocks of bounded size, and the exchange of hashed keys between blocks and buckets.

Jobs that look up corpus-wide facts about every word or window would move one row for each of them. Here a block of
some megabytes of text asks once for each distinct key it holds: keys travel as packed arrays, are dealt out by hash
range, and the answers return by block. A key that a third of all documents hold then costs one entry a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrag.llm.held import let_go
from sparkrag.session import saved

BLOCK_BYTES = 8 << 20
#: Counted for each row besides its text, so that a block has fewer than 2**18 rows.
ROW_BYTES = 64
PACKED = "block long, n int, n_bytes long, payload binary"


def to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=7))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def pack_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for about block_bytes of the column text, with all columns of docs in the payload; written once.

    Rows keep their identity by place (block, row), so repeated and null ids are no trouble. A text longer than
    block_bytes makes a block of its own.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        let_go()
        held, size, block = [], 0, TaskContext.get().partitionId() << 20

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            return pa.RecordBatch.from_pydict(
                {"block": pa.array([block]), "n": pa.array([len(table)], pa.int32()), "n_bytes": pa.array([size]), "payload": pa.array([to_bytes(table)], pa.binary())})

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64) + ROW_BYTES
            ends, lo = np.cumsum(sizes), 0
            while lo < len(ends):
                before = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + block_bytes - size, "right")))
                held.append(batch.slice(lo, hi - lo))
                size += int(ends[min(hi, len(ends)) - 1] - before)
                lo = hi
                if size >= block_bytes or lo < len(ends):
                    yield flush()
                    held, size, block = [], 0, block + 1
        if held:
            yield flush()

    return saved(docs.mapInArrow(packed, PACKED), "blocks", compression="uncompressed")


def bucket_count(blocks: DataFrame, bytes_each: int) -> int:
    """So many buckets that each stands for about bytes_each of text, whatever the input's size."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(1, -(-int(total) // bytes_each))


def bucket_edges(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's hash range begins in a sorted array (one more at the end)."""
    bounds = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_hashes, bounds), [len(sorted_hashes)]))


def planes(values: np.ndarray) -> bytes:
    """Integers as zstd-compressed byte planes: high bytes of small values vanish."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True)


def unplanes(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).reshape(-1).view(kind)


def with_side(blocks: DataFrame, side: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn(block row, side rows of that block) for every block; side has a column block and bounded rows for each."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(left, right)

    return blocks.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(both, schema)
