"""Exact removal of repeated word windows behind a count-min prefilter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrag.llm import blocks as B
from sparkrag.llm.hashing import gram_hashes, gram_starts, mix, text_slices, word_hashes, words

LAST = np.iinfo(np.int64).max
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_OTHER_STEP = np.uint64(0x9FB21C651E98DF25)


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(h + np.uint64(row) * np.uint64(0xA24BAED4963EE407)) >> np.uint64(64 - bits)).astype(np.int64)


def _windows(texts: pa.ChunkedArray, k: int) -> Iterator[tuple]:
    """(first row, end row, word bounds, window hashes, window starts, word hashes) by slice."""
    for lo, hi, data, offsets in text_slices(texts):
        begin, end, first = words(data, offsets)
        at, by_word = gram_starts(first, k), word_hashes(data, begin, end, False)
        yield lo, hi, first, gram_hashes(by_word, k)[at] if len(at) else np.zeros(0, np.uint64), at, by_word


def _second_hashes(by_word: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits for the windows at these starts, from words spread anew: independent of gram_hashes."""
    again = mix(by_word ^ _OTHER)
    g = np.zeros(len(at), np.uint64)
    for j in range(k):
        g = g * _OTHER_STEP + again[at + j]
    return mix(g)


def _ranked(h: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by both hashes, and where in it each different pair begins."""
    order = np.lexsort((second, h))
    a, b = h[order], second[order]
    new = np.ones(len(h), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new)


def repeated_cells(blocks: DataFrame, k: int, bits: int, depth: int, ranges: int = 16, slot_bytes: int = 1 << 30, fan: int = 64, held: int = 1 << 22) -> list[bytes]:
    """The merged sketch, cut down to one bit a cell: whether at least two windows fell into it.

    Each task merges the windows of its blocks (held of them at a time) into a sketch and sends its non-empty cells by
    range of cells and slot; there is a slot for about slot_bytes of text, so what a group takes in does not grow with
    the input. Slots are merged fan at a time, by a tree, into one. The result has depth * 2**bits bits, whatever the
    input's size: a fixed bound.
    """
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    slots = max(1, -(-int(total) // slot_bytes))
    width = (1 << bits) // ranges

    def sketched(h: np.ndarray, slot: int) -> pa.RecordBatch:
        out = {"cells": [], "slot": [], "n": [], "body": []}
        for row in range(depth):
            cell, n = np.unique(_cells(h, row, bits), return_counts=True)
            edges = np.searchsorted(cell, np.arange(ranges + 1) * width)
            for r in range(ranges):
                part, many = cell[edges[r]:edges[r + 1]], n[edges[r]:edges[r + 1]] > 1
                if len(part):
                    out["cells"].append(row * ranges + r)
                    out["slot"].append(slot)
                    out["n"].append(len(part))
                    out["body"].append(B.planes((np.diff(part, prepend=r * width) << 1 | many).astype(np.uint32)))
        return pa.RecordBatch.from_pydict({"cells": pa.array(out["cells"], pa.int32()), "slot": pa.array(out["slot"], pa.int64()), "n": pa.array(out["n"], pa.int32()), "body": pa.array(out["body"], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot, waiting, size = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            for payload in batch.column("payload"):
                for w in _windows(B.from_bytes(payload.as_py())["text"], k):
                    waiting.append(w[3])
                    size += len(w[3])
                    if size >= held:
                        yield sketched(np.concatenate(waiting), slot % slots)
                        slot, waiting, size = slot + 1, [], 0
        if size:
            yield sketched(np.concatenate(waiting), slot % slots)

    def merged(key: tuple, parts: Iterator[pa.RecordBatch], add: Callable[[np.ndarray, np.ndarray, dict], None]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(width, bool), np.zeros(width, bool)
        for t in parts:
            for row in t.to_pylist():
                add(once, twice, row)
        yield pa.RecordBatch.from_pydict({
            "cells": pa.array([key[0].as_py()], pa.int32()), "slot": pa.array([key[1].as_py()], pa.int64()),
            "once": pa.array([pa.compress(np.packbits(once).tobytes(), codec="zstd", asbytes=True)], pa.binary()),
            "twice": pa.array([pa.compress(np.packbits(twice).tobytes(), codec="zstd", asbytes=True)], pa.binary())})

    def bitmap(data: bytes) -> np.ndarray:
        return np.unpackbits(np.frombuffer(pa.decompress(data, decompressed_size=width // 8, codec="zstd", asbytes=True), np.uint8)).astype(bool)

    def add_cells(once: np.ndarray, twice: np.ndarray, row: dict) -> None:
        step = B.unplanes(row["body"], row["n"], np.uint32)
        at = np.cumsum((step >> 1).astype(np.int64))
        twice[at] |= once[at] | (step & 1).astype(bool)
        once[at] = True

    def add_bitmaps(once: np.ndarray, twice: np.ndarray, row: dict) -> None:
        other = bitmap(row["once"])
        twice |= bitmap(row["twice"]) | (once & other)
        once |= other

    def merge_cells(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return merged(key, parts, add_cells)

    def merge_bitmaps(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return merged(key, parts, add_bitmaps)

    sketch = "cells int, slot long, once binary, twice binary"
    level = blocks.select("payload").mapInArrow(count, "cells int, slot long, n int, body binary").groupBy("cells", "slot").applyInArrow(merge_cells, sketch)
    while slots > 1:
        level = level.withColumn("slot", F.floor(F.col("slot") / fan)).groupBy("cells", "slot").applyInArrow(merge_bitmaps, sketch)
        slots = -(-slots // fan)
    got = {r["cells"]: bytes(r["twice"]) for r in level.select("cells", "twice").toLocalIterator()}
    return [b"".join(pa.decompress(got[c], decompressed_size=width // 8, codec="zstd", asbytes=True) if c in got else bytes(width // 8)
                     for c in range(row * ranges, (row + 1) * ranges)) for row in range(depth)]


def _estimated_repeated(h: np.ndarray, sketch: list[np.ndarray], bits: int) -> np.ndarray:
    keep = np.ones(len(h), bool)
    for row, bitmap in enumerate(sketch):
        cell = _cells(h, row, bits)
        keep &= (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
    return keep


def _local(table: pa.Table, k: int, sketch: list[np.ndarray], bits: int) -> tuple:
    """A block's suspected windows: distinct pairs of hashes (sorted), least id of each, and by slice their places."""
    ids = np.asarray(table["doc_id"].combine_chunks().fill_null(LAST)).astype(np.int64)
    none = np.zeros(0, np.uint64)
    slices, hashes, seconds, owners = [], [none], [none], [np.zeros(0, np.int64)]
    for lo, hi, first, h, at, by_word in _windows(table["text"], k):
        keep = _estimated_repeated(h, sketch, bits)
        at, h = at[keep], h[keep]
        row = np.searchsorted(first, at, "right") - 1
        slices.append((lo, hi, first, at))
        hashes.append(h)
        seconds.append(_second_hashes(by_word, at, k))
        owners.append(ids[lo + row])
    h, second, owner = np.concatenate(hashes), np.concatenate(seconds), np.concatenate(owners)
    order, begin = _ranked(h, second)
    which = np.empty(len(h), np.int64)
    which[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(h))))
    least = np.full(len(begin), LAST, np.int64)
    np.minimum.at(least, which, owner)
    return slices, h[order[begin]], second[order[begin]], which, owner, least


def dedup_substrings(docs: DataFrame, window: int = 13, sketch_bits: int = 28, depth: int = 2, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Remove the words of windows that also start in a document with a smaller doc_id.

    docs needs doc_id (integer) and text; other columns are ignored, whatever their names. Two passes: count-min
    sketches of all windows are merged into one of fixed size (depth * 2**sketch_bits cells, one bit each), which never
    underestimates, so windows it calls unique are; the others are grouped by two independent hashes, 128 bits in all.
    Returns a row for each input row: doc_id, n_words, n_removed, kept_text (the kept words joined by one space).

    Null text counts as empty: no words, kept_text "". A null doc_id is larger than any other and gives no original;
    rows with equal doc_id never remove each other's words. Texts shorter than a window stay whole. No rows, no result
    rows.
    """
    if sketch_bits < 7:
        raise ValueError("sketch_bits must be 7 at least")
    spark = docs.sparkSession
    packed = B.pack_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    buckets = B.bucket_count(packed, bucket_bytes)
    shared = spark.sparkContext.broadcast(repeated_cells(packed, window, sketch_bits, depth))

    def sketch() -> list[np.ndarray]:
        return [np.frombuffer(b, np.uint8) for b in shared.value]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block"), batch.column("payload"), strict=True):
                _, h, second, _, _, least = _local(B.from_bytes(payload.as_py()), window, sketch(), sketch_bits)
                edges = B.bucket_edges(h, buckets)
                parts = [(b, edges[b], edges[b + 1]) for b in range(buckets) if edges[b + 1] > edges[b]]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([b for b, _, _ in parts], pa.int32()), "block": pa.array([block.as_py()] * len(parts), pa.int64()),
                    "n": pa.array([int(e - s) for _, s, e in parts], pa.int32()),
                    "hashes": pa.array([B.planes(np.diff(h[s:e], prepend=np.uint64(0))) for _, s, e in parts], pa.binary()),
                    "seconds": pa.array([second[s:e].tobytes() for _, s, e in parts], pa.binary()),
                    "least": pa.array([B.planes(least[s:e]) for _, s, e in parts], pa.binary())})

    def judge(t: pa.Table) -> pa.Table:
        """Which of a block's windows start in a smaller document of another block."""
        sizes = t["n"].to_pylist()
        h = np.concatenate([np.cumsum(B.unplanes(x, n, np.uint64)) for x, n in zip(t["hashes"].to_pylist(), sizes, strict=True)])
        least = np.concatenate([B.unplanes(x, n, np.int64) for x, n in zip(t["least"].to_pylist(), sizes, strict=True)])
        order, begin = _ranked(h, np.frombuffer(b"".join(t["seconds"].to_pylist()), np.uint64))
        lowest = np.minimum.reduceat(least[order], begin)
        flag = np.empty(len(h), bool)
        flag[order] = np.repeat(lowest, np.diff(np.append(begin, len(h)))) < least[order]
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        return pa.table({"block": t["block"], "bucket": t["bucket"], "n": t["n"],
                         "flags": pa.array([np.packbits(flag[cuts[i]:cuts[i + 1]]).tobytes() for i in range(len(sizes))], pa.binary())})

    asked = packed.select("block", "payload").mapInArrow(ask, "bucket int, block long, n int, hashes binary, seconds binary, least binary")
    answers = asked.groupBy("bucket").applyInArrow(judge, "block long, bucket int, n int, flags binary")

    def rewrite(own: pa.Table, told: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept_text": []}
        for payload in own["payload"].to_pylist():
            table = B.from_bytes(payload)
            slices, _, _, which, owner, least = _local(table, window, sketch(), sketch_bits)
            told = told.sort_by("bucket")
            flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(told["flags"].to_pylist(), told["n"].to_pylist(), strict=True)]
            elsewhere = np.concatenate(flags) if flags else np.zeros(0, bool)
            gone = elsewhere[which] | (owner > least[which])
            texts, done = table["text"].combine_chunks(), 0
            for lo, hi, first, at in slices:
                hit = at[gone[done:done + len(at)]]
                done += len(at)
                cover = np.zeros(first[-1] + window + 1, np.int32)
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + window, -1)
                covered = np.cumsum(cover)[:first[-1]] > 0
                total = np.concatenate(([0], np.cumsum(covered)))
                removed = total[first[1:]] - total[first[:-1]]
                for r in range(hi - lo):
                    parts = (texts[lo + r].as_py() or "").encode().split()
                    if removed[r]:
                        parts = [w for w, x in zip(parts, covered[first[r]:first[r + 1]].tolist(), strict=True) if not x]
                    out["kept_text"].append(b" ".join(parts).decode())
                out["n_words"].append(np.diff(first))
                out["n_removed"].append(removed)
            out["doc_id"].append(table["doc_id"].combine_chunks())
        return pa.table({"doc_id": pa.chunked_array(out["doc_id"], pa.int64()), "n_words": pa.array(np.concatenate(out["n_words"]).astype(np.int64)),
                         "n_removed": pa.array(np.concatenate(out["n_removed"]).astype(np.int64)), "kept_text": pa.array(out["kept_text"], pa.string())})

    return B.with_side(packed.select("block", "payload"), answers, rewrite, "doc_id long, n_words long, n_removed long, kept_text string")
