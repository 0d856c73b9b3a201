"""Vectorised 64-bit hashes of words and word n-grams, straight from Arrow text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WHITESPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_SOLID = np.ones(256, bool)
_SOLID[list(WHITESPACE)] = False
_STEP = np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
#: The first n of eight bytes.
_HEADS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
#: Bytes of letters and digits; all bytes of characters beyond ASCII count as such.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(texts: pa.Array | pa.ChunkedArray, target: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offsets) of runs of rows of about target bytes; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset:]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + target, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, solid_bytes: np.ndarray = _SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of rows laid end to end, and each row's first word (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = solid_bytes[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | cut[1:-1]
    ends[:-1] &= ~solid[1:] | cut[1:-1]
    first = np.flatnonzero(begins)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word; with lower, A-Z count as a-z.

    Words are read eight bytes at a time; each piece is spread together with its place in the word, so that no sum of
    pieces has a structure that other words could meet.
    """
    if not len(begins):
        return np.zeros(0, np.uint64)
    laid = np.zeros(len(data) + 8, np.uint8)
    laid[:-8] = _LOWERED[data] if lower else data
    eights = np.ndarray(len(data) + 1, "<u8", laid, strides=(1,))
    length = ends - begins
    left = np.minimum(length, 8)
    out = mix((eights[begins] & _HEADS[left]) + _PLACE)
    more = np.flatnonzero(length > 8)
    if len(more):
        pieces = (length[more] - 1) >> 3
        first = np.cumsum(pieces) - pieces
        nth = np.arange(int(pieces.sum())) - np.repeat(first, pieces) + 1
        at = np.repeat(begins[more], pieces) + 8 * nth
        left = np.minimum(np.repeat(ends[more], pieces) - at, 8)
        out[more] += np.add.reduceat(mix((eights[at] & _HEADS[left]) + (nth.astype(np.uint64) + np.uint64(1)) * _PLACE), first)
    return mix(out + length.astype(np.uint64))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, for each start at which k words follow; rows are not told apart."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= _STEP
        g += h[j:n + j]
    return mix(g)


def gram_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Word positions at which a k-gram fits into its row; first: each row's first word (one more at the end)."""
    room = np.maximum(np.diff(first) - k + 1, 0)
    total = int(room.sum())
    shift = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(room)[:-1])), room)
    return np.arange(total) + shift
