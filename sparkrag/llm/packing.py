"""Packing documents into training sequences of balanced cost."""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrag.llm.hashing import ALNUM, text_slices, word_hashes, words
from sparkrag.llm.held import held as kept

LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Token ids of texts, word by word: each distinct word is encoded once and remembered.

    Words are runs without ASCII white space, cut once more before the ASCII marks at their end. That is exact for
    tokenizers that drop white space, never join what it separates, and keep a run of marks apart from the letter or
    digit before it. Where the tokenizer lower-cases, A-Z and a-z are one. Texts that hold the string of a special token
    are encoded whole. The memory is emptied when it holds max_words.
    """

    MARKS = np.isin(np.arange(256), [ord(c) for c in ",.;:!?"])

    def __init__(self, path: str, max_words: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.max_words = Tokenizer.from_file(path), max_words
        made = json.loads(self.tokenizer.to_str())
        self.lower = "Lowercase" in json.dumps(made["normalizer"])
        self.special = [t["content"].encode() for t in made["added_tokens"]]
        self.letters = self._letter_table(made)
        self._reset()

    def _letter_table(self, made: dict) -> dict[int, str]:
        """What each Latin letter is to the model, if runs of letters reach it in one piece and letter by letter."""
        steps = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
        if [x["type"] for x in steps] != ["Split", "ByteLevel"] or "[\\p{L}]+" not in str(steps[0]["pattern"].get("Regex")) or steps[1]["add_prefix_space"] or not self.lower:
            return {}
        table = {}
        for c in map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]):
            if c.isalpha():
                table[ord(c)] = "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(c)))
        return table

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; runs of Latin letters go to the tokenizer's model at once."""
        out, other, model = [], [], self.tokenizer.model
        for i, text in enumerate(texts):
            if self.letters and LATIN.fullmatch(text):
                out.append([t.id for t in model.tokenize(text.translate(self.letters))])
            else:
                out.append([])
                other.append(i)
        for i, e in zip(other, self.tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _reset(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _learn(self, hashes: list[int], texts: list[str]) -> None:
        got = self._ids(texts)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        n, total = len(self.known), int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n + len(got) > len(self.begin):
            self.begin, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.size))
        self.flat[self.used:self.used + total] = np.fromiter(chain.from_iterable(got), np.uint32, total)
        self.begin[n:n + len(got)] = self.used + np.cumsum(sizes) - sizes
        self.size[n:n + len(got)] = sizes
        self.used += total
        self.known.update(zip(hashes, range(n, n + len(got)), strict=True))

    def _cut(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words' bounds with the marks at a word's end, after a letter or digit, as words of their own."""
        plain = end - 1
        tail = self.MARKS[data[plain]]
        cut = end.copy()
        while tail.any():
            at = np.flatnonzero(tail)
            cut[at] -= 1
            tail[at] = cut[at] > begin[at]
            at = np.flatnonzero(tail)
            tail[at] = self.MARKS[data[cut[at] - 1]]
        last = data[np.maximum(cut - 1, 0)]
        halves = (cut < end) & (cut > begin) & ALNUM[last] & (last < 128)
        order = np.sort(np.concatenate((begin, cut[halves])))
        stop = np.sort(np.concatenate((end, cut[halves])))
        return order, stop, np.searchsorted(order, np.append(begin, len(data))[first[:-1]])

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, id bounds by row) of runs of rows."""
        for lo, hi, data, offsets in text_slices(texts):
            begin, end, first = words(data, offsets)
            begin, end, starts = self._cut(data, begin, end, first)
            first = np.append(starts, len(begin))
            distinct, at, which = np.unique(word_hashes(data, begin, end, self.lower), return_index=True, return_inverse=True)
            keys, raw = distinct.tolist(), data.tobytes()
            if len(self.known) + len(keys) > self.max_words:
                self._reset()
            missing = [i for i, k in enumerate(keys) if k not in self.known]
            for m in range(0, len(missing), 8192):
                some = missing[m:m + 8192]
                pos = at[some]
                self._learn([keys[i] for i in some], [raw[s:e].decode() for s, e in zip(begin[pos].tolist(), end[pos].tolist(), strict=True)])
            slot = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[which] if keys else np.zeros(0, np.int64)
            size = self.size[slot]
            ends = np.concatenate(([0], np.cumsum(size)))
            ids = self.flat[np.repeat(self.begin[slot] - ends[:-1], size) + np.arange(ends[-1])]
            bounds = ends[first]
            if any(x in raw for x in self.special):
                whole = [self.tokenizer.encode(raw[s:e].decode(), add_special_tokens=False).ids if any(x in raw[s:e] for x in self.special) else ids[bounds[r]:bounds[r + 1]]
                         for r, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))]
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in whole])))
                ids = np.concatenate([np.asarray(x, np.uint32) for x in whole])
            yield lo, hi, ids, bounds


class Open:
    """Sequences by room, each with its cost; the cheapest of those with at least some room is found in logarithmic time."""

    def __init__(self, capacity: int, sequences: list[int]):
        self.leaves = 1 << capacity.bit_length()
        self.heaps: dict[int, list[tuple[float, int]]] = {capacity: [(0.0, s) for s in sequences]}
        self.tree = [(math.inf, -1)] * (2 * self.leaves)  # over rooms, the cheapest below each node
        self._refresh(capacity)

    def _refresh(self, room: int) -> None:
        at = self.leaves + room
        self.tree[at] = self.heaps[room][0] if self.heaps[room] else (math.inf, -1)
        while at > 1:
            at >>= 1
            self.tree[at] = min(self.tree[2 * at], self.tree[2 * at + 1])

    def take(self, n: int) -> tuple[float, int, int] | None:
        """(cost, sequence, room) of the cheapest sequence with room for n, which leaves; None where there is none."""
        at, lo, hi = 0, self.leaves + n, 2 * self.leaves
        best = (math.inf, -1)
        while lo < hi:  # the nodes that together hold all rooms from n
            if lo & 1:
                if self.tree[lo] < best:
                    best, at = self.tree[lo], lo
                lo += 1
            if hi & 1:
                hi -= 1
                if self.tree[hi] < best:
                    best, at = self.tree[hi], hi
            lo, hi = lo >> 1, hi >> 1
        if not at:
            return None
        while at < self.leaves:
            at = 2 * at if self.tree[2 * at] == best else 2 * at + 1
        room = at - self.leaves
        heapq.heappop(self.heaps[room])
        self._refresh(room)
        return *best, room

    def put(self, cost: float, s: int, room: int) -> None:
        if room:
            heapq.heappush(self.heaps.setdefault(room, []), (cost, s))
            self._refresh(room)


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of pieces that fill as few sequences of capacity tokens as can be.

    Whole multiples of the capacity are cut off long documents first. What is left goes, by descending cost
    linear * n + quadratic * n**2, to the sequence of lowest cost that has room; where none has, the document is cut at
    the end of the cheapest one that is not full. Ties go to the earlier document and the lower sequence.
    """
    out, rest, made = [], [], 0
    for d, n in enumerate(lengths):
        full = n // capacity
        out += [(d, k * capacity, capacity, made + k, 0) for k in range(full)]
        made += full
        if n % capacity:
            rest.append((linear * (n % capacity) + quadratic * (n % capacity) ** 2, n % capacity, d))
    rest.sort(key=lambda x: (-x[0], x[2]))
    count = -(-sum(n for _, n, _ in rest) // capacity)
    open_ = Open(capacity, list(range(made, made + count)))
    for _, n, d in rest:
        start = lengths[d] - n
        while n:
            cost, s, room = open_.take(n) or open_.take(1)
            take = min(n, room)
            out.append((d, start, take, s, capacity - room))
            open_.put(cost + linear * take + quadratic * take * take, s, room - take)
            start, n = start + take, n - take
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float | None = None, block_tokens: int = 1 << 21) -> DataFrame:
    """Cut and pack all documents into sequences of at most capacity tokens, of about equal cost.

    docs needs doc_id (integer) and text; other columns are ignored, whatever their names. A document is its token ids,
    then end_id. Its cost is linear * n + quadratic * n**2 (by default quadratic is linear / capacity: attention costs
    as much as the rest when one document fills a sequence). Each task packs what it reads, in blocks of about
    block_tokens, so no row is shuffled; a block leaves less than one sequence of padding. Returns a row for each piece:
    doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null and empty texts are one piece of one token (end_id). Null doc_id stays null; repeated rows are packed each on
    its own; ties go to the earlier row and the lower sequence. No rows, no result rows.
    """
    quadratic = linear / capacity if quadratic is None else quadratic

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = kept(("packing", tokenizer_path), lambda: WordEncoder(tokenizer_path))
        held: list[tuple] = []
        size, base = 0, TaskContext.get().partitionId() << 36

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base
            pieces = balance([len(ids) for _, ids in held], capacity, linear, quadratic)
            for lo in range(0, len(pieces), 4096):
                part = pieces[lo:lo + 4096]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([held[d][0] for d, *_ in part], pa.int64()),
                    "start": pa.array([x[1] for x in part], pa.int64()), "length": pa.array([x[2] for x in part], pa.int64()),
                    "ids": pa.array([held[d][1][s:s + n].tobytes() for d, s, n, _, _ in part], pa.binary()),
                    "doc_tokens": pa.array([len(held[d][1]) for d, *_ in part], pa.int64()),
                    "sequence_id": pa.array([base + x[3] for x in part], pa.int64()), "offset": pa.array([x[4] for x in part], pa.int64())})
            base += 1 + max((x[3] for x in pieces), default=0)

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for lo, hi, ids, bounds in encoder.encode(batch.column("text")):
                for r in range(lo, hi):
                    own = np.append(ids[bounds[r - lo]:bounds[r - lo + 1]], np.uint32(end_id)).astype("<u4")
                    held.append((keys[r], own))
                    size += len(own)
                    if size >= block_tokens:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(packed, PIECES)
