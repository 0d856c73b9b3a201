from collections import defaultdict

import numpy as np
import pyarrow as pa

from sparkrag.llm import blocks, substring

INF = float("inf")


def brute(rows, k):
    least = defaultdict(lambda: INF)
    split = [(INF if r[0] is None else r[0], (r[1] or "").encode().split()) for r in rows]
    for d, w in split:
        for i in range(len(w) - k + 1):
            least[tuple(w[i:i + k])] = min(least[tuple(w[i:i + k])], d)
    out = []
    for (d, w), r in zip(split, rows, strict=True):
        gone = set()
        for i in range(len(w) - k + 1):
            if least[tuple(w[i:i + k])] < d:
                gone |= set(range(i, i + k))
        out.append((r[0], len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def test_equals_brute_force(docs, rows):
    for k in (13, 5):
        got = [tuple(r) for r in substring.dedup_substrings(docs, k, sketch_bits=18, bucket_bytes=4000).collect()]
        assert sorted(got, key=key) == sorted(brute(rows, k), key=key)
    assert sum(r[2] for r in got) > 100


def test_a_tiny_sketch_loses_nothing(docs, rows):
    got = [tuple(r) for r in substring.dedup_substrings(docs, sketch_bits=7).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 13), key=key)


def test_no_rows(none):
    assert substring.dedup_substrings(none).collect() == []


def test_slots_merge_by_a_tree_into_the_same_sketch(docs):
    packed = blocks.pack_blocks(docs, block_bytes=3000)
    whole = substring.repeated_cells(packed, 5, 14, 2)
    assert any(any(x) for x in whole)
    assert substring.repeated_cells(packed, 5, 14, 2, slot_bytes=2000, fan=3, held=50) == whole


def test_windows_whose_first_hashes_collide_stay_apart(rows, monkeypatch):
    whole = substring.gram_hashes
    monkeypatch.setattr(substring, "gram_hashes", lambda h, k: whole(h, k) & np.uint64(255))
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    every_cell = [np.full(1 << 15, 255, np.uint8)]
    _, h, _, _, _, least = substring._local(table, 5, every_cell, 18)
    different = {}
    for d, w in ((r[0], (r[1] or "").encode().split()) for r in rows):
        for i in range(len(w) - 4):
            window = tuple(w[i:i + 5])
            different[window] = min(different.get(window, substring.LAST), substring.LAST if d is None else d)
    assert len(np.unique(h)) <= 256 < len(h)
    assert sorted(least.tolist()) == sorted(different.values())
