import random

import numpy as np
import pyarrow as pa

from sparkrag.llm import jaccard

from .conftest import invented


def shingles(text, k=5):
    w = (text or "").encode().lower().split() if text else []
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if sets[i] and ids else r[0]))
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def corpus():
    """Many edited copies of few texts, at all similarities around the threshold."""
    rng, rows = random.Random(5), []
    for base in range(12):
        words = invented(100 + base, 60).split()
        for _ in range(14):
            w = list(words)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            cut = rng.choice([0, 0, 3, 9])
            rows.append(" ".join(w[cut:] if rng.random() < 0.5 else w))
    rows += [invented(900, 40) + " " + invented(1000 + i, 14) for i in range(20)]
    rows += ["short one", "short one", "Short ONE", "a", "b c d e", "b c d e f"]
    return [(i, t) for i, t in enumerate(rows)]


def test_groups_equal_brute_force(spark, docs, rows):
    got = [tuple(r) for r in jaccard.similar_groups(docs).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    many = corpus()
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in jaccard.similar_groups(df, bucket_bytes=20_000).collect()]
    want = brute(many)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert 10 < len({r[2] for r in want}) < len(want) - 40


def test_prefixes_alone_lose_no_pair():
    """Without hubs, every similar pair is a candidate whatever the numbers of matches asked for."""
    many = corpus()
    got = [g[b[i]:b[i + 1]] for lo, hi, g, b in jaccard.shingle_sets(pa.array([t for _, t in many]), 5) for i in range(hi - lo)]
    rng = np.random.default_rng(0)
    levels, unit = jaccard.levels_of(rng.integers(0, 15_000, 1 << jaccard.SKETCH_BITS).astype(np.uint16))
    made = [jaccard.prefix(g, levels, unit, 75) for g in got]
    assert len({m[1] for m in made}) > 1
    pairs = 0
    for i, x in enumerate(got):
        for j, y in enumerate(got):
            inter = len(np.intersect1d(x, y))
            if (len(y), j) < (len(x), i) and 100 * inter >= 75 * (len(x) + len(y) - inter):
                asks, overlap = made[i][1], -(-75 * (len(x) + len(y)) // 175)
                a, b = made[i][0][:len(x) - overlap + asks], made[j][0][:len(y) - overlap + asks]
                assert len(np.intersect1d(a, b)) >= asks
                pairs += 1
    assert pairs > 100


def family(n, size, seed):
    """Copies of one text with so many words changed that some reach the similarity to each other and some to none."""
    rng, base = random.Random(seed), invented(77, size).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(2, 7)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def test_large_family_around_the_threshold(spark, monkeypatch):
    texts = family(1500, 150, 3) + family(300, 700, 4)
    monkeypatch.setattr(jaccard, "CHUNK", 300)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(df, bucket_bytes=200_000).collect()}
    sets = [g[b[i]:b[i + 1]] for lo, hi, g, b in jaccard.shingle_sets(pa.array(texts), 5) for i in range(hi - lo)]
    token, where = np.unique(np.concatenate(sets), return_inverse=True)
    many = np.bincount(where) > 1
    column = np.cumsum(many) - 1
    n = np.array([len(g) for g in sets])
    rows = np.repeat(np.arange(len(sets)), n)
    held = np.zeros((len(sets), many.sum()), np.float32)
    held[rows[many[where]], column[where[many[where]]]] = 1
    inter = held @ held.T
    links = 100 * inter >= 75 * (n[:, None] + n[None, :] - inter)
    lowest = np.arange(len(sets))
    while True:
        new = np.minimum(lowest, np.where(links, lowest[None, :], len(sets)).min(1))
        if (new == lowest).all():
            break
        lowest = new
    assert [got[i] for i in range(len(texts))] == lowest.tolist()
    assert 50 < len(set(lowest.tolist())) < len(texts) - 50


def test_sketches_never_underestimate():
    rng = np.random.default_rng(1)
    for n in (1, 30, 399, 401, 5000):
        own = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64) << np.uint64(1)) for _ in range(2)]
        own.append(np.unique(np.concatenate((own[0][::2], own[1][::3]))))
        told = [jaccard.sketch(g) for g in own]
        for width in (jaccard.NARROW, jaccard.WIDE):
            cells = jaccard._cells(told, width).astype(int)
            for i, x in enumerate(own):
                for j, y in enumerate(own):
                    if width == jaccard.NARROW or len(told[i]) == len(told[j]) == width:
                        assert np.minimum(cells[i], cells[j]).sum() >= len(np.intersect1d(x, y))
    same = np.arange(70_000, dtype=np.uint64) << np.uint64(4)
    assert jaccard.sketch(same) == b"" and jaccard._cells([b""], jaccard.NARROW).min() > 60_000


def test_one_token_in_20000_sets_gives_few_rows():
    rng = np.random.default_rng(2)
    n = np.sort(rng.integers(90, 110, 20_000))
    part = np.arange(20_000)
    a, b, later = jaccard._group_pairs(np.array([20_000]), np.array([0]), part, n, 75)
    assert len(a) == 0 and later.tolist() == part.tolist()
    a, b, later = jaccard._group_pairs(np.array([5, 2, 40]), np.array([0, 5, 7]), np.array([1, 1, 2, 1, 1, 3, 4, *[9] * 39, 8]), np.full(47, 10), 75)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted([(0, 2), (1, 2), (2, 3), (2, 4), (5, 6), *((7 + i, 46) for i in range(39))]) and not len(later)


def test_no_rows(none):
    assert jaccard.similar_groups(none).collect() == []
