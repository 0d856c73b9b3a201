from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sparkrag.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip(docs, rows):
    got = packing.pack_documents(docs, PATH, capacity=256, block_tokens=4000).collect()
    t = Tokenizer.from_file(PATH)
    want = sorted((r[0] is None, r[0] or 0, [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] > 0
        by_doc[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, pieces in by_doc.items():
        texts = [x for null, k, x in want if (None if null else k) == d]
        assert sum(len(p[1]) for p in pieces) == sum(map(len, texts))
        if len(texts) == 1:
            assert [x for _, ids, _ in sorted(pieces) for x in ids] == texts[0]
            assert {p[2] for p in pieces} == {len(texts[0])}
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r["length"] for r in got) / (256 * len(by_sequence)) > 0.9


def test_costs_are_balanced():
    lengths = np.random.default_rng(0).integers(20, 900, 400).tolist()
    pieces = packing.balance(lengths, 2048, 1.0, 1 / 2048)
    cost, full = defaultdict(float), defaultdict(int)
    for _, _, n, s, _ in pieces:
        cost[s] += n + n * n / 2048
        full[s] += n
    assert len(full) == -(-sum(lengths) // 2048)
    assert np.std(list(cost.values())) / np.mean(list(cost.values())) < 0.1
    assert len(pieces) < 1.25 * len(lengths)


def plain_balance(lengths, capacity, linear, quadratic):
    cost = lambda n: linear * n + quadratic * n * n
    out, made, rest = [], 0, []
    for d, n in enumerate(lengths):
        out += [(d, k * capacity, capacity, made + k, 0) for k in range(n // capacity)]
        made += n // capacity
        rest += [(d, n % capacity)] if n % capacity else []
    count = -(-sum(n for _, n in rest) // capacity)
    used, costs = dict.fromkeys(range(made, made + count), 0), dict.fromkeys(range(made, made + count), 0.0)
    for d, n in sorted(rest, key=lambda x: (-cost(x[1]), x[0])):
        start = lengths[d] - n
        while n:
            fits = [s for s in used if capacity - used[s] >= n] or [s for s in used if used[s] < capacity]
            s = min(fits, key=lambda s: (costs[s], s))
            take = min(n, capacity - used[s])
            out.append((d, start, take, s, used[s]))
            used[s], costs[s] = used[s] + take, costs[s] + cost(take)
            start, n = start + take, n - take
    return out


def test_balance_equals_the_plain_rule():
    r = np.random.default_rng(1)
    for lengths in ([400] * 150 + [100] * 70 + [2000] * 40, [1500] * 15 + [700] * 7 + [100] * 20, [900] * 40 + [150] * 9, r.integers(1, 5000, 300).tolist(), r.integers(1, 60, 500).tolist(), [2048, 4096, 1]):
        for capacity in (2048, 100):
            assert packing.balance(lengths, capacity, 1.0, 1 / capacity) == plain_balance(lengths, capacity, 1.0, 1 / capacity)


def test_no_rows(none):
    assert packing.pack_documents(none, PATH).collect() == []
    assert packing.balance([], 8, 1, 1) == []
