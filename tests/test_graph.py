"""Extraction by a given function, co-occurrence and capped expansion against plain versions."""

from collections import Counter
from itertools import combinations

import pytest

from sparkrag.operators import graph


def test_extraction_by_a_function(spark):
    df = spark.createDataFrame([("d1", "ann met bob"), ("d2", None), ("d3", "bob")], "doc_key string, text string")
    fn = lambda text: ([(w, "person") for w in text.split() if w != "met"], [tuple(text.split(" met "))] if " met " in text else [])
    mentions, links = graph.extract_with(df, fn)
    assert sorted(map(tuple, mentions.collect())) == [("d1", "ann", "person"), ("d1", "bob", "person"), ("d3", "bob", "person")]
    assert [tuple(r) for r in links.collect()] == [("d1", "ann", "bob")]
    assert {tuple(r) for r in graph.senders(spark.createDataFrame([("d1", "ann"), ("d1", "ann"), ("d1", None)], "doc_key string, sender_name string")).collect()} == {("d1", "ann", "person")}


@pytest.mark.parametrize("chunk", [256, 3])
def test_cooccurrence_equals_all_pairs(spark, chunk):
    rows = [(f"d{i}", f"n{(i * j) % 11}") for i in range(12) for j in range(i)] + [("d1", None), (None, "n1"), ("d3", "n1"), ("d3", "n1")]
    by: dict = {}
    for d, n in rows:
        if d and n:
            by.setdefault(d, set()).add(n)
    want = Counter(p for names in by.values() for p in combinations(sorted(names), 2))
    got = {(r["source"], r["target"]): r["weight"] for r in graph.cooccurrence(spark.createDataFrame(rows, "doc_key string, name string"), chunk).collect()}
    assert got == want


def test_capped_expansion(spark):
    pairs = [("a", f"b{i}") for i in range(6)] + [(f"b{i}", f"c{j}") for i in range(6) for j in range(i)] + [("c0", "d"), ("d", "d"), ("x", "y")]
    edges = spark.createDataFrame(pairs, "source string, target string")
    degree = Counter(x for p in pairs for x in p)
    for depth in (1, 2, 3):
        for most in (1, 4, 7, 9, 100):
            seen, front, cut = {"a": 0}, {"a"}, False
            for hops in range(1, depth + 1):
                new = {t for p in pairs for s, t in (p, p[::-1]) if s in front} - set(seen)
                kept = sorted(new, key=lambda x: (-degree[x], x))[:most - len(seen)]
                cut |= len(kept) < len(new)
                seen |= dict.fromkeys(kept, hops)
                front = set(kept)
            nodes, truncated = graph.expand(edges, "a", depth, most)
            assert {r["name"]: (r["hops"], r["degree"]) for r in nodes.collect()} == {x: (h, degree[x]) for x, h in seen.items()}
            assert truncated == cut
    with pytest.raises(ValueError):
        graph.expand(edges, "a", 6, 5)
