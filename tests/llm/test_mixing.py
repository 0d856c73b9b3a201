from fractions import Fraction

from pyspark.sql import functions as F

from sparkrag.llm import mixing


def test_targets_and_ceilings(docs, rows):
    got = mixing.mix(docs, block=4, shard_rows=4).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction((3, 1, 2)[i % 3]) for i, s in enumerate(order)}
    left, target, open_ = Fraction(3, 2) * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]} or open_
        for s in full:
            target[s] = min(weight[s] * level, Fraction(2 * sizes[s]))
            left -= target[s]
        open_ -= full
    taken = dict.fromkeys(order, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - float(target[r["source"]])) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 4 * 6, s
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, block=4, shard_rows=4).collect()))


def test_sainte_lague_equals_brute_force(spark):
    for votes, seats in (([53, 24, 23], 7), ([1] * 9, 4), ([1000, 1, 1, 1, 1, 1], 11), ([10, 0, 5], 30), ([], 5), ([7, 7, 7], 0)):
        quotients = sorted(((-Fraction(v, 2 * k + 1), i) for i, v in enumerate(votes) for k in range(seats) if v), key=lambda x: x)[:seats]
        want = [sum(i == j for _, j in quotients) for i in range(len(votes))]
        df = spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "k long, v long, seats long")
        got = {r["k"]: r["quota"] for r in mixing.sainte_lague(df, [], "k", "v", "seats").collect()}
        assert [got[i] for i in range(len(votes))] == want


def test_no_rows(none):
    assert mixing.mix(none).collect() == []
    assert none.select(mixing.word_count(F.col("text"))).collect() == []


def test_frequent_and_rare_sources_get_their_plan(spark):
    names = [None if i % 3 == 0 else f"rare{i}" if i % 3 == 1 else "often" for i in range(4500)]
    own = spark.createDataFrame(list(enumerate(names)), "doc_id long, source string")
    counts = [(s, names.count(s), f"of {s}") for s in set(names)]
    plan = spark.createDataFrame(counts, "source string, rows long, told string")
    got = mixing.with_plan(own, plan).collect()
    assert sorted(tuple(r) for r in got) == sorted(((i, s, f"of {s}") for i, s in enumerate(names)))
