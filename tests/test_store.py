"""The keyed store against a plain dictionary, killed and replayed at every step."""

import os
import random

import pytest
from pyspark.sql.types import StructType

from sparkrag.sources import store as stores
from sparkrag.sources.store import Change, Conflict, Store

SCHEMA = "k long, x string"
KEYS = {"t": ["k"], "u": ["k"]}


def rows(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def content(store, name="t", **how):
    return sorted(map(tuple, store.read(name, StructType.fromDDL(SCHEMA), **how).collect()), key=str)


def test_equals_a_dictionary(spark, tmp_path):
    r, truth, store = random.Random(1), {}, Store(spark, str(tmp_path / "s"), KEYS, 4)
    assert content(store) == [] and store.state().version == -1
    with pytest.raises(KeyError):
        store.read("t")
    for step in range(9):
        new = {r.choice([None, *range(20)]): [f"{step}-{i}" for i in range(r.randint(1, 3))] for _ in range(6)}
        gone = [k for k in (None, *range(20)) if k not in new and r.random() < 0.15]
        store.commit({"t": Change(rows(spark, [(k, x) for k, xs in new.items() for x in xs]), spark.createDataFrame([(k,) for k in [*new, *gone]], "k long"))})
        truth = {k: xs for k, xs in (truth | new).items() if k not in gone}
        want = sorted(((k, x) for k, xs in truth.items() for x in xs), key=str)
        if step % 3 == 1:
            store.compact("t", whole=step > 5)
        assert content(store) == want
        asked = [(k,) for k in (None, 3, 7, 99)]
        assert content(store, keys=spark.createDataFrame(asked, "k long")) == [w for w in want if w[0] in (None, 3, 7, 99)]
    assert len(store.state().tables["t"]["folders"]) < 5
    assert content(store, version=0) and content(store, version=0) != content(store)
    assert store.vacuum(keep=1, hours=0) and content(store) == want


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), KEYS, 4)
    store.commit({"t": rows(spark, [(i, "x" * 50) for i in range(20000)])})
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "s" / "t").rglob("*.parquet"))
    before = size()
    for i in range(3):
        store.commit({"t": rows(spark, [(i, "y")])})
        assert not store.compact("t") or store.state().tables["t"]["folders"][0]["rows"] == 20000
    assert size() - before < before / 5


def test_two_writers_do_not_both_win(spark, tmp_path):
    a, b = (Store(spark, str(tmp_path / "s"), KEYS) for _ in range(2))
    a.commit({"t": rows(spark, [(1, "first")])})
    seen = b.state()
    a.commit({"t": rows(spark, [(1, "a")])})
    with pytest.raises(Conflict):
        b.commit({"t": rows(spark, [(1, "b")])}, base=seen)
    assert content(b) == [(1, "a")]
    tries = []

    def work():
        tries.append(1)
        b.commit({"t": rows(spark, [(2, "b")])}, base=seen if len(tries) == 1 else None)

    stores.retrying(work)
    assert len(tries) == 2 and content(a) == [(1, "a"), (2, "b")]


def test_compaction_keeps_what_others_add(spark, tmp_path, monkeypatch):
    a, b = (Store(spark, str(tmp_path / "s"), KEYS) for _ in range(2))
    for i in range(3):
        a.commit({"t": rows(spark, [(i, "x")])})
    merged, write = [], Store._write

    def slow(self, name, df):
        if not merged:
            merged.append(1)
            b.commit({"t": rows(spark, [(9, "meanwhile")])})
        return write(self, name, df)

    monkeypatch.setattr(Store, "_write", slow)
    assert a.compact("t", whole=True)
    assert content(a) == [(0, "x"), (1, "x"), (2, "x"), (9, "meanwhile")] and len(a.state().tables["t"]["folders"]) == 2


@pytest.mark.parametrize("step", ["before t", "before u", "before the commit", "after the commit"])
def test_killed_anywhere_and_replayed(spark, tmp_path, monkeypatch, step):
    store = Store(spark, str(tmp_path / "s"), KEYS)
    store.commit({"t": rows(spark, [(1, "old")]), "u": rows(spark, [(1, "old")])}, ("s", 0))
    changes = lambda: {"t": Change(rows(spark, [(2, "new")]), spark.createDataFrame([(1,), (2,)], "k long")), "u": rows(spark, [(1, "new")])}
    write, publish = Store._write, Store._publish

    class Killed(Exception):
        pass

    def dying_write(self, name, df):
        if step == f"before {name}":
            raise Killed
        return write(self, name, df)

    def dying_publish(self, state):
        if step == "before the commit":
            raise Killed
        publish(self, state)
        if step == "after the commit":
            raise Killed

    with monkeypatch.context() as m:
        m.setattr(Store, "_write", dying_write)
        m.setattr(Store, "_publish", dying_publish)
        with pytest.raises(Killed):
            store.commit(changes(), ("s", 1))
    whole = step == "after the commit"
    assert (content(store), content(store, "u")) == (([(2, "new")], [(1, "new")]) if whole else ([(1, "old")], [(1, "old")]))
    for _ in range(2):
        store.commit(changes(), ("s", 1))
        assert (content(store), content(store, "u")) == ([(2, "new")], [(1, "new")])
    assert store.state().version == 1
    left = sum(len(os.listdir(tmp_path / "s" / t)) for t in KEYS)
    assert store.vacuum(keep=10, hours=0) == left - 4


def test_columns_of_a_table_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), KEYS)
    store.commit({"t": rows(spark, [(1, "a")])})
    with pytest.raises(ValueError, match="columns"):
        store.commit({"t": spark.createDataFrame([(1, 2)], "k long, x long")})


def test_dual_sink_is_all_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), dict.fromkeys(("chunks", "postings", "documents"), ["k"]))
    stores.write_corpus(store, rows(spark, [(1, "c")]), rows(spark, [(1, "p")]), rows(spark, [(1, "d")]))
    assert [content(store, n) for n in ("chunks", "postings", "documents")] == [[(1, "c")], [(1, "p")], [(1, "d")]]
    assert not os.listdir(tmp_path / "s" / "_drafts")
