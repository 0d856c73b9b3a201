"""Keyed tables kept as logs: immutable folders of rows, made known by numbered commits."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns that folders have besides the table's own: the bucket of the key, and whether the row only says that its key is gone.
BUCKET, GONE = "_bucket", "_gone"


class Conflict(Exception):
    """Another writer made the commit that this one was to make."""


@dataclass(frozen=True)
class Change:
    """Rows that take the place of all rows of their keys, and of keys; keys without rows are deleted."""

    rows: DataFrame
    keys: DataFrame | None = None


@dataclass(frozen=True)
class State:
    """What a commit says: for each table its schema and its folders, oldest first, and the last batch of each stream."""

    version: int = -1
    tables: dict[str, dict] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class Store:
    """Tables under one root, each with key columns; a commit changes several of them at once.

    A change writes a new folder for each table, in proportion to itself: rows, and a mark for each key that has none
    any more, laid out by bucket of the key. It then publishes a commit, the file of the next number, which names all
    live folders. Of two writers that saw the same commit only one can make the next file; the other gets Conflict, and
    its folders stay unnamed. A writer that dies before that file leaves the store as it was; one that dies after has
    written all. A batch of a stream that is replayed is known by its number and changes nothing.

    Readers take one commit and merge on read: of each key, the newest folder that names it counts. compact merges
    folders of like sizes, so that there are about log(rows) of them and each row is rewritten about as often.
    """

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, list[str]], buckets: int = 16):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- commits

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/_commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self, version: int | None = None) -> State:
        """The newest commit, or that of a number; an empty state only where no commit was ever made."""
        numbers = self._numbers()
        if version is None and not numbers:
            return State()
        version = numbers[-1] if version is None else version
        told = json.loads(self.spark.read.text(f"{self.root}/_commits/{version:020d}.json", wholetext=True).first()[0])
        return State(version, told["tables"], told["batches"])

    def _publish(self, state: State) -> None:
        """Make the commit's file, whole, unless it is there."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        told = json.dumps({"tables": state.tables, "batches": state.batches})
        last = self._path(f"{self.root}/_commits/{state.version:020d}.json")
        draft = self._path(f"{self.root}/_drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(told.encode()))
        out.close()
        self._fs.mkdirs(last.getParent())
        whole = self._fs.makeQualified(last)
        try:
            if whole.toUri().getScheme() == "file":  # a rename would replace a file of that name, a link does not
                place = lambda p: unquote(urlparse(self._fs.makeQualified(p).toUri().toString()).path)
                os.link(place(draft), place(last))
            else:
                how = jvm.org.apache.hadoop.fs.Options.Rename
                options = self.spark.sparkContext._gateway.new_array(how, 1)
                options[0] = how.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), conf).rename(draft, last, options)
        except FileExistsError as e:
            raise Conflict(f"commit {state.version} was made by another writer") from e
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"commit {state.version} was made by another writer") from e
            raise
        finally:
            self._fs.delete(draft, False)

    # -- writing

    def _bucket(self, keys: list[str]):
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame) -> dict:
        keys, path = self.keys[name], f"{name}/{uuid.uuid4().hex}"
        laid = rows.withColumn(BUCKET, self._bucket(keys)).hint("rebalance", BUCKET) if keys else rows
        (laid.write.partitionBy(BUCKET) if keys else laid.write).parquet(f"{self.root}/{path}")
        return {"path": path, "rows": self.spark.read.schema(rows.schema).parquet(f"{self.root}/{path}").count()}  # from footers

    def commit(self, changes: dict[str, Change | DataFrame], batch: tuple[str, int] | None = None, replace: bool = False, base: State | None = None) -> int:
        """Write the changes, in order, and publish them together; the commit's number. With replace, tables become their
        changes. batch (stream, number) makes a replay do nothing. base is the state that the changes were worked out
        from: where it is no longer the newest, Conflict. A table's columns are those of its first change."""
        state = base or self.state()
        if batch and state.batches.get(batch[0], -1) >= batch[1]:
            return state.version
        tables = dict(state.tables)
        for name, change in changes.items():
            change = change if isinstance(change, Change) else Change(change)
            known, keys = tables.get(name), self.keys[name]
            schema = change.rows.schema if replace or not known else StructType.fromJson(known["schema"])
            if [(f.name, f.dataType) for f in change.rows.schema] != [(f.name, f.dataType) for f in schema]:
                raise ValueError(f"columns of {name} differ from those stored: {change.rows.schema.simpleString()}, {schema.simpleString()}")
            rows = change.rows.withColumn(GONE, F.lit(False))
            if change.keys is not None:
                rows = rows.unionByName(_without(change.keys.select(*keys).distinct(), change.rows, keys).withColumn(GONE, F.lit(True)), allowMissingColumns=True)
            before = [] if replace or not known else known["folders"]
            tables[name] = {"schema": schema.jsonValue(), "folders": [*before, self._write(name, rows)]}
        batches = state.batches | ({batch[0]: batch[1]} if batch else {})
        self._publish(State(state.version + 1, tables, batches))
        return state.version + 1

    def compact(self, name: str, whole: bool = False) -> bool:
        """Merge the newest folders of a table, back to the last one that has more than twice the rows of all later ones
        together (all folders, with whole); False where there is nothing to merge. Marks of gone keys end with the oldest
        folder. Commits that others add meanwhile are kept; where they changed the merged folders, Conflict."""
        state = self.state()
        folders = state.tables.get(name, {}).get("folders", [])
        first = len(folders)
        while first and (whole or first == len(folders) or folders[first - 1]["rows"] <= 2 * sum(f["rows"] for f in folders[first:])):
            first -= 1
        if len(folders) - first < 2:
            return False
        schema = StructType.fromJson(state.tables[name]["schema"])
        merged = self._merged(name, schema, folders[first:])
        folder = self._write(name, merged.where(~F.col(GONE)) if not first else merged)
        while True:
            now = self.state()
            live = now.tables[name]["folders"]
            if live[:len(folders)] != folders:
                raise Conflict(f"{name} was rewritten by another writer")
            tables = now.tables | {name: now.tables[name] | {"folders": [*folders[:first], folder, *live[len(folders):]]}}
            try:
                self._publish(State(now.version + 1, tables, now.batches))
                return True
            except Conflict:
                continue

    def vacuum(self, keep: int = 10, hours: float = 24.0) -> int:
        """Drop all but the newest keep commits, and folders and drafts older than hours that no commit left names; how
        many folders went. hours must exceed how long a writer or a reader takes."""
        numbers = self._numbers()
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_commits/{n:020d}.json"), False)
        named = {f["path"] for n in numbers[-keep:] for t in self.state(n).tables.values() for f in t["folders"]}
        now, gone = self.spark._jvm.java.lang.System.currentTimeMillis(), 0
        for name in self.keys:
            folder = self._path(f"{self.root}/{name}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if f"{name}/{s.getPath().getName()}" not in named and now - s.getModificationTime() >= hours * 3.6e6:
                    gone += self._fs.delete(s.getPath(), True)
        return gone

    # -- reading

    def _folder(self, schema: StructType, folder: dict, keyed: bool) -> DataFrame:
        full = StructType.fromJson(schema.jsonValue()).add(GONE, "boolean")
        return self.spark.read.schema(full.add(BUCKET, "integer") if keyed else full).parquet(f"{self.root}/{folder['path']}")

    def _merged(self, name: str, schema: StructType, folders: list[dict], buckets: list[int] | None = None) -> DataFrame:
        keys = self.keys[name]
        parts = [self._folder(schema, f, bool(keys)) for f in folders]
        if buckets is not None:
            parts = [p.where(F.col(BUCKET).isin(buckets)) for p in parts]
        if len(parts) == 1:
            return parts[0].select(*schema.names, GONE)
        later = reduce(DataFrame.unionByName, [p.withColumn("_at", F.lit(i)) for i, p in enumerate(parts[1:])])
        newest = later.groupBy(*keys).agg(F.max("_at").alias("_last"))
        kept = _matched(later, newest, keys).where("_at = _last")
        return _without(parts[0].select(*schema.names, GONE), newest, keys).unionByName(kept.select(*schema.names, GONE))

    def read(self, name: str, like: StructType | None = None, version: int | None = None, keys: DataFrame | None = None, state: State | None = None) -> DataFrame:
        """The table as of the newest commit (or of a version, or a state); with keys, only rows of these, and only the
        buckets that hold them are read. A table that no commit names has no rows where like gives its columns, and is a
        KeyError otherwise."""
        told = (state or self.state(version)).tables.get(name)
        if told is None:
            if like is None:
                raise KeyError(f"no table {name} under {self.root}")
            return self.spark.createDataFrame([], like)
        own, buckets = self.keys[name], None
        if keys is not None:
            asked = keys.select(*own).distinct()
            buckets = [r[0] for r in asked.select(self._bucket(own)).distinct().collect()]  # at most self.buckets numbers
        out = self._merged(name, StructType.fromJson(told["schema"]), told["folders"], buckets).where(~F.col(GONE)).drop(GONE)
        return out if keys is None else _matched(out, asked, own)


def _renamed(keys: DataFrame, own: list[str]) -> DataFrame:
    return keys.select(*[F.col(k).alias(f"_key_{k}") if k in own else k for k in keys.columns if k in own or k.startswith("_")])


def _same(own: list[str]):
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in own])


def _without(rows: DataFrame, keys: DataFrame, own: list[str]) -> DataFrame:
    """Rows whose key is not among keys; null keys are equal."""
    return rows.join(_renamed(keys.select(*own), own), _same(own), "left_anti")


def _matched(rows: DataFrame, keys: DataFrame, own: list[str]) -> DataFrame:
    """Rows whose key is among keys (each once), with what columns keys has besides."""
    return rows.join(_renamed(keys, own), _same(own)).drop(*[f"_key_{k}" for k in own])


def retrying(work: Callable[[], object], tries: int = 5) -> object:
    """work done again on the newest state as long as others commit first."""
    for left in reversed(range(tries)):
        try:
            return work()
        except Conflict:
            if not left:
                raise


def write_corpus(store: Store, chunks: Change | DataFrame, postings: Change | DataFrame, documents: Change | DataFrame, batch: tuple[str, int] | None = None) -> int:
    """Chunk rows, index rows and document rows in one commit: readers see all three or none of them."""
    return store.commit({"chunks": chunks, "postings": postings, "documents": documents}, batch)
