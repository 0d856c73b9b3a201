"""Structured Streaming forms of ingest, upsert, telemetry and progress."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pyspark.sql.types import StructType

from sparkrag.operators.chunking import chunk_each
from sparkrag.operators.corpus import classify_incoming
from sparkrag.session import saved
from sparkrag.sources.store import Change, Store, retrying


#: Key columns of the tables that ingest keeps.
CORPUS_KEYS = {"chunks": ["doc_id"], "quarantine": ["doc_id"], "outcomes": ["batch", "doc_id"], "documents": ["doc_id"]}
DOCUMENTS = "doc_id long, content_hash string, n_chunks int"
CHUNKS = "doc_id long, chunk_index int, content string, heading_path string"
QUARANTINE = "doc_id long, content_hash string, text string, error string, attempts int"


def corpus_store(spark: SparkSession, root: str, buckets: int = 16) -> Store:
    return Store(spark, root, CORPUS_KEYS, buckets)


def ingest_batch(store: Store, batch: DataFrame, number: tuple[str, int] | None = None, chunker: str | Callable = "recursive_character", attempts: int = 1) -> None:
    """Chunk a batch's new and changed documents (doc_id, content_hash, text) and commit chunks, outcomes and documents.

    Unchanged documents are skipped. A document without text is stored with no chunks. One whose chunking fails goes to
    the table quarantine with its error, and what was stored of it stays. outcomes has a row for each document of each
    batch (outcome, n_chunks, error), which ingest_summary counts. Of several versions of a document in one batch the one
    of the largest content_hash counts. The work is a batch's own: of stored documents only the buckets of its keys are
    read.
    """
    label = f"{number[0]}-{number[1]}" if number else uuid.uuid4().hex
    best = W.partitionBy("doc_id").orderBy(F.desc_nulls_last("content_hash"), F.desc_nulls_last("text"))
    own = batch.select(F.col("doc_id").cast("long").alias("doc_id"), "content_hash", "text").withColumn("_nth", F.row_number().over(best)).where("_nth = 1").drop("_nth")
    own = saved(own, "ingest-batch")

    def work() -> None:
        state = store.state()
        told = classify_incoming(own, store.read("documents", StructType.fromDDL(DOCUMENTS), keys=own, state=state))
        split = chunk_each(told.where("outcome = 'ingested'"), chunker)
        done = told.join(split, "doc_id", "left").withColumn("outcome", F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("outcome")))
        done = saved(done.withColumn("n_chunks", F.coalesce(F.size("chunks"), F.lit(0))), "ingest-outcomes")
        good, bad = done.where("outcome in ('ingested', 'no_text')"), done.where("outcome = 'failed'")
        touched = done.where("outcome <> 'skipped'").select("doc_id")
        store.commit({
            "chunks": Change(good.where("outcome = 'ingested'").select("doc_id", F.inline("chunks")), good.select("doc_id")),
            "quarantine": Change(bad.select("doc_id", "content_hash", "text", "error", F.lit(attempts).alias("attempts")), touched),
            "outcomes": Change(done.select(F.lit(label).alias("batch"), "doc_id", "outcome", "n_chunks", "error")),
            "documents": Change(good.select("doc_id", "content_hash", F.col("n_chunks").cast("int").alias("n_chunks"))),
        }, number, base=state)

    retrying(work)
    for name in CORPUS_KEYS:
        store.compact(name)


def retry_quarantined(store: Store, chunker: str | Callable = "recursive_character", most: int = 5) -> None:
    """Ingest once more what earlier runs had to set aside, each document up to most times in all."""
    held = store.read("quarantine", StructType.fromDDL(QUARANTINE)).where(F.col("attempts") < most)
    for (attempts,) in held.select("attempts").distinct().collect():  # at most `most` numbers
        ingest_batch(store, held.where(F.col("attempts") == attempts), None, chunker, attempts + 1)


def stream_ingest(source: DataFrame, root: str, checkpoint: str, chunker: str | Callable = "recursive_character", stream: str = "ingest"):
    """Started query: each batch of documents (doc_id, content_hash, text) is ingested into the store under root, after
    what earlier runs set aside was tried again. A bad document never stops the others; a batch that is replayed after a
    crash changes nothing twice. Each batch writes in proportion to itself."""
    store = corpus_store(source.sparkSession, root)
    retry_quarantined(store, chunker)
    run = lambda batch, n: ingest_batch(corpus_store(batch.sparkSession, root), batch, (stream, n), chunker)
    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_messages(source: DataFrame, root: str, checkpoint: str, watermark: str = "1 hour", stream: str = "messages"):
    """Started query: messages (guid, ts, ...) are kept once each in the store's table messages: within the watermark by
    state, beyond it against the store, of which a batch reads the buckets of its guids alone."""

    def keep(batch: DataFrame, n: int) -> None:
        store = Store(batch.sparkSession, root, {"messages": ["guid"]})
        own = saved(batch.dropDuplicates(["guid"]), "messages")

        def work() -> None:
            state = store.state()
            old = store.read("messages", own.schema, keys=own, state=state)
            store.commit({"messages": own.join(old.select("guid"), "guid", "left_anti").select(*own.columns)}, (stream, n), base=state)

        retrying(work)
        store.compact("messages")

    once = source.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["guid"])
    return once.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_metrics(events: DataFrame, window: str, slide: str | None = None, watermark: str = "1 hour", labels: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """start, labels, n, total, up_to_50 over windows of event time (ts); batch or stream."""
    df = events.withWatermark("ts", watermark) if events.isStreaming else events
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return df.groupBy(w.alias("w"), *labels).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.count_if(F.col("value") <= 50).alias("up_to_50")).select(F.col("w.start").alias("start"), *labels, "n", "total", "up_to_50")


def sessions(events: DataFrame, gap: str, watermark: str = "1 hour", by: str = "user_id") -> DataFrame:
    """by, start, n of bursts of events not further apart than gap; batch or stream."""
    df = events.withWatermark("ts", watermark) if events.isStreaming else events
    return df.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def latest_status(events: DataFrame, by: str = "user_id", status: str = "event_type") -> DataFrame:
    """by and the status of its latest event; batch or stream (update mode)."""
    return events.groupBy(by).agg(F.max_by(status, F.struct("ts", "event_id")).alias("status"))


def status_changes(events: DataFrame, interval: str, by: str = "user_id", status: str = "event_type") -> DataFrame:
    """at, status, delta: at the end of each interval in which a key's latest status changed, one key less has the old
    status and one more the new. Batch twin of stream_status_changes."""
    last = events.groupBy(by, F.window("ts", interval)["end"].alias("at")).agg(F.max_by(status, F.struct("ts", "event_id")).alias("status"))
    last = last.withColumn("old", F.lag("status").over(W.partitionBy(by).orderBy("at"))).where(~F.col("old").eqNullSafe(F.col("status")))
    steps = F.array(F.struct(F.col("old").alias("status"), F.lit(-1).alias("delta")), F.struct(F.col("status").alias("status"), F.lit(1).alias("delta")))
    return last.select("at", F.inline(steps)).where("status is not null").groupBy("at", "status").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def status_counts(changes: DataFrame) -> DataFrame:
    """at, status, n: how many keys have each status, at each time at which its number changed. changes: at, status, delta,
    of which there is one row for each status and interval once they are summed."""
    each = changes.groupBy("at", "status").agg(F.sum("delta").alias("delta"))
    return each.select("at", "status", F.sum("delta").over(W.partitionBy("status").orderBy("at")).alias("n"), "delta").where("delta <> 0").drop("delta")


class _Changes(StatefulProcessor):
    """Holds a key's last status, and the latest event of each interval that the watermark has not passed."""

    def __init__(self, millis: int):
        self.millis = millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string")
        self.pending = handle.getMapState("pending", "at long", "ts long, event_id long, status string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        for df in rows:
            for ts, event, status in zip(df["ts"].astype("datetime64[us]").astype("int64"), df["event_id"], df["status"], strict=True):
                at = (ts // 1000 // self.millis + 1) * self.millis
                held = self.pending.getValue((at,)) if self.pending.containsKey((at,)) else None
                if held is None:
                    self.handle.registerTimer(at)
                if held is None or (ts, event) > (held[0], held[1]):
                    self.pending.updateValue((at,), (int(ts), int(event), status))
        yield pd.DataFrame({"at": pd.Series(dtype="int64"), "status": pd.Series(dtype="object"), "delta": pd.Series(dtype="int32")})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        old, new = self.last.get()[0] if self.last.exists() else None, self.pending.getValue((at,))[2]
        self.pending.removeKey((at,))
        steps = [] if old == new else [(at, s, d) for s, d in ((old, -1), (new, 1)) if s is not None]
        self.last.update((new,))
        yield pd.DataFrame(steps, columns=["at", "status", "delta"]).astype({"at": "int64", "delta": "int32"})

    def close(self) -> None:
        pass


def stream_status_changes(events: DataFrame, minutes: int, by: str = "user_id", status: str = "event_type", watermark: str = "1 hour") -> DataFrame:
    """at, status, delta as status_changes gives them, appended when the watermark passes an interval's end, so that late
    events count where they belong. State holds a status for each key, and its latest event in each open interval. A sink
    adds rows of equal at and status up."""
    own = events.select(F.col(by).alias("key"), "ts", "event_id", F.col(status).alias("status")).withWatermark("ts", watermark)
    steps = own.groupBy("key").transformWithStateInPandas(_Changes(minutes * 60000), "at long, status string, delta int", "Append", "EventTime")
    return steps.select(F.timestamp_millis("at").alias("at"), "status", "delta")


class _Progress(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        out = []
        for df in rows:
            for event, kind in sorted(zip(df["event_id"], df["event_type"], strict=True)):
                n += 1
                out.append((key[0], event, n, kind in ("purchase", "done", "failed")))
        self.count.update((n,))
        yield pd.DataFrame(out, columns=["run_id", "event_id", "done", "terminal"])

    def close(self) -> None:
        pass


def stream_progress(events: DataFrame) -> DataFrame:
    """run_id, event_id, done, terminal: a running count for each run (run_id, event_id, event_type); appended rows, read
    again, replay a run for a late reader."""
    return events.groupBy("run_id").transformWithStateInPandas(_Progress(), "run_id long, event_id long, done long, terminal boolean", "Append", "None")


def split_deltas(text: str, held: str, thinking: bool, orphan: bool, last: bool) -> tuple[list[tuple[str, str]], str, bool, bool]:
    """(kind and text of parts, what is held back as it may begin a tag, whether reasoning is open, whether a closing tag
    stood alone)."""
    text, parts = held + text, []
    while True:
        found = [(text.find(t), t) for t in ("<think>", "</think>") if t in text]
        if not found:
            break
        at, tag = min(found)
        if at:
            parts.append(("reasoning" if thinking else "answer", text[:at]))
        orphan |= tag == "</think>" and not thinking
        thinking, text = tag == "<think>", text[at + len(tag):]
    keep = 0 if last else max((n for n in range(1, 8) if any(t.startswith(text[-n:]) and len(text) >= n for t in ("<think>", "</think>"))), default=0)
    if text[:len(text) - keep]:
        parts.append(("reasoning" if thinking else "answer", text[:len(text) - keep]))
    return parts, text[len(text) - keep:], thinking, orphan


class _Split(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "held string, thinking boolean, orphan boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        held, thinking, orphan = self.state.get() if self.state.exists() else ("", False, False)
        out = []
        for seq, text, last in sorted((r for df in rows for r in zip(df["seq"], df["delta"], df["last"], strict=True))):
            parts, held, thinking, orphan = split_deltas(text, held, thinking, orphan, bool(last))
            out += [(key[0], seq, i, k, t, orphan) for i, (k, t) in enumerate(parts)]
        self.state.update((held, thinking, orphan))
        yield pd.DataFrame(out, columns=["message_id", "seq", "part", "kind", "text", "orphan"])

    def close(self) -> None:
        pass


def stream_split(deltas: DataFrame) -> DataFrame:
    """message_id, seq, part, kind (reasoning or answer), text, orphan of streamed fragments (message_id, seq, delta, last);
    tags may be cut anywhere, and the fragment marked last lets go what is held back."""
    return deltas.groupBy("message_id").transformWithStateInPandas(_Split(), "message_id long, seq long, part int, kind string, text string, orphan boolean", "Append", "None")
