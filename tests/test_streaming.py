import random
from datetime import timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrag.functions import text as T
from sparkrag.operators.corpus import ingest_summary
from sparkrag.sources.store import Store
from sparkrag.streaming import streams


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_of(spark, df, path, parts=3):
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_windows_and_sessions_equal_their_batch_twins(spark, events, tmp_path):
    source = stream_of(spark, events, str(tmp_path / "in"))
    for make, name in ((lambda df: streams.windowed_metrics(df, "1 day").drop("total"), "windows"), (lambda df: streams.sessions(df, "2 hours", "60 days"), "bursts")):
        assert sorted(map(str, run(make(source), name, "complete").collect())) == sorted(map(str, make(events).collect()))


def test_messages_are_kept_once(spark, events, tmp_path):
    m = events.select(F.col("event_id").alias("guid"), "ts")
    both = m.where("guid < 600").union(m.where("guid >= 400"))
    streams.stream_messages(stream_of(spark, both, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), "60 days").awaitTermination()
    got = [r["guid"] for r in Store(spark, str(tmp_path / "out"), {"messages": ["guid"]}).read("messages").collect()]
    assert sorted(got) == sorted(r["guid"] for r in m.collect())


def test_incremental_ingest_equals_full(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.sha2("text", 256).alias("content_hash"), "text")
    d.where("doc_id < 120").coalesce(1).write.parquet(str(tmp_path / "in"))
    root = str(tmp_path / "store")

    def ingest():
        streams.stream_ingest(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), root, str(tmp_path / "cp")).awaitTermination()
        store = streams.corpus_store(spark, root)
        return sorted(map(str, store.read("chunks").collect())), store.read("documents").count()

    ingest()
    d.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    chunks, n = ingest()
    from sparkrag.operators.chunking import chunk

    assert n == d.count() and chunks == sorted(map(str, chunk(d.where(T.has_text(F.col("text")))).collect()))


def test_bad_documents_are_set_aside_and_tried_again(spark, tmp_path):
    d = spark.createDataFrame([(1, "h1", "one two three four five six " * 9), (2, "h2", "a bad apple, long enough to be indexed " * 3), (3, "h3", " "), (4, "h4", "seven eight nine ten eleven twelve " * 3)], "doc_id long, content_hash string, text string")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    root = str(tmp_path / "store")

    def picky(text):
        if "bad" in text:
            raise ValueError("bad apple")
        return [("", text)]

    def run(chunker):
        streams.stream_ingest(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), root, str(tmp_path / "cp"), chunker).awaitTermination()
        store = streams.corpus_store(spark, root)
        return {name: [r.asDict() for r in store.read(name).orderBy("doc_id").collect()] for name in streams.CORPUS_KEYS}

    got = run(picky)
    assert [r["doc_id"] for r in got["chunks"]] == [1, 4] and [(r["doc_id"], r["n_chunks"]) for r in got["documents"]] == [(1, 1), (3, 0), (4, 1)]
    assert [(r["doc_id"], r["error"], r["attempts"]) for r in got["quarantine"]] == [(2, "ValueError: bad apple", 1)]
    counts = ingest_summary(spark.createDataFrame(got["outcomes"], "batch string, doc_id long, outcome string, n_chunks int, error string")).first().asDict()
    assert counts == {"ingested": 2, "skipped": 0, "no_text": 1, "unsupported": 0, "failed": 1, "n_chunks": 2}
    assert [(r["doc_id"], r["attempts"]) for r in run(picky)["quarantine"]] == [(2, 2)]
    got = run("recursive_character")
    assert got["quarantine"] == [] and {r["doc_id"] for r in got["chunks"]} == {1, 2, 4} and len(got["documents"]) == 4


def test_status_counts_over_a_stream_equal_their_batch_twin(spark, events, tmp_path):
    own = events.orderBy("ts").limit(600).select("user_id", "ts", "event_id", "event_type")
    parts = own.withColumn("part", F.ntile(3).over(W.orderBy("ts")))
    late = parts.where("part = 3").orderBy("ts")
    path = str(tmp_path / "in")
    for i in (1, 2):
        parts.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    late.drop("part").coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    got = run(streams.stream_status_changes(source, 60, watermark="30 minutes"), "changes", "append")
    got = got.groupBy("at", "status").agg(F.sum("delta").alias("delta")).where("delta <> 0")
    until = own.agg(F.max("ts")).first()[0] - timedelta(minutes=30)
    want = streams.status_changes(own, "60 minutes").where(F.col("at") <= F.lit(until))
    assert want.count() > 20 and sorted(map(tuple, got.select("at", "status", "delta").collect())) == sorted(map(tuple, want.select("at", "status", "delta").collect()))
    counts = {(r["at"], r["status"]): r["n"] for r in streams.status_counts(got).collect()}
    for at in sorted({a for a, _ in counts})[::7]:
        now = {r["event_type"]: r["count"] for r in own.where(F.col("ts") < F.lit(at)).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type")).groupBy("event_type").count().collect()}
        assert {s: max((a, n) for (a, s2), n in counts.items() if s2 == s and a <= at)[1] for s in {s for a, s in counts if a <= at}} == {s: now.get(s, 0) for s in {s for a, s in counts if a <= at}}


def test_progress_counts_each_run(spark, events, tmp_path):
    source = stream_of(spark, events.where("user_id < 8").select(F.col("user_id").alias("run_id"), "event_id", "event_type"), str(tmp_path / "in"), 1)
    got = run(streams.stream_progress(source), "progress", "append").collect()
    assert sorted(got, key=str) and all(1 <= r["done"] for r in got)
    assert {r["run_id"]: r["done"] for r in sorted(got, key=lambda r: r["done"])} == {r["user_id"]: r["count"] for r in events.where("user_id < 8").groupBy("user_id").count().collect()}


def test_split_at_every_place():
    for text, kinds in (("a<think>b</think>c", {"answer": "ac", "reasoning": "b"}), ("x</think>y", {"answer": "xy"}), ("p<think>q", {"answer": "p", "reasoning": "q"}), ("1 < 2 <thin", {"answer": "1 < 2 <thin"})):
        for cut in range(len(text) + 1):
            for cut2 in range(cut, len(text) + 1):
                held, thinking, orphan, got = "", False, False, {}
                pieces = [text[:cut], text[cut:cut2], text[cut2:]]
                for i, p in enumerate(pieces):
                    parts, held, thinking, orphan = streams.split_deltas(p, held, thinking, orphan, i == 2)
                    for k, t in parts:
                        got[k] = got.get(k, "") + t
                assert got == kinds and held == "" and orphan == ("x</think>" in text)


def test_stream_split(spark, tmp_path):
    r = random.Random(1)
    rows, want = [], {}
    for m in range(6):
        text = f"<think>why {m}</think>answer {m} goes on"
        want[m] = f"answer {m} goes on"
        cuts = sorted(r.sample(range(1, len(text)), 4))
        rows += [(m, i, text[a:b], i == 4) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(text)], strict=True))]
    df = spark.createDataFrame(rows, "message_id long, seq long, delta string, last boolean")
    got = run(streams.stream_split(stream_of(spark, df, str(tmp_path / "in"), 1)), "split", "append").where("kind = 'answer'").collect()
    for m, text in want.items():
        assert "".join(x["text"] for x in sorted((x for x in got if x["message_id"] == m), key=lambda x: (x["seq"], x["part"]))) == text
