import json

import pytest

from sparkrag.operators import archive, corpus
from sparkrag.plans.tables import archive_tables
from sparkrag.sources import files


def test_discovery_routes_by_suffix(spark, tmp_path):
    for name in ("b.TXT", "a.md", "sub/c.html", "d.exe", "e.zzz"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    got = files.discover(spark, str(tmp_path), ["txt", "md", "html", "zzz"]).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["bucket"]) for r in got] == [("a.md", "text_like"), ("b.TXT", "text_like"), ("e.zzz", None), ("c.html", "web")]
    assert files.discover(spark, str(tmp_path / "missing"), ["txt"]).collect() == []
    assert {r["file_name"]: r["text"] for r in files.read_corpus(spark, str(tmp_path)).collect()}["a.md"] == "x"


def test_markdown_of_a_page(spark):
    html = "<html><head><title>T &amp; U</title><script>bad()</script></head><body><nav>skip</nav><h1>Head</h1><p>One <b>two</b> &eacute;<!-- no --><p>open<h2>Sub</h2><ul><li>item</ul></body>"
    r = files.html_to_markdown(spark.createDataFrame([(1, "u", html), (2, "v", None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert r[0]["title"] == "T & U" and r[0]["markdown"] == "# Head\n\nOne two é\n\nopen\n\n## Sub\n\n- item"
    assert r[1]["markdown"] == ""


def test_golden_sets_fail_loudly(spark, tmp_path):
    good = tmp_path / "g.jsonl"
    good.write_text('{"query": "a", "relevant": [{"rel_source": "s", "chunk_index": 0, "fact": "f"}]}\n\n{"query": "a", "relevant": []}\n')
    assert files.read_golden(spark, str(good)).count() == 2
    with pytest.raises(ValueError, match="twice"):
        files.read_golden(spark, str(good), unique=True)
    (tmp_path / "bad.jsonl").write_text('{"query": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_golden(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "none.jsonl").write_text("")
    with pytest.raises(ValueError, match="no golden"):
        files.read_golden(spark, str(tmp_path / "none.jsonl"))


def test_conversation_fixtures_keep_their_rules(spark, tmp_path):
    def put(folder, turns):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "c.json").write_text(json.dumps({"name": folder, "turns": turns}))
        return str(tmp_path / folder)

    one, two = {"query": "a", "assistant": "b"}, {"query": "it?", "kind": "pronoun"}
    assert files.read_conversations(spark, put("good", [one, two])).count() == 2
    for name, turns in (("first", [two]), ("second", [one, one]), ("reply", [{"query": "a"}, two])):
        with pytest.raises(ValueError, match="rules"):
            files.read_conversations(spark, put(name, turns))


def test_versions_are_swapped_whole(spark, tmp_path):
    a, b = (spark.createDataFrame([(i,)], "x long") for i in (1, 2))
    root = str(tmp_path / "store")
    files.write_version({"chunks": a, "documents": a}, root)
    files.write_version({"chunks": b, "documents": b}, root)
    assert [r["x"] for r in files.read_version(spark, root, "chunks").collect()] == [2]
    assert spark.read.json(files.write_results(b, str(tmp_path), "eval")).count() == 1


def test_archive_round_trip_and_transcripts(spark, tmp_path):
    tables = archive_tables(lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet"))
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / name))
    back = files.read_archive(spark, str(tmp_path))
    messages = archive.load_messages(back)
    docs = archive.thread_transcripts(messages, 300).collect()
    guids = [g for d in docs for g in d["message_guids"]]
    assert len(guids) == len(set(guids)) == messages.count()
    assert all(d["text"].startswith("# ") and d["doc_key"].startswith(d["thread_id"]) for d in docs)


def test_days_are_packed_but_never_split(spark):
    rows = [(f"g{d}-{i}", "t", "T", "A", f"2024-01-{d:02d} 10:0{i}:00", "x" * 80) for d in range(1, 7) for i in range(1 if d != 3 else 9)]
    df = spark.createDataFrame(rows, "guid string, thread_id string, thread_name string, sender_name string, ts string, text string").selectExpr("* except (ts)", "timestamp(ts) as ts", "cast(array() as array<struct<kind:string,sender_name:string>>) as tapbacks")
    spans = sorted(r["span"] for r in archive.thread_transcripts(df, 250).collect())
    assert spans == ["2024-01-01..2024-01-02", "2024-01-03", "2024-01-04..2024-01-05", "2024-01-06"]


def test_numbers_are_global_and_follow_documents(spark):
    df = spark.createDataFrame([(d, p) for d in range(50) for p in range(d % 4)], "doc_id long, position int").repartition(7)
    got = corpus.number_chunks(df, 10).orderBy("doc_id", "chunk_index").collect()
    assert [r["original_index"] for r in got] == list(range(10, 10 + len(got)))
