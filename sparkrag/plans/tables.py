"""Registered queries over corpus, conversation, archive, graph and event tables, each beside the SQL that checks it."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrag.functions import text as T
from sparkrag.operators import archive, chat, chunking, corpus, evaluate, graph, ivf, telemetry
from sparkrag.operators import runs as builds
from sparkrag.plans.queries import MSG, PARA, QUERIES, SQL, STOP, WORDS, fact_refs, messages, query, r6
from sparkrag.session import scratch_dir
from sparkrag.sources import files
from sparkrag.sources.store import Change, Store
from sparkrag.streaming import streams

__all__ = ["QUERIES", "SQL"]


def paras(t) -> DataFrame:
    p = corpus.paragraphs(t("documents"))
    return p.withColumn("chunk_index", F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_index")) - 1)


# Corpus.

@query("SELECT doc_id, sha256(text) AS content_hash, length(text) AS n FROM documents")
def s2_documents_with_hash(t):
    return t("documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), F.length("text").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN source || '!' ELSE source END AS source FROM documents")
def s9_upsert(t):
    d = t("documents").select("doc_id", "source")
    new = d.where("doc_id % 10 <= 2").withColumn("source", F.when(F.col("doc_id") % 10 == 2, F.concat("source", F.lit("!"))).otherwise(F.col("source")))
    return files.upsert(d.where("doc_id % 10 <> 1"), new, ["doc_id"])


@query(r"SELECT doc_id, length(regexp_replace(text, '[\s\x{0B}\x{85}\p{Z}]', '', 'g')) >= 50 AS has_text FROM documents")
def f1_has_text(t):
    return t("documents").select("doc_id", T.has_text(F.col("text")).alias("has_text"))


@query("SELECT doc_id, sum(n) < 400 OR count(*) FILTER (n = 0) / count(*) >= 0.2 AS needs_ocr FROM (SELECT doc_id, CASE WHEN l LIKE 'T%' THEN 0 ELSE length(l) END AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) GROUP BY doc_id")
def f2_needs_ocr(t):
    pages = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).withColumn("n_chars", F.when(F.col("l").startswith("T"), 0).otherwise(F.length("l")))
    return corpus.needs_ocr(pages, 400)


@query("SELECT event_id, coalesce(json_extract_string(props, '$.' || 'page'), 'none') AS page FROM events")
def f3_json_field(t):
    return t("events").select("event_id", corpus.json_field(F.col("props"), "page", "none").alias("page"))


@query("SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-20'")
def f4_since(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return archive.bound(e, None, "2024-01-20").select("event_id", "user_id")


@query(f"WITH {PARA} SELECT doc_id, chunk_index, content FROM para WHERE doc_id = 7")
def f5_document_chunks(t):
    return corpus.document_chunks(paras(t), 7).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content")


@query("SELECT doc_id, length(text) // 4 AS n_tokens FROM documents WHERE length(text) // 4 >= 480")
def f6_near_ceiling(t):
    return corpus.near_ceiling(t("documents").select("doc_id", T.count_tokens(F.col("text")).cast("long").alias("n_tokens")))


@query("SELECT g AS item, count(*) AS refs FROM (SELECT item_id // 4 AS g, (item_id // 2) % 3 AS s FROM benchmark) GROUP BY g HAVING bool_and(s IN (0, 1))")
def f8_entries_within(t):
    ref = F.struct((F.expr("item_id div 2") % 3).cast("string").alias("rel_source"))
    g = t("benchmark").groupBy(F.expr("item_id div 4").alias("item")).agg(F.collect_list(ref).alias("relevant"))
    return evaluate.entries_within(g, ["0", "1"]).select("item", F.size("relevant").cast("long").alias("refs"))


OUTCOME = r"CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'skipped' WHEN length(regexp_replace(text, '[\s\x{0B}\x{85}\p{Z}]', '', 'g')) < 50 THEN 'no_text' ELSE 'ingested' END"


def outcomes(t) -> DataFrame:
    d = t("documents").select("doc_id", "text", T.content_hash(F.col("text")).alias("content_hash"))
    stored = d.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("content_hash")).otherwise("old").alias("content_hash"))
    return corpus.classify_incoming(d, stored)


@query(f"SELECT doc_id, {OUTCOME} AS outcome FROM documents")
def j2_incremental_skip(t):
    return outcomes(t).select("doc_id", "outcome")


@query(f"SELECT count(*) FILTER (o = 'ingested') AS ingested, count(*) FILTER (o = 'skipped') AS skipped, count(*) FILTER (o = 'no_text') AS no_text, 0 AS unsupported, 0 AS failed, CAST(sum(CASE WHEN o = 'ingested' THEN n_chars // 400 ELSE 0 END) AS BIGINT) AS n_chunks FROM (SELECT *, {OUTCOME} AS o FROM documents)")
def a3_ingest_summary(t):
    d = outcomes(t).join(t("documents").select("doc_id", "n_chars"), "doc_id")
    return corpus.ingest_summary(d.withColumn("n_chunks", F.when(F.col("outcome") == "ingested", F.floor(F.col("n_chars") / 400)).otherwise(0)))


@query("SELECT d.doc_id, d.source, coalesce(string_agg(CAST(quality AS VARCHAR) || ':' || n, ',' ORDER BY quality), '') AS extraction FROM documents d LEFT JOIN (SELECT doc_id, quality, count(*) AS n FROM labels GROUP BY ALL) USING (doc_id) GROUP BY ALL")
def j3_a2_list_documents(t):
    d = t("documents").select("doc_id", "source", F.col("n_chars").alias("ingested_at"))
    listed = corpus.list_documents(d, t("labels").select("doc_id", F.col("quality").cast("string").alias("extraction")))
    return listed.select("doc_id", "source", F.array_join(F.transform(F.array_sort(F.map_entries("extraction")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("extraction"))


@query("SELECT 'documents' AS gauge, NULL AS label, count(*) AS value FROM documents UNION ALL SELECT 'documents_by_file_type', lang, count(*) FROM documents GROUP BY lang UNION ALL SELECT 'chunks', NULL, count(*) FROM labels UNION ALL SELECT 'chunks_by_chunking_strategy', CAST(quality AS VARCHAR), count(*) FROM labels GROUP BY quality")
def a1_corpus_gauges(t):
    return corpus.corpus_gauges(t("documents").withColumnRenamed("lang", "file_type"), t("labels").select(F.col("quality").cast("string").alias("chunking_strategy")))


@query(r"""WITH p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', ''), '/') AS parts, length(html) AS n FROM pages),
 f AS (SELECT array_to_string(parts[1:i], '/') AS folder, n, page_id FROM p, range(0, 20) r(i) WHERE i < len(parts))
 SELECT folder, count(*) AS documents, CAST(sum(n) AS BIGINT) AS chunks, max(page_id) AS latest FROM f GROUP BY folder""")
def a20_folder_rollup(t):
    p = t("pages").select(T.relative_path(F.col("url")).alias("relative_path"), F.length("html").cast("long").alias("n_chunks"), F.col("page_id").alias("ingested_at"))
    return corpus.folder_rollup(p)


@query(f"WITH {PARA} SELECT doc_id, chunk_index, 100 + row_number() OVER (ORDER BY doc_id, chunk_index) - 1 AS original_index FROM para")
def w2_number_chunks(t):
    p = corpus.paragraphs(t("documents")).withColumnRenamed("chunk_index", "position")
    return corpus.number_chunks(p, 100).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "original_index")


V1 = "v1 AS (SELECT doc_id AS doc_key, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0), v2 AS (SELECT doc_id AS doc_key, sha256(CASE WHEN doc_id % 10 = 2 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 1)"
STATES = "st AS (SELECT coalesce(v1.doc_key, v2.doc_key) AS doc_key, CASE WHEN v1.doc_key IS NULL THEN 'new' WHEN v2.doc_key IS NULL THEN 'removed' WHEN v1.h = v2.h THEN 'unchanged' ELSE 'changed' END AS state FROM v1 FULL JOIN v2 ON v1.doc_key = v2.doc_key)"


def versions(t) -> tuple[DataFrame, DataFrame]:
    d = t("documents")
    text = F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    one = d.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("doc_key"), F.sha2("text", 256).alias("content_sha256"))
    return one, d.where("doc_id % 10 <> 1").select(F.col("doc_id").alias("doc_key"), F.sha2(text, 256).alias("content_sha256"))


@query(f"WITH {V1}, {STATES} SELECT doc_key, state FROM st")
def d2_snapshot_diff(t):
    return corpus.diff(*versions(t))


@query(f"WITH {V1} SELECT doc_key, h AS content_sha256 FROM v2 WHERE doc_key % 7 <> 3 AND doc_key % 10 <> 2 UNION ALL SELECT doc_key, h FROM v1 WHERE doc_key % 7 <> 3 AND (doc_key % 10 = 2 OR doc_key % 10 = 1)")
def d4_merge_manifest(t):
    old, new = versions(t)
    keys = t("documents").select(F.col("doc_id").alias("doc_key"))
    return corpus.merge_manifest(old, new, False, keys.where("doc_key % 10 = 2"), keys.where("doc_key % 7 = 3"))


@query(f"WITH {V1}, {STATES} SELECT doc_key, 'pending' AS work FROM st WHERE state IN ('new', 'changed') UNION ALL SELECT doc_key, 'stale' FROM st WHERE state IN ('changed', 'removed')")
def d5_work_list(t):
    return corpus.plan_build(corpus.diff(*versions(t)), True)


@query("SELECT o_custkey AS doc_key FROM (SELECT o_custkey, bool_and(o_orderkey % 3 <> 0) AS ok FROM orders GROUP BY o_custkey) WHERE ok")
def d3_respanned(t):
    o = t("orders")
    gone = o.groupBy(F.col("o_custkey").alias("doc_key")).agg(F.collect_list("o_orderkey").alias("message_guids"))
    there = o.where("o_orderkey % 3 <> 0").groupBy("o_orderdate").agg(F.collect_list("o_orderkey").alias("message_guids"))
    return corpus.respanned(gone, there)


@query("SELECT 'document' AS kind, doc_id FROM documents WHERE doc_id % 9 <> 4 UNION ALL SELECT 'chunk', doc_id FROM labels WHERE doc_id % 9 <> 4 UNION ALL SELECT DISTINCT 'missing', doc_id + 1000000 FROM documents WHERE doc_id % 9 = 5")
def d6_bulk_delete(t):
    d = t("documents").select("doc_id")
    ids = d.where("doc_id % 9 = 4").union(d.where("doc_id % 9 = 5").select(F.col("doc_id") + 1000000))
    docs, chunks, missing = corpus.delete_documents(d, t("labels").select("doc_id"), ids)
    one = lambda df, k: df.select(F.lit(k).alias("kind"), "doc_id")
    return one(docs, "document").union(one(chunks, "chunk")).union(one(missing, "missing"))


@query("SELECT b.item_id % 5 || '::' || b.item_id AS id, b.item_id AS query_id FROM benchmark b")
def j10_resolve_golden(t):
    g = t("benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("s"), (F.col("item_id") % 5)).alias("rel_source"), F.col("item_id").alias("chunk_index"))
    docs = g.select(F.col("rel_source").alias("source"), F.substring("rel_source", 2, 9).alias("doc_id")).distinct()
    return evaluate.resolve_golden(g, docs)


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 1 OR (doc_id % 4 <> 1 AND doc_id % 100 >= n_chars // 100)")
def j11_golden_drift(t):
    d = t("documents")
    golden = d.select("doc_id", F.col("doc_id").alias("rel_source"), (F.col("doc_id") % 100).alias("chunk_index"))
    stored = d.where("doc_id % 4 <> 1").select(F.col("doc_id").alias("source"), F.floor(F.col("n_chars") / 100).alias("n_chunks"))
    return evaluate.unresolvable(golden, stored).select("doc_id")


@query(f"""WITH {PARA}, w AS (SELECT doc_id, chunk_index, {WORDS.format('content')} AS w FROM para),
 p AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w),
 g AS (SELECT DISTINCT doc_id, chunk_index, len(w) AS nw, CASE WHEN k = 1 THEN w[i] ELSE array_to_string(w[i:i + 2], ' ') END AS gram, k FROM p, (VALUES (1), (3)) v(k) WHERE i <= CASE WHEN k = 1 THEN len(w) ELSE greatest(len(w) - 2, 1) END),
 c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, chunk_index) AS n FROM (SELECT doc_id, chunk_index, gram FROM g WHERE k = CASE WHEN nw < 8 THEN 1 ELSE 3 END)),
 m AS (SELECT c.doc_id, c.chunk_index, p.chunk_index AS page, round(count(*) / any_value(n), 6) AS coverage FROM c JOIN (SELECT DISTINCT doc_id, chunk_index, gram FROM g) p USING (doc_id, gram) GROUP BY ALL)
 SELECT doc_id || '::' || chunk_index AS chunk_id, page, coverage FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY coverage DESC, page) AS nth FROM m) WHERE nth = 1 AND coverage >= 0.3""")
def j14_locate(t):
    p = paras(t).withColumn("chunk_index", F.col("chunk_index").cast("long"))
    chunks = p.withColumn("chunk_id", T.chunk_id(F.col("doc_id").cast("string"), F.col("chunk_index")))
    return corpus.locate(chunks, p.withColumnRenamed("chunk_index", "page")).withColumn("coverage", r6("coverage"))


# Conversations.

@query("SELECT conv_id AS conversation_id, n AS n_messages, last_at FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (SELECT conv_id, count(*) AS n, max(turn) AS last_at FROM conversations GROUP BY conv_id) USING (conv_id)")
def j4_list_conversations(t):
    m = messages(t)
    return chat.list_conversations(m.select("conversation_id").distinct(), m.withColumn("created_at", F.col("turn")))


@query("SELECT conv_id * 100 + turn AS message_id, CASE WHEN role = 'assistant' THEN '1:c' || turn || ',2:c' || conv_id ELSE '' END AS sources FROM conversations")
def j5_transcript(t):
    m = messages(t).withColumn("message_id", F.col("conversation_id") * 100 + F.col("turn")).withColumn("created_at", F.col("turn"))
    s = m.where("role = 'assistant'").select("message_id", F.posexplode(F.array(F.concat(F.lit("c"), "turn"), F.concat(F.lit("c"), "conversation_id"))).alias("rank", "chunk_id")).withColumn("rank", F.col("rank") + 1)
    return chat.transcript(m, s).select("message_id", F.array_join(F.transform("sources", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["chunk_id"])), ",").alias("sources"))


@query("SELECT CASE WHEN c % 7 < 5 THEN c % 7 END AS group_id, CASE WHEN c % 7 < 5 THEN 'g' || c % 7 END AS name, c AS conversation_id FROM (SELECT DISTINCT conv_id AS c FROM conversations) UNION ALL SELECT 99, 'empty', NULL")
def j17_group_conversations(t):
    c = messages(t).select("conversation_id").distinct().withColumn("group_id", F.col("conversation_id") % 7)
    g = c.where("group_id < 5").select("group_id").distinct().select("group_id", F.concat(F.lit("g"), "group_id").alias("name"), F.col("group_id").alias("created_at"))
    g = g.union(g.sparkSession.range(1).select(F.lit(99).cast("long"), F.lit("empty"), F.lit(9).cast("long")))
    return chat.group_conversations(g, c)


@query(f"WITH {MSG} SELECT conversation_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS n FROM msg) WHERE n <= 3")
def w3_recent_turns(t):
    return chat.recent_turns(messages(t), 3).select("conversation_id", "turn", "role")


@query(f"WITH {MSG} SELECT conversation_id, turn, coalesce(string_agg(role || ':' || content, '|') OVER (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS history FROM msg")
def w4_history(t):
    h = chat.with_history(messages(t), 2)
    return h.select("conversation_id", "turn", F.array_join(F.transform("history", lambda x: F.concat_ws(":", x["role"], x["content"])), "|").alias("history"))


@query(f"WITH {MSG} SELECT conversation_id, turn, content AS search_query, content AS original_query FROM msg WHERE role = 'user'")
def q1_simple(t):
    return chat.prepare(messages(t), "simple")


@query(f"""WITH {MSG}, u AS (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS before FROM msg)
 SELECT conversation_id, turn, CASE WHEN before = 0 OR length(content) > 505 THEN content ELSE 'about ' || content END AS search_query, content AS original_query FROM u WHERE role = 'user'""")
def q2_condense_with_rewrites(t):
    m = messages(t)
    return chat.prepare(m, "condense", m.select("conversation_id", "turn", F.concat(F.lit("about "), F.when(F.length("content") > 505, F.repeat("content", 3)).otherwise(F.col("content"))).alias("rewrite")))


@query(f"""WITH {MSG}, e AS (SELECT *, sum(length(content) + 2) OVER (PARTITION BY conversation_id ORDER BY turn) - 2 AS fin FROM msg),
 o AS (SELECT *, sum(CASE WHEN fin > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY turn) AS n_over, 300 - (fin - length(content)) AS room FROM e),
 b AS (SELECT conversation_id, turn, CASE WHEN fin <= 300 THEN content WHEN n_over = 1 AND room > 4 THEN rtrim(substr(content, 1, CAST(room - 4 AS BIGINT))) || ' […]' END AS block FROM o)
 SELECT conversation_id, string_agg(block, chr(10) || chr(10) ORDER BY turn) AS context FROM b WHERE block IS NOT NULL GROUP BY conversation_id""")
def w9_pack_context(t):
    return chat.pack_context(messages(t), 300)


@query("""WITH m AS (SELECT conv_id * 100 + turn AS message_id, text FROM conversations), s AS (SELECT message_id, 1 AS rank, 'chunk' AS kind, 'c' || chr(10) || text AS source FROM m UNION ALL SELECT message_id, 1, 'graph', 'k' || chr(10) || 'x' FROM m)
 SELECT message_id, row_number() OVER (PARTITION BY message_id ORDER BY kind, rank) AS rank, kind, source FROM s""")
def r11_evidence_snapshot(t):
    m = messages(t).select((F.col("conversation_id") * 100 + F.col("turn")).alias("message_id"), F.lit(1).alias("rank"), F.lit("c").alias("chunk_id"), "content", F.lit(0.5).alias("score"))
    ex = m.select("message_id", "rank", F.lit("k").alias("doc_key"), F.lit("x").alias("text"))
    frozen = F.from_json("source", "chunk_id string, content string, score double, doc_key string, text string")
    thawed = chat.snapshot_sources(m, ex).withColumn("s", frozen)
    return thawed.select("message_id", "rank", "kind", F.concat_ws("\n", "s.chunk_id", "s.content", "s.doc_key", "s.text").alias("source"))


@query(r"""WITH m AS (SELECT conv_id AS conversation_id, turn, role, text AS content FROM conversations),
 u AS (SELECT *, count(*) FILTER (role = 'user') OVER w AS before, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER w AS said FROM m WINDOW w AS (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
 v AS (SELECT *, {words} AS w, coalesce(array_to_string(list_transform(list_sort(list_transform(list_distinct(list_filter(regexp_split_to_array(lower(said), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 3 AND x NOT IN {stop})), lambda x: {{'n': -length(x), 't': x}}))[1:5], lambda x: x.t), ' '), '') AS more FROM u)
 SELECT conversation_id, turn, CASE WHEN before > 0 AND (len(w) <= 6 OR w[1] IN {pronouns}) AND length(trim(content || ' ' || more, ' ')) <= 512 THEN trim(content || ' ' || more, ' ') ELSE content END AS search_query, content AS original_query FROM v WHERE role = 'user'""".format(words=WORDS.format("content"), stop=STOP, pronouns="(" + ", ".join(f"'{p}'" for p in chat.PRONOUNS) + ")"))
def q2_condense_by_default(t):
    return chat.prepare(messages(t), "condense")


@query("""WITH r AS (SELECT CASE WHEN turn = 1 THEN NULL WHEN turn % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, (length(text) % 5) / 4.0 AS recall, CASE WHEN turn % 3 = 0 THEN NULL ELSE length(text) END AS latency FROM conversations),
 s AS (SELECT 'all' AS slice, * FROM r UNION ALL SELECT 'follow_up', * FROM r WHERE kind IS NOT NULL UNION ALL SELECT 'kind:' || kind, * FROM r WHERE kind IS NOT NULL)
 SELECT slice, count(*) AS turns, round(avg(recall), 6) AS recall, round(avg(CASE WHEN recall = 1 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, round(avg(latency), 6) AS mean_latency, max(latency) AS max_latency FROM s GROUP BY slice""")
def a9_turn_summary(t):
    kind = F.when(F.col("turn") == 1, None).when(F.col("turn") % 2 == 0, "even").otherwise("odd")
    r = t("conversations").select(kind.alias("kind"), (F.length("text") % 5 / 4).alias("recall"), F.when(F.col("turn") % 3 != 0, F.length("text").cast("long")).alias("latency"))
    s = evaluate.summarize_turns(r)
    return s.select("slice", "turns", *[r6(c).alias(c) for c in ("recall", "pass_rate", "mean_latency")], "max_latency")


# Archive.

ARCHIVE_SQL = "m AS (SELECT conv_id, turn, role, text, 'm' || conv_id || '-' || turn AS guid, TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS ts FROM conversations)"


def archive_tables(t) -> dict[str, DataFrame]:
    """The five tables, derived from conversations: a chat each, a handle for each role in it, a message for each turn."""
    c = t("conversations")
    handle = F.col("conv_id") * 10 + F.length("role") % 10
    seconds = F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) - 978307200 + F.col("conv_id") * 3600 + F.col("turn") * 60
    date = F.when(F.col("conv_id") % 2 == 0, seconds).otherwise(seconds * 1_000_000_000)
    m = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("ROWID"), F.concat(F.lit("m"), "conv_id", F.lit("-"), "turn").alias("guid"), "text", date.alias("date"), (F.col("role") == "assistant").cast("int").alias("is_from_me"), handle.alias("handle_id"),
                 F.lit(0).alias("associated_message_type"), F.lit(None).cast("string").alias("associated_message_guid"), F.col("conv_id").alias("_chat"))
    ids = c.select(handle.alias("ROWID"), F.concat("role", F.lit("@"), "conv_id").alias("id"), F.col("conv_id").alias("_chat")).distinct()
    chats = c.select(F.col("conv_id").alias("ROWID"), F.concat(F.lit("chat"), "conv_id").alias("guid"), F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Room "), "conv_id")).alias("display_name")).distinct()
    link = m.select(F.col("_chat").alias("chat_id"), F.col("ROWID").alias("message_id"))
    twice = link.where("chat_id % 5 = 0").select((F.col("chat_id") + 1).alias("chat_id"), "message_id").join(chats.select(F.col("ROWID").alias("chat_id")), "chat_id")
    return {"message": m.drop("_chat"), "handle": ids.select("ROWID", "id"), "chat": chats, "chat_handle_join": ids.select(F.col("_chat").alias("chat_id"), F.col("ROWID").alias("handle_id")), "chat_message_join": link.unionByName(twice)}


NAMES = "names AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'Room ' || conv_id ELSE string_agg(DISTINCT role || '@' || conv_id, ', ' ORDER BY role || '@' || conv_id) END AS thread_name FROM conversations GROUP BY conv_id)"


@query(f"WITH {NAMES} SELECT 'chat' || conv_id AS thread_id, thread_name FROM names")
def j7_thread_names(t):
    return archive.thread_names(archive_tables(t)).select("thread_id", "thread_name")


@query(f"WITH {ARCHIVE_SQL}, {NAMES} SELECT guid, 'chat' || m.conv_id AS thread_id, thread_name, CASE WHEN role = 'assistant' THEN 'Me' WHEN role = 'user' THEN 'Friend ' || m.conv_id ELSE role || '@' || m.conv_id END AS sender_name, epoch_us(ts) AS us, text FROM m JOIN names ON names.conv_id = m.conv_id WHERE trim(text, ' ') <> ''")
def j6_g1_decode_messages(t):
    a = archive_tables(t)
    contacts = a["handle"].where("id like 'user@%'").select(F.col("id").alias("handle"), F.concat(F.lit("Friend "), F.substring_index("id", "@", -1)).alias("name"))
    d = archive.decode_messages(a, contacts)
    return d.select("guid", "thread_id", "thread_name", "sender_name", F.unix_micros("ts").alias("us"), "text")


NET = f"net AS (SELECT o_custkey AS guid, l_suppkey AS sender_name, ['loved', 'liked', 'disliked', 'laughed', 'emphasized', 'questioned'][CAST(l_partkey % 8 AS INT) + 1] AS kind, sum(CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END) AS net FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 8 <= 5 GROUP BY ALL HAVING sum(CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END) > 0)"


@query(f"WITH {NET} SELECT CAST(c_custkey AS VARCHAR) AS guid, coalesce(string_agg(kind || ':' || sender_name, ',' ORDER BY kind, CAST(sender_name AS VARCHAR)), '') AS tapbacks FROM customer LEFT JOIN net ON guid = c_custkey GROUP BY c_custkey")
def a6_fold_tapbacks(t):
    code = F.expr("CASE WHEN l_linenumber % 3 = 0 THEN 3000 ELSE 2000 END + l_partkey % 8")
    r = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("bp:"), "o_custkey").alias("target"), F.col("l_suppkey").cast("string").alias("sender_name"), code.alias("code"))
    m = t("customer").select(F.col("c_custkey").cast("string").alias("guid"))
    return archive.fold_tapbacks(r, m).select("guid", F.array_join(F.transform("tapbacks", lambda x: F.concat_ws(":", x["kind"], x["sender_name"])), ",").alias("tapbacks"))


@query("SELECT event_id AS guid, CASE WHEN event_id < 6000 THEN 0 ELSE 1 END AS batch FROM events WHERE event_id < 6000 OR event_id >= 4000")
def d1_merge_batches(t):
    e = t("events").select(F.col("event_id").alias("guid"), "ts")
    return archive.merge_batches([e.where("guid < 6000").withColumn("batch", F.lit(0)), e.where("guid >= 4000").withColumn("batch", F.lit(1))]).select("guid", "batch")


@query("SELECT count(*) AS messages, count(DISTINCT user_id) AS threads, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events")
def a4_parse_summary(t):
    s = archive.parse_summary(t("events").withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("user_id", "thread_id"))
    return s.select("messages", "threads", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"))


@query("SELECT event_id AS guid FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-05' ORDER BY ts DESC, event_id DESC LIMIT 100")
def t4_newest(t):
    e = t("events").select(F.col("event_id").alias("guid"), F.col("ts").cast("timestamp").alias("ts"))
    return archive.bound(e, 100, "2024-01-05").select("guid")


@query(f"WITH {ARCHIVE_SQL} SELECT guid, '[' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || role || ': ' || text AS line FROM m")
def g3_transcript_lines(t):
    a = archive.decode_messages(archive_tables(t), None, "assistant")
    a = a.withColumn("sender_name", F.substring_index("sender_name", "@", 1)).withColumn("tapbacks", F.array().cast("array<struct<kind:string,sender_name:string>>"))
    return a.select("guid", archive.render_lines().alias("line"))


@query(f"""WITH {ARCHIVE_SQL}, {NAMES}, l AS (SELECT *, CASE WHEN role = 'assistant' THEN 'Me' ELSE role || '@' || m.conv_id END AS sender FROM m JOIN names USING (conv_id) WHERE trim(text, ' ') <> ''),
 d AS (SELECT 'chat' || conv_id AS thread_id, any_value(thread_name) AS thread_name, strftime(min(ts), '%Y-%m-%d') AS span, count(*) AS messages, string_agg(DISTINCT sender, ', ' ORDER BY sender) AS people,
   string_agg('[' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || sender || ': ' || text, chr(10) ORDER BY ts) AS lines, string_agg(guid, ',' ORDER BY ts) AS guids FROM l GROUP BY conv_id)
 SELECT thread_id || '::' || span AS doc_key, thread_id, thread_name, span, messages, guids, sha256('# ' || thread_name || ' (' || span || ')' || chr(10) || 'Participants: ' || people || chr(10) || chr(10) || lines) AS content_sha256 FROM d""")
def g4_thread_transcripts(t):
    docs = archive.thread_transcripts(archive.load_messages(archive_tables(t), ordered=False))
    return docs.select("doc_key", "thread_id", "thread_name", "span", F.size("message_guids").cast("long").alias("messages"), F.array_join("message_guids", ",").alias("guids"), "content_sha256")


@query(f"""WITH {ARCHIVE_SQL}, d AS (SELECT conv_id, 'chat' || conv_id || '::' || strftime(min(ts), '%Y-%m-%d') AS doc_key, count(*) AS n FROM m WHERE trim(text, ' ') <> '' GROUP BY conv_id)
 SELECT doc_key, CASE WHEN conv_id % 4 = 0 THEN 'first' WHEN conv_id % 4 = 3 THEN 'both' ELSE 'second' END AS seen, n AS messages FROM d""")
def g5_incremental_build(t):
    """Two builds over overlapping batches: what each contributed, and the manifest after both."""
    every = archive.load_messages(archive_tables(t), ordered=False).withColumn("_c", F.substring("thread_id", 5, 20).cast("long") % 4)
    one, two = every.where("_c in (0, 3)").drop("_c"), every.where("_c <> 0").drop("_c")
    first, _ = builds.build_graph([one], builds.empty_state(every.sparkSession), whole=False)
    second, _ = builds.build_graph([one, two], first)
    was = first["manifest"].select("doc_key", F.lit(1).alias("was"))
    again = two.select("thread_id").distinct().withColumn("again", F.lit(1))
    out = second["manifest"].join(was, "doc_key", "left").join(again, "thread_id", "left")
    seen = F.when(F.col("was").isNull(), "second").when(F.col("again").isNull(), "first").otherwise("both")
    return out.select("doc_key", seen.alias("seen"), F.size("message_guids").cast("long").alias("messages"))


PEOPLE = "['Ada', 'Bob', 'Cy', 'Di', 'Ed', 'Flo', 'Gus']"


@query(f"WITH d AS (SELECT {PEOPLE}[1 + o_custkey % 5] || ' Lee' AS a, {PEOPLE}[1 + o_orderkey % 7] || ' Ray' AS b FROM orders) SELECT least(a, b) AS source, greatest(a, b) AS target, count(*) AS weight FROM d GROUP BY ALL")
def g6_merge_relations(t):
    name = lambda c, n, last: F.concat(F.get(F.expr(PEOPLE.replace("[", "array(").replace("]", ")")), (F.col(c) % n).cast("int")), F.lit(last))
    docs = t("orders").select(F.col("o_orderkey").alias("doc_key"), F.concat(F.lit("then "), name("o_orderkey", 7, " Ray"), F.lit(" met "), name("o_custkey", 5, " Lee"), F.lit(" there")).alias("text"), F.lit(None).cast("string").alias("thread_name"))
    return graph.merge_relations(graph.extract(docs)[1].where("source is not null")).select("source", "target", "weight")


@query("SELECT count(DISTINCT o_orderkey % 5000) AS n FROM orders")
def a5_distinct_guids(t):
    m = t("orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey") % 5000).alias("message_guids"))
    return m.select(F.explode("message_guids").alias("guid")).agg(F.count_distinct("guid").alias("n"))


@query("SELECT count(*) FILTER (event_id < 6000) AS messages_before, count(*) AS messages_after, count(*) FILTER (event_id >= 6000) AS new_messages, count(*) FILTER (event_id BETWEEN 4000 AND 5999) AS duplicates FROM events")
def a25_build_report(t):
    e = t("events").select(F.col("event_id").alias("guid"))
    return evaluate.build_report(e.where("guid < 6000"), e, e.where("guid >= 4000"))


# Graph: customers and nations.

def customer_graph(t) -> tuple[DataFrame, DataFrame]:
    c = t("customer")
    nodes = c.select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.concat(F.lit(" "), "c_mktsegment").alias("entity_type"), F.col("c_custkey").alias("ordinal"))
    nodes = nodes.union(t("nation").select(F.concat(F.lit("n"), "n_nationkey"), F.lit(""), F.col("n_nationkey")))
    edges = c.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"), F.col("c_custkey").alias("ordinal"))
    return nodes, edges


EDGES = "edges AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer)"


@query(f"WITH {EDGES} SELECT source, target FROM edges WHERE CAST(substr(target, 2) AS INT) % 2 = 0")
def j16_clean_graph(t):
    nodes, edges = customer_graph(t)
    dirty = edges.union(edges).union(edges.select("source", F.col("source"), "ordinal"))
    kept = nodes.where("name like 'c%' or int(substr(name, 2)) % 2 = 0")
    return graph.clean_graph(kept.union(kept), dirty)[1].select("source", "target")


@query(f"WITH {EDGES} SELECT name, count(*) AS degree FROM (SELECT source AS name FROM edges UNION ALL SELECT target FROM edges) GROUP BY name")
def a21_degrees(t):
    return graph.degrees(customer_graph(t)[1])


@query("SELECT lower(c_mktsegment) AS entity_type, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'untyped', count(*) FROM nation")
def a22_e19_legend(t):
    return graph.type_legend(customer_graph(t)[0])


@query(f"WITH {EDGES}, d AS (SELECT name, count(*) AS degree FROM (SELECT source AS name FROM edges UNION ALL SELECT target FROM edges) GROUP BY name) SELECT name, degree, true AS truncated FROM d ORDER BY degree DESC, name LIMIT 20")
def t5_g8_capped_slice(t):
    kept, _, cut = graph.cap_nodes(*customer_graph(t), 20)
    return kept.select("name", "degree", F.lit(cut).alias("truncated"))


@query(f"WITH {EDGES} SELECT 'n3' AS name, 0 AS hops UNION ALL SELECT source, 1 FROM edges WHERE target = 'n3'")
def g9_neighbourhood(t):
    return graph.neighbourhood(customer_graph(t)[1], "n3", 2).select("name", "hops")


@query(f"WITH {EDGES}, d AS (SELECT name, count(*) AS degree FROM (SELECT source AS name FROM edges UNION ALL SELECT target FROM edges) GROUP BY name), h AS (SELECT DISTINCT source AS name FROM edges WHERE target = 'n3')"
       " SELECT name, 0 AS hops, degree, true AS truncated FROM d WHERE name = 'n3' UNION ALL SELECT * FROM (SELECT name, 1, degree, true FROM h JOIN d USING (name) ORDER BY degree DESC, name LIMIT 4)")
def g9_capped_neighbourhood(t):
    nodes, cut = graph.expand(customer_graph(t)[1], "n3", 2, 5)
    return nodes.select("name", "hops", "degree", F.lit(cut).alias("truncated"))


NAMED = "SELECT 'c' || c_custkey AS name, c_custkey AS ordinal FROM customer UNION ALL SELECT p_name, 1000000 + p_partkey FROM part"


@query(f"SELECT * FROM (SELECT ordinal, CASE WHEN starts_with(lower(name), 'c1') THEN 0 ELSE 1 END AS tier FROM ({NAMED}) WHERE contains(lower(name), 'c1') ORDER BY tier, ordinal LIMIT 8) UNION ALL SELECT * FROM (SELECT ordinal, CASE WHEN starts_with(lower(name), 'bolt') THEN 0 ELSE 1 END AS tier FROM ({NAMED}) WHERE contains(lower(name), 'bolt') ORDER BY tier, ordinal LIMIT 8)")
def t6_search_names(t):
    nodes = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.col("c_custkey").alias("ordinal")).union(t("part").select("p_name", F.col("p_partkey") + 1000000))
    return graph.search_entities(nodes, "C1").select("ordinal", "tier").union(graph.search_entities(nodes, "Bolt").select("ordinal", "tier"))


@query("SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target, 'c' || c_custkey || ' -> ' || 'n' || c_nationkey || ': ' || c_mktsegment AS fact FROM customer WHERE c_custkey % 3 <> 0")
def f7_facts(t):
    c = t("customer")
    r = c.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"), F.when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).alias("description"), F.when(F.col("c_custkey") % 3 == 2, F.col("c_mktsegment")).alias("label"))
    return graph.facts(r)


@query("SELECT o_custkey AS doc_key, min(o_orderkey) AS ordinal, coalesce(arg_min('n' || o_orderkey, o_orderkey) FILTER (o_orderkey % 2 = 0), 't') AS thread_name FROM orders GROUP BY o_custkey")
def d7_dedupe_excerpts(t):
    e = t("orders").select(F.col("o_custkey").alias("doc_key"), F.col("o_orderkey").alias("ordinal"), F.lit("t").alias("thread_id"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("n"), "o_orderkey")).otherwise(F.lit("t")).alias("thread_name"))
    return graph.dedupe_excerpts(e).select("doc_key", "ordinal", "thread_name")


@query("SELECT c_custkey AS question, 'a' || c_custkey || ',b' || c_custkey || ',x' AS guids FROM customer")
def j12_provenance(t):
    c = t("customer")
    k = F.concat(F.lit("t"), F.col("c_custkey"))
    one = F.concat(k, F.lit("::2024-01-01"))
    manifest = c.select(one.alias("doc_key"), F.array(F.lit("short")).alias("message_guids")).union(c.select(F.concat(one, F.lit("..2024-01-03")), F.array(F.concat(F.lit("a"), "c_custkey"), F.concat(F.lit("b"), "c_custkey"))))
    manifest = manifest.union(c.sparkSession.range(1).select(F.lit("all::day"), F.array(F.lit("x"))))
    cites = c.select(F.col("c_custkey").alias("question"), F.lit(0).alias("ordinal"), F.concat(F.lit("see "), one, F.lit("..2024-01-03 and all::day")).alias("citation"))
    return graph.provenance(cites, manifest).select("question", F.array_join("guids", ",").alias("guids"))


@query(r"""SELECT page_id AS citation_id, 1 + page_id % 2 AS tier FROM pages""")
def j13_match_citations(t):
    p = t("pages").select("page_id", F.concat(F.lit("site/"), "page_id", F.lit("/file"), "page_id", F.lit(".html")).alias("source"))
    cites = p.select(F.col("page_id").alias("citation_id"), F.when(F.col("page_id") % 2 == 0, F.upper("source")).otherwise(F.concat("page_id", F.lit("/FILE"), "page_id", F.lit(".html"))).alias("cited"))
    return graph.match_citations(cites, p.withColumn("rank", F.lit(1))).select("citation_id", F.col("tier").cast("long").alias("tier"))


@query("SELECT (SELECT count(*) FROM customer) AS entities, NULL::BIGINT AS relations, (SELECT count(DISTINCT o_custkey) FROM orders) AS documents, (SELECT count(*) FROM orders) AS messages")
def a23_graph_stats(t):
    m = t("orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("message_guids"))
    return graph.graph_stats(t("customer"), None, m)


def mentions(t) -> DataFrame:
    return t("orders").select(F.concat(F.lit("d"), F.col("o_orderkey") % 50).alias("doc_key"), F.concat(F.lit("e"), F.col("o_custkey") % 20).alias("name"), F.when(F.col("o_orderkey") % 3 == 0, "a").otherwise("b").alias("entity_type"))


@query("""WITH m AS (SELECT 'd' || o_orderkey % 50 AS doc_key, 'e' || o_custkey % 20 AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS entity_type FROM orders WHERE o_orderkey % 50 >= 5)
 SELECT name, arg_min(entity_type, (-n, entity_type)) AS entity_type, any_value(docs) AS n_documents FROM (SELECT name, entity_type, count(*) AS n FROM m GROUP BY ALL) JOIN (SELECT name, count(DISTINCT doc_key) AS docs FROM m GROUP BY name) USING (name) GROUP BY name""".replace("arg_min(entity_type, (-n, entity_type))", "first(entity_type ORDER BY n DESC, entity_type)"))
def g7_merge_and_retract(t):
    gone = t("orders").where("o_orderkey % 50 < 5").select(F.concat(F.lit("d"), F.col("o_orderkey") % 50).alias("doc_key")).distinct()
    return graph.merge_entities(graph.retract(mentions(t), gone)).select("name", "entity_type", F.col("n_documents").cast("long").alias("n_documents"))


@query(r"""WITH x AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(text, '\p{Lu}[\p{L}'']+(?: \p{Lu}[\p{L}'']+)+')) AS name FROM conversations UNION SELECT DISTINCT conv_id, 'Thread ' || conv_id FROM conversations) SELECT name, count(DISTINCT conv_id) AS n FROM x GROUP BY name""")
def g6_extract_entities(t):
    c = t("conversations").groupBy(F.col("conv_id").alias("doc_key")).agg(F.array_join(F.collect_list("text"), "\n").alias("text"), F.concat(F.lit("Thread "), F.first("conv_id")).alias("thread_name"))
    return graph.extract(c)[0].groupBy("name").agg(F.count_distinct("doc_key").alias("n"))


@query("WITH x AS (SELECT DISTINCT l_orderkey, 's' || l_suppkey AS name FROM lineitem) SELECT a.name AS source, b.name AS target, count(*) AS weight FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.name < b.name GROUP BY ALL")
def g6_cooccurrence(t):
    return graph.cooccurrence(t("lineitem").select(F.col("l_orderkey").alias("doc_key"), F.concat(F.lit("s"), "l_suppkey").alias("name")))


@query("SELECT 'c' || c_custkey AS source FROM customer WHERE c_nationkey = 3")
def g10_entity_detail(t):
    nodes, edges = customer_graph(t)
    entities = nodes.select("name", F.array(F.lit("d1"), F.lit("gone")).alias("doc_keys"))
    manifest = t("region").where("r_regionkey = 0").select(F.lit("d1").alias("doc_key"), F.lit("T").alias("thread_name"), F.lit("s").alias("span"), F.array(F.lit("g")).alias("message_guids"))
    return graph.entity_detail(entities, edges, manifest, "N3")[1].select("source")


@query("""WITH r AS (SELECT c_nationkey AS query_id, 'c' || c_custkey AS source, 'xn' || c_nationkey AS target, row_number() OVER (PARTITION BY c_nationkey ORDER BY 'c' || c_custkey || chr(31) || 'xn' || c_nationkey) AS nth FROM customer),
 l AS (SELECT query_id, source || '>' || target AS hit FROM r), g AS (SELECT query_id, source || '>' || target AS hit FROM r WHERE nth <= 10), d AS (SELECT n_nationkey AS query_id, 'd' || n_nationkey AS hit FROM nation)
 SELECT 'local' AS mode, * FROM l UNION ALL SELECT 'global', * FROM g UNION ALL SELECT 'hybrid', * FROM l UNION ALL SELECT 'mix', * FROM l UNION ALL SELECT 'naive', * FROM d UNION ALL SELECT 'mix', * FROM d""")
def g11_graph_retrieve(t):
    c, n = t("customer"), t("nation")
    q = n.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("tell me of xn"), "n_nationkey").alias("text"))
    entities = n.select(F.concat(F.lit("xn"), "n_nationkey").alias("name"))
    relations = c.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("xn"), "c_nationkey").alias("target"))
    transcripts = n.select(F.concat(F.lit("d"), "n_nationkey").alias("doc_key"), F.concat(F.lit("here xn"), "n_nationkey", F.lit(" stands")).alias("text"))
    out = []
    for mode in ("local", "global", "hybrid", "naive", "mix"):
        found, docs = graph.graph_retrieve(q, entities, relations, transcripts, mode)
        out += [found.select(F.lit(mode).alias("mode"), "query_id", F.concat_ws(">", "source", "target").alias("hit")), docs.select(F.lit(mode), "query_id", "doc_key")]
    return reduce(DataFrame.union, out)


@query(r"SELECT c_nationkey AS question, CASE WHEN length(x) <= 400 THEN x ELSE regexp_replace(substr(x, 1, 396), '\s+$', '') || ' […]' END AS context FROM (SELECT c_nationkey, 'Facts:' || chr(10) || string_agg('c' || c_custkey, chr(10) ORDER BY 'c' || c_custkey) || chr(10) || chr(10) || 'Excerpts:' || chr(10) || any_value(n_name) AS x FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY c_nationkey)")
def g12_graph_context(t):
    f = t("customer").select(F.col("c_nationkey").alias("question"), F.concat(F.lit("c"), "c_custkey").alias("fact"))
    own = f.select("question").distinct()
    e = t("nation").select(F.col("n_nationkey").alias("question"), F.lit(1).alias("rank"), F.col("n_name").alias("text")).join(own, "question", "left_semi")
    return graph.graph_context(f, e, 400)


FACTS = "(CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'und') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'que') THEN 1 ELSE 0 END)"


def answers(t) -> DataFrame:
    groups = F.array(F.array(F.lit("THE"), F.lit("und")), F.array(F.lit("Que")))
    ids = F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 5).cast("int")), lambda i: i)
    return t("documents").select("doc_id", F.col("text").alias("answer"), groups.alias("expected_facts"), F.when(F.col("doc_id") % 5 > 0, ids).alias("surfaced"), F.array(F.lit(2), F.lit(9)).alias("required"))


@query(f"SELECT doc_id, round({FACTS} / 2, 6) AS fact_recall, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 >= 2 THEN 0.5 ELSE 0 END AS provenance_recall FROM documents")
def a10_a11_answer_scores(t):
    return evaluate.provenance_recall(evaluate.fact_recall(answers(t))).select("doc_id", r6("fact_recall").alias("fact_recall"), "provenance_recall")


@query("WITH a AS (SELECT doc_id % 5 AS n FROM documents WHERE doc_id % 5 > 0) SELECT round(avg(n), 6) AS mean_cited, round(avg(n) / 1000, 6) AS share, round(avg(CASE WHEN n >= 2 THEN 0.5 ELSE 0 END), 6) AS recall, round(avg(CASE WHEN n >= 2 THEN 0.5 ELSE 0 END) / (avg(n) / 1000), 6) AS lift FROM a")
def a12_provenance_lift(t):
    out = evaluate.provenance_lift(answers(t).where("surfaced is not null"), 1000)
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(f"""WITH a AS (SELECT lang, doc_id % 11 = 3 AS failed, CASE WHEN doc_id % 11 = 3 THEN 0 ELSE {FACTS} / 2 END AS fact, CASE WHEN doc_id % 11 = 3 OR doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 >= 2 THEN 0.5 ELSE 0 END AS prov FROM documents),
 s AS (SELECT 'all' AS slice, * FROM a UNION ALL SELECT 'kind:' || lang, * FROM a)
 SELECT slice, count(*) AS questions, count(*) FILTER (failed) AS errors, round(avg(fact), 6) AS fact_recall, round(avg(prov), 6) AS provenance_recall, count(prov) AS n_reported FROM s GROUP BY slice""")
def g13_graph_eval(t):
    a = answers(t).join(t("documents").select("doc_id", F.col("lang").alias("kind")), "doc_id").withColumn("error", F.when(F.col("doc_id") % 11 == 3, "timeout"))
    builds.check_anchors(a.select("required"), t("documents").select(F.col("doc_id").alias("guid")))
    return builds.run_graph_eval(a).select("slice", "questions", "errors", r6("fact_recall").alias("fact_recall"), r6("provenance_recall").alias("provenance_recall"), "n_reported")


HEARD = r"""h AS (SELECT conv_id, turn, role, trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g'), ' ') AS x,
  trim(regexp_replace(regexp_replace(lower(replace(text, 'th', 'tn')), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g'), ' ') AS y FROM conversations),
 e AS (SELECT *, levenshtein(x, y) AS char_edits, length(x) AS chars, CASE WHEN x = '' THEN 0 ELSE len(string_split(x, ' ')) END AS words, len(list_filter(list_zip(string_split(x, ' '), string_split(y, ' ')), lambda p: p[1] <> p[2])) AS word_edits FROM h)"""


def heard(t) -> DataFrame:
    """Every turn beside what a reader made of it, who takes one letter pair for another."""
    c = t("conversations").select("conv_id", "turn", "role", F.col("text").alias("truth"), F.replace(F.col("text"), F.lit("th"), F.lit("tn")).alias("hyp"))
    return evaluate.error_rates(c)


@query(f"WITH {HEARD} SELECT conv_id, turn, char_edits, chars, word_edits, words FROM e")
def a13_error_rates(t):
    return heard(t).select("conv_id", "turn", *[F.col(c).cast("long").alias(c) for c in ("char_edits", "chars", "word_edits", "words")])


@query(f"WITH {HEARD} SELECT round(sum(char_edits) / sum(chars), 6) AS cer, round(sum(word_edits) / sum(words), 6) AS wer FROM e")
def a13_corpus_error_rates(t):
    return evaluate.corpus_error_rates(heard(t)).select(r6("cer").alias("cer"), r6("wer").alias("wer"))


# Telemetry.

BOUNDS = [1.0, 5.0, 10.0, 30.0, 60.0, 120.0]


@query("SELECT event_type, le, count(*) FILTER (value <= le) AS bucket, round(sum(value), 4) AS sum, count(value) AS count FROM events, (VALUES (1.0::DOUBLE), (5.0), (10.0), (30.0), (60.0), (120.0), (1e308)) v(le) GROUP BY ALL")
def a14_histogram(t):
    h = telemetry.histogram(t("events"), "value", BOUNDS, ["event_type"])
    return h.select("event_type", F.least("le", F.lit(1e308)).alias("le"), "bucket", F.round("sum", 4).alias("sum"), "count")


@query("""WITH h AS (SELECT event_type, le, count(*) FILTER (value <= le) AS b, count(*) AS n FROM events, (VALUES (1.0::DOUBLE), (5.0), (10.0), (30.0), (60.0), (120.0), (1e308)) v(le) GROUP BY ALL),
 l AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(b) OVER w, 0) AS below, 0.5 * n AS rank FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le))
 SELECT event_type, round(CASE WHEN le = 1e308 THEN low ELSE low + (le - low) * (rank - below) / (b - below) END, 6) AS quantile FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS nth FROM l WHERE b >= rank) WHERE nth = 1""")
def a15_histogram_quantile(t):
    h = telemetry.histogram(t("events"), "value", BOUNDS, ["event_type"])
    return telemetry.histogram_quantile(h, 0.5, ["event_type"]).select("event_type", r6("quantile").alias("quantile"))


COUNTER = "s AS (SELECT event_type, ts, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) % 1000 AS v FROM events)"


@query(f"WITH {COUNTER}, d AS (SELECT event_type, ts, CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END AS step FROM (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM s)) SELECT event_type, epoch_us(date_trunc('day', ts)) AS start_us, CAST(sum(step) AS BIGINT) AS increase FROM d GROUP BY ALL")
def a16_increase(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    line = W.partitionBy("event_type").orderBy("ts", "event_id")  # a counter to read, made by numbering the events
    s = e.withColumn("value", ((F.row_number().over(line) - 1) % 1000).cast("long"))
    return telemetry.increase(s, ["event_type"], "1 day", ("event_id",)).select("event_type", F.unix_micros("start").alias("start_us"), "increase")


@query("SELECT a.event_type, round(a.mean, 6) AS mean, round(a.n / (SELECT count(*) FROM events), 6) AS share FROM (SELECT event_type, sum(value) / count(value) AS mean, count(*) AS n FROM events GROUP BY event_type) a")
def a17_mean_and_share(t):
    h = telemetry.histogram(t("events"), "value", BOUNDS, ["event_type"])
    m = telemetry.mean_from_histogram(h, ["event_type"]).join(telemetry.share_of_kind(t("events"), "event_type"), "event_type")
    return m.select("event_type", r6("mean").alias("mean"), r6("share").alias("share"))


@query("SELECT event_type AS method, user_id % 3 AS outcome, count(*) AS queries, CAST(sum(CASE WHEN event_id % 4 <> 0 THEN event_id END) AS BIGINT) AS tokens_in, CAST(sum(user_id) AS BIGINT) AS tokens_out FROM events GROUP BY ALL")
def a18_query_totals(t):
    log = t("events").select(F.col("event_type").alias("method"), (F.col("user_id") % 3).alias("outcome"), F.when(F.col("event_id") % 4 != 0, F.col("event_id")).alias("tokens_in"), F.col("user_id").alias("tokens_out"))
    return telemetry.query_totals(log)


@query("SELECT event_id AS finished_at, user_id AS seconds, length(event_type) AS documents FROM events ORDER BY event_id DESC LIMIT 1")
def a19_last_run(t):
    return telemetry.last_run(t("events").select(F.col("event_id").alias("finished_at"), F.col("user_id").alias("seconds"), F.length("event_type").cast("long").alias("documents"), F.col("event_id").alias("run_id")))


@query("SELECT coalesce(s, 'unknown') AS status, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'O' THEN 'Pending' WHEN 'F' THEN 'done' END AS s FROM orders) GROUP BY 1 UNION ALL SELECT 'in flight', count(*) FROM orders WHERE o_orderstatus = 'O'")
def a24_status_counts(t):
    o = t("orders").select(F.when(F.col("o_orderstatus") == "O", "Pending").when(F.col("o_orderstatus") == "F", "done").alias("status"))
    return telemetry.status_counts(o).union(telemetry.in_flight(o).select(F.lit("in flight"), "in_flight"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS done FROM events")
def w10_progress(t):
    return telemetry.progress(t("events").select("event_id", F.col("user_id").alias("run_id"))).select("event_id", "done")


@query("SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total, count(*) FILTER (value <= 50) AS up_to_50 FROM events GROUP BY ALL")
def st3_windowed_metrics(t):
    m = streams.windowed_metrics(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour")
    return m.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"), "up_to_50")


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM g GROUP BY user_id, k")
def st3_sessions(t):
    return streams.sessions(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "2 hours").select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("SELECT user_id, first(event_type ORDER BY ts DESC, event_id DESC) AS status FROM events GROUP BY user_id")
def st6_latest_status(t):
    return streams.latest_status(t("events"))


@query("""WITH l AS (SELECT user_id, date_trunc('day', ts) + INTERVAL 1 DAY AS until, first(event_type ORDER BY ts DESC, event_id DESC) AS status FROM events GROUP BY ALL), d AS (SELECT DISTINCT until FROM l),
 s AS (SELECT d.until, user_id, first(status ORDER BY l.until DESC) AS status FROM d JOIN l ON l.until <= d.until GROUP BY ALL), k AS (SELECT DISTINCT status FROM l),
 n AS (SELECT d.until, k.status, count(s.user_id) AS n FROM d CROSS JOIN k LEFT JOIN s ON s.until = d.until AND s.status = k.status GROUP BY ALL)
 SELECT epoch_us(until) AS at_us, status, n FROM (SELECT *, lag(n, 1, 0) OVER (PARTITION BY status ORDER BY until) AS before FROM n) WHERE n <> before""")
def st6_status_counts(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.status_counts(streams.status_changes(e, "1 day")).select(F.unix_micros("at").alias("at_us"), "status", "n")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE NOT (o_orderstatus = 'O' AND o_totalprice < 50000)")
def s7_s9_keyed_store(t):
    """Orders kept in a store by three commits: all, then those of one status anew, then deletions; merged on read."""
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    rows = lambda df, c: df.select("o_orderkey", c.alias("price"))
    kept = Store(o.sparkSession, f"{scratch_dir(o.sparkSession)}/store-{uuid.uuid4().hex}", {"orders": ["o_orderkey"]})
    price = F.col("o_totalprice")
    kept.commit({"orders": rows(o, price)}, ("load", 0))
    kept.commit({"orders": rows(o.where("o_orderstatus = 'F'"), price + 1)}, ("load", 1))
    kept.commit({"orders": rows(o.where("o_orderstatus = 'F'"), price + 9)}, ("load", 1))  # a replay of that batch
    gone = o.where("o_orderstatus = 'O' and o_totalprice < 50000")
    kept.commit({"orders": Change(rows(gone.where("false"), price), gone.select("o_orderkey"))}, ("load", 2))
    kept.compact("orders")
    return kept.read("orders")


@query("SELECT conv_id, 'chat' || conv_id || '::x' AS thread_id, '2024-01-0' || (1 + turn % 5) || CASE WHEN turn % 5 = turn % 3 THEN '' ELSE '..2024-01-0' || (1 + turn % 3) END AS span, 'Room (' || '2024-01-0' || (1 + turn % 5) || CASE WHEN turn % 5 = turn % 3 THEN '' ELSE '..2024-01-0' || (1 + turn % 3) END || ')' AS label, 'Room' AS header, turn FROM conversations")
def e17_spans_and_keys(t):
    c = t("conversations")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), (F.col("turn") % n).cast("int"))
    key = T.doc_key(F.concat(F.lit("chat"), "conv_id", F.lit("::x")), day(5), day(3))
    label = T.transcript_label(F.lit("Room"), T.span(day(5), day(3)))
    return c.select("conv_id", "turn", T.key_parts(key)["thread_id"].alias("thread_id"), T.key_parts(key)["span"].alias("span"), label.alias("label"), T.thread_header(F.concat(F.lit("# "), label, F.lit("\nParticipants: a"))).alias("header"))


@query(f"WITH {EDGES}, d AS (SELECT name, count(*) AS degree FROM (SELECT source AS name FROM edges UNION ALL SELECT target FROM edges) GROUP BY name) SELECT name, round(4 + 14 * sqrt(degree / (SELECT max(degree) FROM d)), 6) AS size FROM d")
def e19_node_sizes(t):
    d = graph.degrees(customer_graph(t)[1])
    top = d.agg(F.max("degree").alias("most"))
    return d.crossJoin(F.broadcast(top)).select("name", r6(T.node_size(F.col("degree"), F.col("most"))).alias("size"))


@query(r"""SELECT item_id, regexp_replace(text, '(^|[^\p{L}\p{N}])((?i:the|and))', '\1<mark>\2</mark>', 'g') AS marked FROM benchmark""")
def e9_highlight(t):
    return t("benchmark").select("item_id", T.highlight(F.col("text"), ["and", "the"]).alias("marked"))


@query("SELECT b.item_id AS query_id, 0 AS ref, CASE WHEN b.item_id % 4 = 0 THEN 'd1::' || b.item_id ELSE d.doc_id || '::0' END AS id FROM benchmark b LEFT JOIN documents d ON b.item_id % 4 <> 0 AND d.doc_id % 7 = b.item_id % 7 AND contains(lower(d.text), lower(b.text))")
def j9_resolve_by_fact(t):
    refs = t("benchmark").select(F.col("item_id").alias("query_id"), F.lit(0).alias("ref"), F.when(F.col("item_id") % 4 == 0, F.lit("x")).otherwise((F.col("item_id") % 7).cast("string")).alias("doc_id"), F.col("item_id").cast("int").alias("chunk_index"), F.when(F.col("item_id") % 4 > 0, F.col("text")).alias("fact"))
    chunks = t("documents").select((F.col("doc_id") % 7).cast("string").alias("doc_id"), F.lit(-1).alias("chunk_index"), T.chunk_id(F.col("doc_id").cast("string"), F.lit(0)).alias("chunk_id"), F.col("text").alias("content"))
    anchored = refs.select(F.lit("x").alias("doc_id"), "chunk_index", T.chunk_id(F.lit("d1"), F.col("chunk_index")).alias("chunk_id"), F.lit("").alias("content"))
    return evaluate.resolve_by_fact(refs, chunks.union(anchored)).select("query_id", "ref", "id")


# Rows that SQL cannot express; tests hold them against plain versions.

@query()
def s3_html_to_markdown(t):
    return files.html_to_markdown(t("pages"))


@query()
def c1_recursive_character(t):
    return chunking.chunk(t("documents"))


@query()
def c2_token_based(t):
    return chunking.chunk(t("documents"), "token_based")


@query()
def c3_markdown_aware(t):
    return chunking.chunk(files.html_to_markdown(t("pages")).select(F.col("page_id").alias("doc_id"), F.col("markdown").alias("text")), "markdown_aware")


@query()
def c4_semantic(t):
    return chunking.semantic(t("documents"), chunking.hashed_embedding)


@query()
def c5_heading_hybrid(t):
    return chunking.chunk(files.html_to_markdown(t("pages")).select(F.col("page_id").alias("doc_id"), F.col("markdown").alias("text")), "heading_hybrid")


@query()
def c6_chunker_sweep(t):
    facts = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("fact"))
    return builds.sweep_chunkers(t("documents"), facts)


@query()
def r12_run_matrix(t):
    queries = t("benchmark").select(F.col("item_id").alias("query_id"), "text")
    passages = t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("context"))
    return builds.run_matrix(queries, passages, fact_refs(t))[0].select("config", "k", r6("recall").alias("recall"), r6("pass_rate").alias("pass_rate"))


@query()
def q3_chat_eval(t):
    m = messages(t)
    passages = m.where("role = 'assistant'").select((F.col("conversation_id") * 100 + F.col("turn")).alias("id"), "content", F.lit(None).cast("string").alias("context"))
    refs = m.where("role = 'user'").select("conversation_id", "turn", F.lit(0).alias("ref"), (F.col("conversation_id") * 100 + F.col("turn") + 1).alias("id"))
    out = builds.run_chat_eval(m, passages, refs.join(passages.select("id"), "id", "left_semi"))
    return out.withColumns({c: r6(c) for c in ("recall", "pass_rate")})


@query()
def r2_semantic_ann(t):
    e = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return ivf.semantic_ann(e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), ivf.ivf_index(e, 16), 10, 14)


@query()
def r8_contextualize(t):
    return chunking.contextualize(chunking.chunk(t("documents")), t("documents")).select("doc_id", "chunk_index", "context")


@query()
def e7_snippets(t):
    return t("documents").select("doc_id", T.snippets(F.col("text")).alias("snippets"))
