"""Registered queries over the driver's tables, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrag.functions import text as T
from sparkrag.functions import vectors as V
from sparkrag.operators import chat, chunking, evaluate, postings, search
from sparkrag.session import saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def at_k(sql: str, k: int) -> str:
    return sql.replace("{k}", str(k))


# Shapes that several queries share, and the same in SQL.

WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"
STOP = "(" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")"
PARA = r"""para AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chunk_index FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE trim(content, ' ') <> '')"""
MSG = """msg AS (SELECT conv_id AS conversation_id, turn, role, text AS content FROM conversations)"""
DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({0}[i] AS DOUBLE) * CAST({1}[i] AS DOUBLE)))"
COS = f"({DOT.format('{0}', '{1}')} / (sqrt({DOT.format('{0}', '{0}')}) * sqrt({DOT.format('{1}', '{1}')})))"


def vecs(t) -> tuple[DataFrame, DataFrame]:
    e = t("embeddings")
    corpus_ = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), corpus_


def messages(t) -> DataFrame:
    return t("conversations").select(F.col("conv_id").alias("conversation_id"), "turn", "role", F.col("text").alias("content"))


DENSE = f"""dense AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS id, round({COS.format('q.embedding', 'c.embedding')}, 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0)) WHERE rank <= {{k}})"""


@query(f"WITH {at_k(DENSE, 10)} SELECT query_id, id, score, rank FROM dense")
def r1_semantic_topk(t):
    q, c = vecs(t)
    return search.semantic(q, c, 10, 6)


BM25 = f"""terms AS (SELECT doc_id AS id, unnest(list_filter({WORDS.format('text')}, lambda w: w NOT IN {STOP})) AS term FROM documents),
 post AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY ALL), lens AS (SELECT id, count(*) AS length FROM terms GROUP BY id),
 stats AS (SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM terms) / (SELECT count(*) FROM documents) AS avg_len), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
 asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(list_filter({WORDS.format('text')}, lambda w: w NOT IN {STOP})) AS term FROM benchmark) GROUP BY ALL),
 scored AS (SELECT query_id, p.id, round(sum(times * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_len))), 6) AS score
   FROM asked JOIN df USING (term) JOIN post p USING (term) JOIN lens USING (id) CROSS JOIN stats GROUP BY ALL),
 sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= {{k}})"""


def bm25_parts(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    asked = t("benchmark").select(F.col("item_id").alias("query_id"), "text")
    return asked, *search.build_bm25(docs, ("content",), "id")


_KEPT: dict[tuple, object] = {}


def kept(t, name: str, make: Callable[[DataFrame], object]) -> object:
    """What make builds of the documents, once for a session and its input files, which are taken as unchanging."""
    docs = t("documents")
    key = (name, docs.sparkSession.sparkContext.applicationId, *sorted(docs.inputFiles()))
    if key not in _KEPT:
        _KEPT[key] = make(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
    return _KEPT[key]


def sparse(t, k: int) -> DataFrame:
    posted, stats = kept(t, "postings", lambda docs: search.build_bm25(docs, ("content",), "id"))
    return search.bm25(t("benchmark").select(F.col("item_id").alias("query_id"), "text"), posted, stats, k, "id", 6)


@query(f"WITH {at_k(BM25, 10)} SELECT query_id, id, score, rank FROM sparse")
def r4_bm25_topk(t):
    return sparse(t, 10)


@query(f"WITH {at_k(BM25, 10)} SELECT query_id, id, score, rank FROM sparse")
def r4_bm25_from_scratch(t):
    asked, posted, stats = bm25_parts(t)
    return search.bm25(asked, posted, stats, 10, "id", 6)


@query(f"WITH {at_k(BM25, 10)} SELECT query_id, id, score, rank FROM sparse")
def r4_bm25_blocks(t):
    index = kept(t, "bm25", postings.build)
    return postings.search(t("benchmark").select(F.col("item_id").alias("query_id"), "text"), index, 10, 6)


@query()
def r3_r4_bm25_stemmed(t):
    index = kept(t, "stemmed", lambda docs: postings.build(docs, stem="porter"))
    return postings.search(t("benchmark").select(F.col("item_id").alias("query_id"), "text"), index, 10, 6)


@query(f"WITH {at_k(BM25, 1)} SELECT term, df FROM df")
def r3_bm25_document_frequencies(t):
    _, posted, _ = bm25_parts(t)
    return search.document_frequencies(posted).select("term", "df")


FUSED = """fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, semantic_rank NULLS LAST, bm25_rank NULLS LAST) AS fused_rank FROM (
  SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, a.rank AS semantic_rank, b.rank AS bm25_rank, round(coalesce(0.8 / a.rank, 0) + coalesce(0.2 / b.rank, 0), 9) AS fused_score
  FROM dense a FULL JOIN (SELECT query_id * 50 AS query_id, id, rank FROM sparse) b ON a.query_id = b.query_id AND a.id = b.id))"""


def fused(t, k: int) -> DataFrame:
    q, c = vecs(t)
    return search.fuse(search.semantic(q, c, 100, 6), sparse(t, 100).withColumn("query_id", F.col("query_id") * 50), k)


@query(f"WITH {at_k(DENSE, 100)}, {at_k(BM25, 100)}, {FUSED} SELECT query_id, id, semantic_rank, bm25_rank, round(fused_score, 6) AS fused_score, fused_rank FROM fused WHERE fused_rank <= 10")
def r5_hybrid_fusion(t):
    return fused(t, 10).select("query_id", "id", "semantic_rank", "bm25_rank", r6("fused_score").alias("fused_score"), "fused_rank")


@query(f"""WITH {at_k(BM25, 40)}, pool AS (SELECT s.query_id, s.id, s.rank, b.text AS query, d.text AS content FROM sparse s JOIN benchmark b ON b.item_id = s.query_id JOIN documents d ON d.doc_id = s.id),
 alldf AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({WORDS.format('text')}) AS term FROM documents) GROUP BY term),
 t AS (SELECT DISTINCT query_id, id, rank, unnest({WORDS.format('query')}) AS term, {WORDS.format('content')} AS own FROM pool),
 s AS (SELECT query_id, id, rank, round(sum(CASE WHEN list_contains(own, term) THEN w ELSE 0 END) / sum(w), 6) AS rerank_score FROM (SELECT t.*, ln(1 + (SELECT count(*) FROM documents) / (1 + coalesce(df, 0))) AS w FROM t LEFT JOIN alldf USING (term)) GROUP BY ALL)
 SELECT query_id, id, rank AS fused_rank, rerank_score, final_rank, rank - final_rank AS rerank_delta FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS final_rank FROM s) WHERE final_rank <= 5""")
def r6_rerank(t):
    pool = saved(sparse(t, 40).withColumnRenamed("rank", "fused_rank").select("query_id", "id", "fused_rank"), "pool")
    docs = t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    asked = t("benchmark").select(F.col("item_id").alias("query_id"), "text")
    scores = search.coverage_score(pool.select("query_id", "id"), asked, docs).withColumn("rerank_score", r6("rerank_score"))
    return search.rerank(pool, scores, 10).select("query_id", "id", "fused_rank", "rerank_score", "final_rank", "rerank_delta")


@query(f"""WITH {at_k(DENSE, 3)}, m AS (SELECT query_id, list(x ORDER BY i) AS v FROM (SELECT query_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM dense JOIN embeddings ON vec_id = id, range(1, 65) r(i) GROUP BY ALL) GROUP BY query_id)
 SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, vec_id AS id, round({COS.format('v', 'embedding')}, 6) AS score FROM m, embeddings)) WHERE rank <= 10""")
def r7_expanded(t):
    q, c = vecs(t)
    return search.expanded(q, c, 10, 3, 6)


@query("""WITH q AS (SELECT item_id % 7 AS query_id, item_id AS rank, text FROM benchmark) SELECT query_id, string_agg('[SOURCE]: item' || rank || chr(10) || '[CONTEXT]: ' || chr(10) || '[CONTENT]: ' || text, chr(10) || chr(10) ORDER BY rank) AS context FROM q GROUP BY query_id""")
def r10_grounded_context(t):
    b = t("benchmark").select((F.col("item_id") % 7).alias("query_id"), F.col("item_id").alias("rank"), F.concat(F.lit("item"), "item_id").alias("source"), F.lit(None).cast("string").alias("context"), F.col("text").alias("content"))
    return search.assemble_context(b)


@query(f"WITH {at_k(DENSE, 10)} SELECT d.query_id, d.id, d.rank, e.label FROM dense d JOIN embeddings e ON e.vec_id = d.id WHERE e.vec_id % 3 <> 0")
def j1_hydrate(t):
    q, c = vecs(t)
    store = t("embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").alias("id"), "label")
    return search.hydrate(search.semantic(q, c, 10, 6), store, ["id"])[0].select("query_id", "id", "rank", "label")


GOLD = "gold AS (SELECT q.vec_id AS query_id, e.vec_id AS id FROM embeddings q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)"


@query(f"""WITH {at_k(DENSE, 20)}, {GOLD}, r AS (SELECT k, g.query_id, sum(CASE WHEN d.rank <= k THEN 1 ELSE 0 END) / count(*) AS recall FROM gold g LEFT JOIN dense d USING (query_id, id), (VALUES (5), (10), (20)) v(k) GROUP BY ALL)
 SELECT k, round(avg(recall), 6) AS recall, round(avg(CASE WHEN recall = 1 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM r GROUP BY k""")
def a7_recall_at_k(t):
    q, c = vecs(t)
    e = t("embeddings")
    gold = q.join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id").join(e.select(F.col("vec_id").alias("id"), "label"), "label").where("id <> query_id").select("query_id", "id")
    return evaluate.recall_at_k(search.semantic(q, c, 20, 6), gold).select("k", r6("recall").alias("recall"), r6("pass_rate").alias("pass_rate"))


@query(f"""WITH {at_k(BM25, 20)}, refs AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b LEFT JOIN documents d ON contains(lower(d.text), lower(b.text))),
 best AS (SELECT query_id, min(rank) AS rank FROM refs LEFT JOIN sparse USING (query_id, id) GROUP BY query_id)
 SELECT k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM best, (VALUES (5), (10), (20)) v(k) GROUP BY k""")
def a8_recall_at_k_any(t):
    return evaluate.recall_at_k_any(sparse(t, 20), fact_refs(t)).select("k", r6("recall").alias("recall"), r6("pass_rate").alias("pass_rate"))


def fact_refs(t) -> DataFrame:
    """query_id, ref, id of the documents that hold a benchmark text; null where none does."""
    facts = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("fact"))
    met = evaluate.containing(facts, t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
    return facts.select("query_id", F.lit(0).alias("ref")).join(met, "query_id", "left")


@query("SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b LEFT JOIN documents d ON contains(lower(d.text), lower(b.text))")
def j9_fact_anchoring(t):
    return fact_refs(t).select("query_id", "id")


@query(f"WITH {at_k(DENSE, 10)}, s AS (SELECT query_id, id, rank, 'exact' AS config FROM dense UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id), 'by_id' FROM dense), {GOLD}"
       " SELECT g.query_id, min(rank) FILTER (config = 'exact') AS exact, min(rank) FILTER (config = 'by_id') AS by_id FROM gold g LEFT JOIN s USING (query_id, id) GROUP BY g.query_id")
def r12_golden_ranks(t):
    q, c = vecs(t)
    e = t("embeddings")
    gold = q.join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id").join(e.select(F.col("vec_id").alias("id"), "label"), "label").where("id <> query_id").select("query_id", "id")
    exact = search.semantic(q, c, 10, 6)
    other = exact.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("id")))
    runs = exact.withColumn("config", F.lit("exact")).unionByName(other.withColumn("config", F.lit("by_id")))
    return evaluate.golden_ranks(runs, gold).select("query_id", "exact", "by_id")


# Functions.

@query("SELECT doc_id, sha256(text) AS content_hash, substr(sha256(source || ':' || sha256(text)), 1, 16) AS version, doc_id || '::' || n_chars AS chunk_id FROM documents")
def e1_identities(t):
    h = T.content_hash(F.col("text"))
    return t("documents").select("doc_id", h.alias("content_hash"), T.derive_doc_id(F.col("source"), h).alias("version"), T.chunk_id(F.col("doc_id"), F.col("n_chars")).alias("chunk_id"))


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text ELSE source || chr(10) || chr(10) || text END) AS digest, length(text) // 4 AS n_tokens, substr(text, 1, 40) AS head FROM documents")
def e2_e3_context_and_tokens(t):
    context = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    return t("documents").select("doc_id", F.sha2(T.contextualized(context, F.col("text")), 256).alias("digest"), T.count_tokens(F.col("text")).cast("long").alias("n_tokens"), T.truncate_to_tokens(F.col("text"), 10).alias("head"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(replace(text, '. ', '-' || chr(10) || ' '), '\r\n?', chr(10), 'g'), '([\p{L}\p{N}_])-[ \t]*\n[ \t]*([\p{L}\p{N}_])', '\1\2', 'g'), '([\p{L}\p{N}_])-[ \t]+([\p{L}\p{N}_])', '\1\2', 'g')) AS digest FROM documents""")
def e4_newlines(t):
    return t("documents").select("doc_id", F.sha2(T.repair_newlines(F.replace(F.col("text"), F.lit(". "), F.lit("-\n "))), 256).alias("digest"))


@query(f"SELECT doc_id, len({WORDS.format('text')}) AS n, sha256(array_to_string({WORDS.format('text')}, ' ')) AS digest FROM documents")
def e6_words(t):
    w = T.words(F.col("text"))
    return t("documents").select("doc_id", F.size(w).cast("long").alias("n"), F.sha2(F.array_join(w, " "), 256).alias("digest"))


@query(rf"""SELECT item_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 3 AND w NOT IN {STOP})), lambda w: {{'n': -length(w), 't': w}})), lambda x: x.t), ' ') AS terms FROM benchmark""")
def e8_query_terms(t):
    return t("benchmark").select("item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g'), ' ')) AS digest FROM documents""")
def e10_ocr_text(t):
    return t("documents").select("doc_id", F.sha2(T.normalize_ocr(F.col("text")), 256).alias("digest"))


@query("SELECT conv_id, turn, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS answer FROM conversations")
def e11_clean_response(t):
    wrapped = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>a\nb</think>"), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("left over</think> "), "text")).otherwise(F.concat("text", F.lit("<think>never closed")))
    return t("conversations").select("conv_id", "turn", T.clean_response(wrapped).alias("answer"))


@query(r"SELECT conv_id, turn, CASE WHEN turn % 4 = 0 OR length(trim(text, ' ')) > 60 THEN role ELSE trim(text, ' ') END AS kept, CASE WHEN length(text) <= 30 THEN text ELSE regexp_replace(substr(text, 1, 26), '\s+$', '') || ' […]' END AS short FROM conversations")
def e12_e20_fallback_and_cut(t):
    rewrite = F.when(F.col("turn") % 4 != 0, T.strip_label(F.concat(F.lit("QUERY: "), "text"), "query:"))
    return t("conversations").select("conv_id", "turn", T.rewrite_or_raw(rewrite, F.col("role"), 60).alias("kept"), T.truncate_with_ellipsis(F.col("text"), 30).alias("short"))


@query("SELECT conv_id, turn, 'Instruct: find' || chr(10) || 'Query: ' || text AS asked, '[SOURCE]: ' || role || chr(10) || '[CONTEXT]: ' || chr(10) || '[CONTENT]: ' || text AS block FROM conversations")
def e13_wrappers(t):
    return t("conversations").select("conv_id", "turn", T.format_query(F.col("text"), "find").alias("asked"), T.source_block(F.col("role"), F.lit(None).cast("string"), F.col("text")).alias("block"))


@query("""SELECT conv_id, turn, 'Talk {so far}:' || chr(10) || coalesce(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') || chr(10) || 'Asked: ' || text AS prompt FROM conversations""")
def e13_prompts(t):
    m = chat.with_history(messages(t))
    prompt = T.filled("Talk {{so far}}:\n{history}\nAsked: {query}", history=T.format_history(F.col("history")), query=F.col("content"))
    return m.select(F.col("conversation_id").alias("conv_id"), "turn", prompt.alias("prompt"))


@query("SELECT event_id, epoch_us(date_trunc('second', ts)) AS us FROM events")
def e14_apple_time(t):
    s = F.unix_seconds(F.col("ts").cast("timestamp")) - 978307200
    return t("events").select("event_id", F.unix_micros(T.apple_timestamp(F.when(F.col("event_id") % 2 == 0, s).otherwise(s * 1_000_000_000))).alias("us"))


CODE = "CASE WHEN l_linenumber % 3 = 0 THEN 3000 ELSE 2000 END + l_partkey % 8"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 8 <= 5 THEN ['loved', 'liked', 'disliked', 'laughed', 'emphasized', 'questioned'][CAST(l_partkey % 8 AS INT) + 1] END AS kind, CASE WHEN l_partkey % 8 > 5 THEN NULL WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END AS sign, 'g' || l_suppkey AS target FROM lineitem")
def e15_reactions(t):
    df = t("lineitem").withColumn("code", F.expr(CODE))
    g = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "p:3/").otherwise("bp:"), F.lit("g"), "l_suppkey")
    return df.select("l_orderkey", "l_linenumber", T.reaction_kind(F.col("code")).alias("kind"), T.reaction_sign(F.col("code")).alias("sign"), T.reaction_target(g).alias("target"))


@query("SELECT o_orderkey, o_orderstatus || '|' || o_orderpriority AS parts FROM orders")
def e18_source_lists(t):
    joined = F.concat_ws("<SEP>", F.concat(F.lit(" "), "o_orderstatus"), F.lit("unknown_source"), "o_orderpriority", F.lit(" "), "o_orderstatus")
    return t("orders").select("o_orderkey", F.array_join(T.split_list(joined), "|").alias("parts"))


@query("SELECT conv_id, turn, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') = '' THEN 'New conversation' ELSE rtrim(substr(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), 1, 80)) END AS title FROM conversations".replace("\\\\", "\\"))
def e21_titles(t):
    return t("conversations").select("conv_id", "turn", T.title(F.concat(F.lit('"'), "text", F.lit('"'))).alias("title"))


@query("SELECT doc_id, greatest(64, least(1024, 4096 - 256 - length(text) // 4)) AS budget FROM documents")
def e22_budget(t):
    return t("documents").select("doc_id", T.generation_budget(T.count_tokens(F.col("text")), 4096, 256, 64, 1024).cast("long").alias("budget"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', '') AS path, regexp_extract(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', ''), '[^/]*$') AS name FROM pages")
def e23_paths(t):
    p = T.relative_path(F.col("url"))
    return t("pages").select("page_id", p.alias("path"), T.file_name(p).alias("name"))


@query(f"SELECT vec_id, round(sqrt({DOT.format('embedding', 'embedding')}), 6) AS norm, round({COS.format('embedding', 'other')}, 6) AS cosine FROM (SELECT *, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS other FROM embeddings)")
def e24_w6_vectors(t):
    df = t("embeddings").withColumn("other", F.lead("embedding").over(W.partitionBy("label").orderBy("vec_id")))
    return df.select("vec_id", r6(V.norm(F.col("embedding"))).alias("norm"), r6(V.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


@query(f"""WITH d AS (SELECT vec_id, label, round(1 - {COS.format('embedding', 'other')}, 6) AS distance FROM (SELECT *, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS other FROM embeddings)),
 c AS (SELECT *, quantile_cont(distance, 0.95) OVER (PARTITION BY label) AS cut FROM d)
 SELECT vec_id, coalesce(sum(CASE WHEN distance > cut THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece FROM c""")
def w7_boundaries(t):
    d = chunking.consecutive_distance(t("embeddings"), "label", "vec_id", "embedding").withColumn("distance", r6("distance"))
    return chunking.boundaries(d, "label", "vec_id").select("vec_id", "piece")


@query("SELECT avg(CAST(x AS DOUBLE)) IS NOT NULL AS ok, label, i - 1 AS at, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i")
def x4_mean_vectors(t):
    m = search.mean_vectors(t("embeddings"), "label", "embedding")
    return m.select("label", F.posexplode("embedding").alias("at", "x")).select(F.lit(True).alias("ok"), "label", "at", r6("x").alias("mean"))
