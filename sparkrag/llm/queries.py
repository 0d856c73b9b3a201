"""The registered queries of this subpackage: thin digests of its operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkrag.llm import ann

    return ann.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkrag.llm import pii

    found = pii.find(_docs(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(list(pii.KINDS)))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.as_text(base), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkrag.llm import licenses

    found = licenses.scan(_docs(spark, sf_dir))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkrag.llm import jaccard

    return jaccard.similar_groups(_docs(spark, sf_dir))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkrag.llm import lm

    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    scored = lm.score(_docs(spark, sf_dir), ~held_out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkrag.llm import substring

    out = substring.dedup_substrings(_docs(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkrag.llm import neardup

    return neardup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sparkrag.llm import packing

    pieces = packing.pack_documents(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkrag.llm import mixing

    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkrag.llm import langid

    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    models = langid.fit(docs.where(~held_out))
    told = langid.identify(docs.select("doc_id", "text"), models)
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkrag.llm import whitening

    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkrag.llm import spelling

    return spelling.group_variants(_docs(spark, sf_dir))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkrag.llm import mips

    return mips.top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_ann, op2_pii, op3_licenses, op4_jaccard_join, op5_lm_scores, op6_substring_dedup, op7_embedding_dedup, op8_packing, op9_mixing, op10_langid, op11_whitening, op12_spelling, op13_topk)}
WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
REACH = "reach AS (SELECT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other)"
COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"

#: Where SQL expresses the whole result. The others are tested against plain versions or held-out accuracy in tests/llm.
ORACLES: dict[str, str] = {
    "op1_ann": """WITH d AS (SELECT a.vec_id AS query_id, b.vec_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
 SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10""",
    "op4_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, range(1, 100001) r(i) WHERE i <= greatest(len(w) - 4, 1) AND len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 75 * (p.n + q.n - shared)), {REACH},
 low AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
 SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(component, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON node = w.doc_id""",
    "op6_substring_dedup": f"""WITH w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
 win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM w, range(1, 100001) r(i) WHERE i <= len(w) - 12),
 gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i FROM win JOIN (SELECT g, min(doc_id) AS first FROM win GROUP BY g) USING (g) WHERE first < doc_id), range(13) r(k)),
 p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
 k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY p.doc_id)
 SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op7_embedding_dedup": f"""WITH RECURSIVE links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {COSINE} >= 0.95), {REACH},
 low AS (SELECT node, min(other) AS component FROM reach GROUP BY node), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
 SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(component, vec_id)) AS component_id, vec_id <= coalesce(component, vec_id) AS kept FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN low ON node = vec_id""",
    "op13_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS y FROM embeddings),
 d AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.y, b.y) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
 SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM d) WHERE rank <= 10""",
}
