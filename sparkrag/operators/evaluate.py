"""Scores of retrieval, answers and recognition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from sparkrag.functions import text as T
from sparkrag.functions.edits import edit_distance
from sparkrag.session import saved

KS = (5, 10, 20)


def _ks(ks: tuple[int, ...]) -> Column:
    return F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")


def recall_by_query(ranked: DataFrame, golden: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """query_id, k, recall: the share of a query's golden ids (query_id, id) among its k best (query_id, id, rank)."""
    met = golden.distinct().join(ranked.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    per = met.select("query_id", "rank", _ks(ks)).groupBy("query_id", "k")
    return per.agg((F.count_if(F.coalesce(F.col("rank") <= F.col("k"), F.lit(False))) / F.count("*")).alias("recall"))


def recall_at_k(ranked: DataFrame, golden: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """k, recall (the mean), pass_rate (the share of queries with all of theirs)."""
    return recall_by_query(ranked, golden, ks).groupBy("k").agg(F.avg("recall").alias("recall"), F.avg((F.col("recall") == 1).cast("double")).alias("pass_rate"))


def recall_at_k_any(ranked: DataFrame, refs: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """As recall_at_k, for references (query_id, ref, id) that any of their ids meets; an id of null is never met."""
    best = refs.join(ranked.select("query_id", "id", "rank"), ["query_id", "id"], "left").groupBy("query_id", "ref").agg(F.min("rank").alias("rank"))
    return recall_at_k(best.select("query_id", F.col("ref").alias("id"), "rank").where("rank is not null"), best.select("query_id", F.col("ref").alias("id")), ks)


#: Facts are found by characters (of each tier's number) chosen among this many that stand next to each other.
TIERS = ((8, 24), (4, 4), (2, 1), (1, 1))
#: Bits of the filter that tells which runs of characters any fact has.
FILTER_BITS = 1 << 26


def _chosen(texts: list[str], size: int, among: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the runs of size characters that are least among some `among` runs that follow one another; size
    is a power of two. Whatever a text holds, it has chosen all that its part, if long enough, has chosen."""
    h = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    n = len(h) - size - among + 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        step, h = 1, h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        while step < size:
            h = h[:-step] * np.uint64(0xD6E8FEB86659FD93) + h[step:]
            h ^= h >> np.uint64(32)
            step *= 2
        h = (h ^ np.uint64(size)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    wide = 1
    while wide < among:
        step = min(wide, among - wide)
        h, wide = np.minimum(h[:-step], h[step:]), wide + step
    rows = np.repeat(np.arange(len(texts)), sizes)[:n]
    whole = np.arange(size + among - 1, len(h) + size + among - 1) <= np.cumsum(sizes)[rows]
    rows, h = rows[whole], h[whole].view(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], h[new]


def _runs_of(df: DataFrame, key: str, text: str, tiers: list[tuple[int, int]], one: bool, keep: np.ndarray | None = None) -> DataFrame:
    """key and run: the chosen runs of each text, each once; with one, of the first tier it is long enough for alone; with
    keep, only those whose bit is set."""
    key_type = df.schema[key].dataType
    schema = StructType([StructField(key, key_type), StructField("run", LongType())])
    types = to_arrow_schema(schema)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lo = batch.column("_text").to_pylist(), 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= 1 << 18):
                    hi, chars = hi + 1, chars + len(texts[hi])
                some, open_ = texts[lo:hi], np.ones(hi - lo, bool)
                for size, among in tiers:
                    rows, runs = _chosen(some, size, among)
                    known = open_[rows]
                    if keep is not None:
                        bit = runs.view(np.uint64) % np.uint64(FILTER_BITS)
                        known &= (keep[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    rows, runs = np.unique(np.stack((rows[known], runs[known])), axis=1)
                    if one:
                        open_[rows] = False
                    yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(lo + rows)).cast(types.field(key).type), pa.array(runs, pa.int64())], schema=types)
                lo = hi

    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(choose, schema)


def containing(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """query_id, id of the texts (id, content) that hold a fact (query_id, fact), whatever the case.

    Facts are looked up by runs of characters, whether they begin and end within words or not. Of each fact and text some
    runs are chosen by their hashes alone, so that a text has chosen all that a fact in it has. Texts drop what a filter
    of fixed size does not know of the facts; the runs left make an inverted list, and each different fact is looked up
    by its rarest run there, then verified in the text. One pass chooses in all texts, another reads those that are
    candidates; facts never pass through the driver, and queries that ask the same fact are joined last. Null facts and
    texts match nothing; an empty fact stands in every text.
    """
    lowered = saved(facts.where("fact is not null").select("query_id", F.lower("fact").alias("fact")).distinct(), "facts")
    own = texts.where("content is not null").select("id", F.lower("content").alias("content"))
    different = lowered.where("fact <> ''").select("fact").distinct().withColumn("length", F.length("fact"))
    lengths = [r[0] for r in different.groupBy(F.least("length", F.lit(64))).agg(F.lit(1)).collect()]  # at most 64 numbers
    tiers = [t for i, t in enumerate(TIERS) if any(n >= sum(t) - 1 and not any(n >= sum(u) - 1 for u in TIERS[:i]) for n in lengths)]
    asked = saved(_runs_of(different, "fact", "fact", tiers, True), "fact-runs")
    bits = asked.select(F.col("run").bitwiseAND(FILTER_BITS - 1).alias("bit"))
    parts = bits.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bitmap")).collect()  # FILTER_BITS bits at most
    keep = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        part = np.frombuffer(r["bitmap"], np.uint8)
        keep[(r["bucket"] - 1) * len(part):r["bucket"] * len(part)] = part
    held = saved(_runs_of(own, "id", "content", tiers, False, keep).join(asked.select("run").distinct(), "run", "left_semi"), "text-runs")
    rarest = asked.join(held.groupBy("run").agg(F.count("*").alias("n")), "run").groupBy("fact").agg(F.min_by("run", F.struct("n", "run")).alias("run"))
    pairs = saved(held.join(rarest, "run").select("id", "fact"), "fact-candidates")
    met = pairs.join(own, "id").where(F.contains("content", "fact")).select("id", "fact").distinct()
    everywhere = lowered.where("fact = ''").select("query_id").crossJoin(own.select("id"))  # an empty fact asks for all texts
    return met.join(lowered, "fact").select("query_id", "id").union(everywhere).distinct()


def resolve_by_fact(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, ref, id: every chunk of the reference's document that holds its fact, whatever the case; the anchored
    chunk of one without a fact; null where nothing matches."""
    holds = F.contains(F.lower("content"), F.lower("fact"))
    here = (F.col("r.doc_id") == F.col("c.doc_id")) & F.when(F.col("fact").isNull(), F.col("c.chunk_index") == F.col("r.chunk_index")).otherwise(holds)
    return refs.alias("r").join(chunks.alias("c"), here, "left").select("query_id", "ref", F.col("c.chunk_id").alias("id"))


def resolve_golden(golden: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, id of references (query_id, rel_source, chunk_index); a source that is not stored fails."""
    missing = golden.join(documents.select(F.col("source").alias("rel_source")), "rel_source", "left_anti")
    if row := missing.first():
        raise ValueError(f"golden source not in the corpus: {row['rel_source']}")
    own = documents.select(F.col("source").alias("rel_source"), "doc_id")
    return golden.join(own, "rel_source").select("query_id", T.chunk_id(F.col("doc_id").cast("string"), F.col("chunk_index")).alias("id"))


def unresolvable(golden: DataFrame, documents: DataFrame) -> DataFrame:
    """References whose document is absent or has fewer chunks."""
    own = documents.select(F.col("source").alias("rel_source"), "n_chunks")
    return golden.join(own, "rel_source", "left").where(F.col("n_chunks").isNull() | (F.col("chunk_index") >= F.col("n_chunks")))


def entries_within(golden: DataFrame, sources: list[str]) -> DataFrame:
    """Entries all of whose references lie in sources."""
    return golden.where(F.forall("relevant", lambda r: r["rel_source"].isin(sources)))


def summarize_turns(records: DataFrame, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """by, slice, turns, recall, pass_rate, mean_latency, max_latency: over all turns, follow-ups, and each kind (records:
    kind, recall, latency; kind is null for first turns)."""
    slices = F.array_compact(F.array(F.lit("all"), F.when(F.col("kind").isNotNull(), "follow_up"), F.concat(F.lit("kind:"), "kind")))
    return records.withColumn("slice", F.explode(slices)).groupBy(*by, "slice").agg(
        F.count("*").alias("turns"), F.avg("recall").alias("recall"), F.avg((F.col("recall") == 1).cast("double")).alias("pass_rate"), F.avg("latency").alias("mean_latency"), F.max("latency").alias("max_latency"))


def fact_recall(answers: DataFrame) -> DataFrame:
    """answers (answer, expected_facts: groups of which one wording each is wanted) with fact_recall and missed_groups."""
    met = lambda g: F.exists(g, lambda v: F.contains(F.lower("answer"), F.lower(v)))
    n = F.size("expected_facts")
    hit = F.size(F.filter("expected_facts", met))
    return answers.withColumn("fact_recall", F.when(n > 0, hit / n)).withColumn("missed_groups", F.transform(F.filter("expected_facts", lambda g: ~met(g)), lambda g: g[0]))


def provenance_recall(answers: DataFrame) -> DataFrame:
    """answers (surfaced, required) with provenance_recall; null where nothing was reported."""
    share = F.size(F.array_intersect("surfaced", "required")) / F.size(F.array_distinct("required"))
    return answers.withColumn("provenance_recall", F.when(F.col("surfaced").isNull() | (F.size("surfaced") == 0) | (F.size("required") == 0), F.lit(None)).otherwise(share))


def provenance_lift(answers: DataFrame, corpus_size: int) -> DataFrame:
    """mean_cited, share (of the corpus), recall, lift (recall over what citing at random would find)."""
    own = provenance_recall(answers)
    share = F.avg(F.size("surfaced")) / F.lit(corpus_size)
    return own.agg(F.avg(F.size("surfaced")).alias("mean_cited"), share.alias("share"), F.avg("provenance_recall").alias("recall"), (F.avg("provenance_recall") / share).alias("lift"))


def error_rates(pairs: DataFrame) -> DataFrame:
    """pairs (truth, hyp) with character and word edits and lengths after normalisation, and cer and wer. Texts of any
    length and with any number of different words; null where either text is null."""
    names = pairs.columns
    df = pairs.withColumn("_t", T.normalize_ocr(F.col("truth"))).withColumn("_h", T.normalize_ocr(F.col("hyp")))
    schema = StructType([*df.schema.fields, StructField("char_edits", IntegerType()), StructField("word_edits", IntegerType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = list(zip(batch.column("_t").to_pylist(), batch.column("_h").to_pylist(), strict=True))
            known = [t is not None and h is not None for t, h in both]
            chars = [edit_distance(t, h) if k else None for (t, h), k in zip(both, known, strict=True)]
            words = [edit_distance(t.split(" ") if t else [], h.split(" ") if h else []) if k else None for (t, h), k in zip(both, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chars, pa.int32()), pa.array(words, pa.int32())], names=[*batch.schema.names, "char_edits", "word_edits"])

    df = df.mapInArrow(measure, schema)
    df = df.withColumns({"chars": F.length("_t"), "words": F.size(F.filter(F.split("_t", " "), lambda w: w != ""))})
    return df.select(*names, "char_edits", "chars", "word_edits", "words", (F.col("char_edits") / F.nullif("chars", F.lit(0))).alias("cer"), (F.col("word_edits") / F.nullif("words", F.lit(0))).alias("wer"))


def corpus_error_rates(rates: DataFrame) -> DataFrame:
    """cer and wer of a corpus: all edits by all lengths."""
    return rates.agg((F.sum("char_edits") / F.sum("chars")).alias("cer"), (F.sum("word_edits") / F.sum("words")).alias("wer"))


def golden_ranks(ranked: DataFrame, golden: DataFrame) -> DataFrame:
    """One row a query, one column a config (ranked: config, query_id, id, rank): the best golden rank, null if missed."""
    best = ranked.join(golden.distinct(), ["query_id", "id"]).groupBy("query_id", "config").agg(F.min("rank").alias("rank"))
    return golden.select("query_id").distinct().join(best.groupBy("query_id").pivot("config").agg(F.first("rank")), "query_id", "left")


def build_report(before: DataFrame, after: DataFrame, batch: DataFrame) -> DataFrame:
    """messages_before, messages_after, new_messages, duplicates: what a batch (guid) added to a store (guid)."""
    b, a, n = (x.agg(F.count("*").alias(c)) for x, c in ((before, "messages_before"), (after, "messages_after"), (batch, "in_batch")))
    return b.crossJoin(a).crossJoin(n).select("messages_before", "messages_after", (F.col("messages_after") - F.col("messages_before")).alias("new_messages"), (F.col("in_batch") - F.col("messages_after") + F.col("messages_before")).alias("duplicates"))

