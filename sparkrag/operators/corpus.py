"""Corpus tables: outcomes of ingest, listings, snapshots and their differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from sparkrag.functions import terms
from sparkrag.functions import text as T
from sparkrag.session import saved


def classify_incoming(incoming: DataFrame, documents: DataFrame, reingest: bool = False) -> DataFrame:
    """incoming (doc_id, content_hash, text) with an outcome: skipped where the same version is stored, no_text where
    there is too little to index, else ingested."""
    known = documents.select("doc_id", "content_hash", F.lit(True).alias("_known")).distinct()
    same = F.lit(False) if reingest else F.coalesce("_known", F.lit(False))
    joined = incoming.join(known, ["doc_id", "content_hash"], "left")
    return joined.withColumn("outcome", F.when(same, "skipped").when(~T.has_text(F.col("text")), "no_text").otherwise("ingested")).drop("_known")


def ingest_summary(outcomes: DataFrame) -> DataFrame:
    """Documents by outcome, and the chunks of all."""
    kinds = ("ingested", "skipped", "no_text", "unsupported", "failed")
    return outcomes.agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in kinds], F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"))


def needs_ocr(pages: DataFrame, min_chars: int = 50, ratio: float = 0.2) -> DataFrame:
    """doc_id and whether its pages (doc_id, n_chars) hold too little text, or too many of them none."""
    return pages.groupBy("doc_id").agg(
        ((F.coalesce(F.sum("n_chars"), F.lit(0)) < min_chars) | (F.coalesce(F.count_if(F.coalesce("n_chars", F.lit(0)) == 0) / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)) >= ratio)).alias("needs_ocr"))


def json_field(column: Column, path: str, default: str) -> Column:
    return F.coalesce(F.get_json_object(column, f"$.{path}"), F.lit(default))


def near_ceiling(chunks: DataFrame, limit: int = 480) -> DataFrame:
    return chunks.where(F.col("n_tokens") >= limit)


def document_chunks(chunks: DataFrame, doc_id: str) -> DataFrame:
    return chunks.where(F.col("doc_id") == doc_id).orderBy("chunk_index")


def list_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """documents with a map of their chunks' extraction kinds, newest first; empty for a document without chunks."""
    mix = chunks.groupBy("doc_id", "extraction").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("extraction", "n")))).alias("extraction"))
    return documents.join(mix, "doc_id", "left").withColumn("extraction", F.coalesce("extraction", F.create_map().cast("map<string,bigint>"))).orderBy(F.desc("ingested_at"), "source")


def corpus_gauges(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """gauge, label, value: documents and chunks in all, documents by file type, chunks by strategy."""
    def by(df: DataFrame, name: str, label: str) -> DataFrame:
        sets = df.groupingSets([[F.col(label)], []], F.col(label)).agg(F.count("*").alias("value"), F.grouping(label).alias("all"))
        return sets.select(F.when(F.col("all") == 1, name).otherwise(f"{name}_by_{label}").alias("gauge"), F.when(F.col("all") == 0, F.col(label)).alias("label"), "value")

    return by(documents, "documents", "file_type").union(by(chunks, "chunks", "chunking_strategy"))


def folder_rollup(documents: DataFrame) -> DataFrame:
    """folder, documents, chunks, latest for every ancestor folder of relative_path; the root is the empty folder."""
    parts = F.split("relative_path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return documents.withColumn("folder", F.explode(folders)).groupBy("folder").agg(F.count("*").alias("documents"), F.sum("n_chunks").alias("chunks"), F.max("ingested_at").alias("latest"))


def number_chunks(chunks: DataFrame, start: int = 0) -> DataFrame:
    """chunks (doc_id, position) with chunk_index by document and original_index over the corpus from start on, by
    doc_id. Offsets are summed over the table of documents, in ranges of doc_id, so no task holds all chunks."""
    own = chunks.withColumn("chunk_index", F.row_number().over(W.partitionBy("doc_id").orderBy("position")) - 1)
    # Written once: the ranges are sampled, and another evaluation could cut them elsewhere.
    counts = saved(own.groupBy("doc_id").agg(F.count("*").alias("n")).repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "chunk-counts")
    within = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"))
    offsets = parts.withColumn("offset", F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("total")
    starts = within.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("offset") + start).alias("first"))
    return own.join(starts, "doc_id").withColumn("original_index", F.col("first") + F.col("chunk_index")).drop("first")


def diff(manifest: DataFrame, rendered: DataFrame, key: str = "doc_key", digest: str = "content_sha256") -> DataFrame:
    """key and state (new, changed, unchanged, removed) of two snapshots."""
    a = manifest.select(key, F.col(digest).alias("_old"), F.lit(True).alias("_a"))
    b = rendered.select(key, F.col(digest).alias("_new"), F.lit(True).alias("_b"))
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def respanned(removed: DataFrame, rendered: DataFrame) -> DataFrame:
    """Keys of removed documents with guids, all of which stand in rendered ones."""
    there = rendered.select(F.explode("message_guids").alias("guid")).distinct().withColumn("_there", F.lit(1))
    each = removed.select("doc_key", F.explode("message_guids").alias("guid")).join(there, "guid", "left")
    return each.groupBy("doc_key").agg(F.min(F.coalesce("_there", F.lit(0))).alias("covered")).where("covered = 1").select("doc_key")


def merge_manifest(old: DataFrame, rendered: DataFrame, prune: bool, retain: DataFrame | None = None, without: DataFrame | None = None, key: str = "doc_key") -> DataFrame:
    """The next manifest: rendered, with what it does not mention of old unless prune. Keys in retain keep their old
    record; keys in without go."""
    kept_old = old if not prune else old.where("1 = 0")
    if retain is not None:
        rendered = rendered.join(retain.select(key), key, "left_anti")
        kept_old = kept_old.unionByName(old.join(retain.select(key), key, "left_semi")).dropDuplicates([key])
    out = rendered.unionByName(kept_old.join(rendered.select(key), key, "left_anti"))
    return out if without is None else out.join(without.select(key), key, "left_anti")


def plan_build(states: DataFrame, full: bool, respans: DataFrame | None = None, key: str = "doc_key") -> DataFrame:
    """key and work: pending for new and changed keys, stale for changed and removed ones (only respanned ones unless full)."""
    pending = states.where("state in ('new', 'changed')").select(key, F.lit("pending").alias("work"))
    gone = states.where("state = 'removed'").select(key)
    if not full:
        gone = gone.join(respans, key, "left_semi") if respans is not None else gone.where("1 = 0")
    stale = states.where("state = 'changed'").select(key).union(gone).select(key, F.lit("stale").alias("work"))
    return pending.union(stale)


def delete_documents(documents: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents left, chunks left, requested ids that were not there)."""
    wanted = ids.select("doc_id").distinct()
    return documents.join(wanted, "doc_id", "left_anti"), chunks.join(wanted, "doc_id", "left_anti"), wanted.join(documents, "doc_id", "left_anti")


def paragraphs(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chunk_index, content: non-blank lines of text."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return documents.select(key, F.posexplode(lines).alias("chunk_index", "content"))


#: Words that are looked at together, beyond those of one document.
LOCATE_WORDS = 1 << 20


def locate(chunks: DataFrame, pages: DataFrame, min_coverage: float = 0.3, size: int = 3, few: int = 8) -> DataFrame:
    """chunk_id, page, coverage: the page of its document that holds most of the chunk's word trigrams (single words for
    chunks of under few words); the lowest of equal pages; none below min_coverage.

    A document's chunks and pages meet in one task, and documents are compared many at a time by numbers of words and
    grams: no row is made for a gram or a pair.
    """
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = chunks.select("doc_id", "chunk_id", none(pages, "page"), "content").union(pages.select("doc_id", none(chunks, "chunk_id"), "page", "content"))
    met = both.where("doc_id is not null and content is not null and (chunk_id is not null or page is not null)").repartition("doc_id").sortWithinPartitions("doc_id")
    schema = StructType([chunks.schema["chunk_id"], pages.schema["page"], StructField("coverage", DoubleType())])
    types = to_arrow_schema(schema)

    def grams(rows: np.ndarray, codes: np.ndarray, n_codes: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, first to last word as one number below n_codes ** n, each once) of runs of n words; runs are numbered
        anew with each word, so that numbers stay small."""
        at, run = np.arange(max(len(rows) - n + 1, 0)), codes
        for i in range(1, n):
            run = np.unique(run[:len(run) - 1] * n_codes + codes[i:], return_inverse=True)[1] if len(run) > 1 else run[:0]
        run, whole = run[:len(at)], rows[at] == rows[at + n - 1]
        return rows[at][whole], run[whole]

    def best(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        doc = np.asarray(table["doc_id"].combine_chunks().dictionary_encode().indices).astype(np.int64)
        is_chunk = np.asarray(pc.is_valid(table["chunk_id"]).to_numpy())
        pages_of = table["page"].combine_chunks()
        rank = np.zeros(len(doc), np.int64)
        order = np.asarray(pc.sort_indices(pages_of.filter(pa.array(~is_chunk))))
        rank[np.flatnonzero(~is_chunk)[order]] = np.arange(len(order))
        rows, codes, words = terms.coded(table["words"].combine_chunks())
        short = np.bincount(rows, minlength=len(doc)) < few
        out = []
        for n, some in ((1, short), (size, ~short)):
            row, gram = grams(rows, codes, max(len(words), 1), n)
            wanted = np.flatnonzero((~is_chunk | some)[row])
            row, gram = row[wanted], gram[wanted]
            _, gram = np.unique(doc[row] * (gram.max(initial=0) + 1) + gram, return_inverse=True)
            row, gram, _ = terms.counted(row, gram, int(gram.max(initial=0)) + 1)
            asks, holds = is_chunk[row], ~is_chunk[row]
            many = np.bincount(row[asks], minlength=len(doc))
            page, held = row[holds], gram[holds]
            page, held = page[np.argsort(held, kind="stable")], np.sort(held)
            chunk, asked = row[asks], gram[asks]
            first, last = np.searchsorted(held, asked), np.searchsorted(held, asked, "right")
            pairs = np.cumsum(last - first)
            lo = 0
            while lo < len(chunk):  # some chunks at a time, each whole
                hi = max(int(np.searchsorted(pairs, (pairs[lo - 1] if lo else 0) + (1 << 22), "right")), lo + 1)
                hi = int(np.searchsorted(chunk, chunk[hi - 1], "right"))
                own, other = np.repeat(chunk[lo:hi], (last - first)[lo:hi]), page[terms.spread(first[lo:hi], (last - first)[lo:hi])]
                c, p, shared = terms.counted(own, other, len(doc))
                top = np.lexsort((rank[p], -shared, c))
                c, p, shared = c[top], p[top], shared[top]
                good = np.flatnonzero((np.diff(c, prepend=-1) != 0) & (shared / many[c] >= min_coverage))
                out.append((c[good], p[good], shared[good] / many[c[good]]))
                lo = hi
        c, p, share = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))
        return pa.RecordBatch.from_arrays([table["chunk_id"].combine_chunks().take(pa.array(c)).cast(types.field(0).type), pages_of.take(pa.array(p)).cast(types.field(1).type), pa.array(share, pa.float64())], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(len(b.column("words").flatten()) for b in waiting) > LOCATE_WORDS:
                table = pa.Table.from_batches(waiting)
                last = int(np.argmax(np.asarray(pc.equal(table["doc_id"], table["doc_id"][-1]).to_numpy())))  # the last document may go on
                if last:
                    yield best(table.slice(0, last))
                    waiting = table.slice(last).to_batches()
        if waiting:
            yield best(pa.Table.from_batches(waiting))

    return met.select("doc_id", "chunk_id", "page", T.words(F.col("content")).alias("words")).mapInArrow(run, schema)
