"""The message graph: extraction, merging, slices, retrieval and provenance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrag.functions import text as T
from sparkrag.session import saved


def extract(transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Default extraction, lexical and not a model: (mentions: doc_key, name, entity_type; links: doc_key, source, target)
    from threads and capitalised phrases of two words or more; links join names of one document by order of name, each to
    the next, so a document of many names makes as many links and not their square."""
    phrases = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\p{Lu}[\p{L}']+(?: \p{Lu}[\p{L}']+)+)")))
    found = transcripts.select("doc_key", F.explode(phrases).alias("name"), F.lit("phrase").alias("entity_type"))
    threads = transcripts.select("doc_key", F.col("thread_name").alias("name"), F.lit("thread").alias("entity_type"))
    mentions = found.union(threads).dropDuplicates(["doc_key", "name"])
    follow = F.lead("name").over(W.partitionBy("doc_key").orderBy("name"))
    links = mentions.withColumn("target", follow).where("target is not null").select("doc_key", F.col("name").alias("source"), "target")
    return mentions, links


MENTIONS, LINKS = "doc_key string, name string, entity_type string", "doc_key string, source string, target string"


def extract_with(transcripts: DataFrame, fn: Callable[[str], tuple[list[tuple[str, str]], list[tuple[str, str]]]]) -> tuple[DataFrame, DataFrame]:
    """(mentions, links) as extract gives them, by a function of one text: (name, entity type) and (source, target) pairs.
    Each text is read once; null texts hold nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fn(t) if t is not None else ([], []) for t in batch.column("text").to_pylist()]
            pairs = lambda i: [[dict(zip(("a", "b"), x, strict=True)) for x in f[i]] for f in found]
            kind = pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_key"), pa.array(pairs(0), kind), pa.array(pairs(1), kind)], names=["doc_key", "names", "links"])

    pair = "array<struct<a:string,b:string>>"
    told = saved(transcripts.select(F.col("doc_key").cast("string").alias("doc_key"), "text").mapInArrow(run, f"doc_key string, names {pair}, links {pair}"), "extracted")
    return (told.select("doc_key", F.inline("names")).toDF("doc_key", "name", "entity_type").dropDuplicates(["doc_key", "name"]),
            told.select("doc_key", F.inline("links")).toDF("doc_key", "source", "target").distinct())


def senders(messages: DataFrame) -> DataFrame:
    """Mentions of those who wrote: doc_key, name, entity_type person, once each. messages: doc_key, sender_name."""
    return messages.where("sender_name is not null").select(F.col("doc_key").cast("string").alias("doc_key"), F.col("sender_name").alias("name"), F.lit("person").alias("entity_type")).distinct()


def cooccurrence(mentions: DataFrame, chunk: int = 256) -> DataFrame:
    """source, target, weight: the number of documents that name both, source before target in order of name.

    mentions: doc_key, name. A document's names are dealt to chunks of about chunk by hash; each chunk meets all names of
    the document, so that no task gathers the pairs of a document with many. Null names and documents name nothing.
    """
    own = saved(mentions.where("name is not null and doc_key is not null").select("doc_key", "name").distinct(), "named")
    chunks = own.groupBy("doc_key").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    dealt = own.join(chunks, "doc_key")
    left = dealt.select("doc_key", F.pmod(F.xxhash64("name"), "chunks").cast("int").alias("part"), F.col("name").alias("source"))
    right = dealt.select("doc_key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"), F.col("name").alias("target"))
    return left.join(right, ["doc_key", "part"]).where("source < target").groupBy("source", "target").agg(F.count("*").alias("weight"))


def merge_entities(mentions: DataFrame) -> DataFrame:
    """name, entity_type (the most frequent, then the first by name), doc_keys, n_documents."""
    kinds = mentions.groupBy("name", "entity_type").agg(F.count("*").alias("n")).groupBy("name").agg(F.min_by("entity_type", F.struct((-F.col("n")).alias("n"), "entity_type")).alias("entity_type"))
    keys = mentions.groupBy("name").agg(F.array_sort(F.collect_set("doc_key")).alias("doc_keys"))
    return kinds.join(keys, "name").withColumn("n_documents", F.size("doc_keys"))


def merge_relations(links: DataFrame) -> DataFrame:
    """source, target, weight: documents that link them."""
    return links.groupBy("source", "target").agg(F.count_distinct("doc_key").alias("weight"))


def retract(mentions: DataFrame, keys: DataFrame) -> DataFrame:
    """mentions without those of the documents in keys."""
    return mentions.join(keys.select("doc_key"), "doc_key", "left_anti")


def clean_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First node of each name; first edge of each pair, without loops and edges to absent nodes."""
    n = nodes.withColumn("_nth", F.row_number().over(W.partitionBy("name").orderBy("ordinal"))).where("_nth = 1").drop("_nth")
    e = edges.where("source <> target").join(n.select(F.col("name").alias("source")), "source", "left_semi").join(n.select(F.col("name").alias("target")), "target", "left_semi")
    e = e.withColumn("_nth", F.row_number().over(W.partitionBy("source", "target").orderBy("ordinal"))).where("_nth = 1").drop("_nth")
    return n, e


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("name")).union(edges.select("target")).groupBy("name").agg(F.count("*").alias("degree"))


def type_legend(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(T.entity_type(F.col("entity_type")).alias("entity_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_type")


def cap_nodes(nodes: DataFrame, edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame, bool]:
    """(the most nodes of highest degree, then by name, with their degree; the edges between them; whether any is left out)."""
    d = nodes.join(degrees(edges), "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    kept = d.orderBy(F.desc("degree"), "name").limit(most)
    own = edges.join(kept.select(F.col("name").alias("source")), "source", "left_semi").join(kept.select(F.col("name").alias("target")), "target", "left_semi")
    return kept, own, not d.orderBy(F.desc("degree"), "name").offset(most).isEmpty()


def neighbourhood(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """name, hops of all nodes within depth (1 to 5) edges of start. Each round's frontier is written, and joins the edges."""
    if not 1 <= depth <= 5:
        raise ValueError("depth is 1 to 5")
    both = edges.select("source", "target").union(edges.select("target", "source"))
    seen = edges.sparkSession.createDataFrame([(start, 0)], "name string, hops int")
    front = seen
    for hops in range(1, depth + 1):
        reached = both.join(front.select(F.col("name").alias("source")), "source").select(F.col("target").alias("name")).distinct()
        front = saved(reached.join(seen, "name", "left_anti").withColumn("hops", F.lit(hops)), "frontier")
        seen = seen.union(front)
    return seen


def expand(edges: DataFrame, start: str, depth: int, most: int) -> tuple[DataFrame, bool]:
    """(name, hops, degree of at most most nodes within depth (1 to 5) edges of start; whether any was left out).

    Each round takes the new nodes of highest degree, then by name, as far as there is room. A round's frontier has at
    most most rows, and is broadcast to the edges, which stay where they are; so a hub's neighbours are found by all tasks
    that hold them, and only the best most of them are gathered.
    """
    if not 1 <= depth <= 5:
        raise ValueError("depth is 1 to 5")
    both = edges.select("source", "target").where("source <> target")
    both = both.union(both.select("target", "source")).toDF("source", "target")
    degree = saved(degrees(edges), "degrees")
    seen = edges.sparkSession.createDataFrame([(start, 0)], "name string, hops int").join(degree, "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    front, n, cut = seen, 1, False
    for hops in range(1, depth + 1):
        reached = both.join(F.broadcast(front.select(F.col("name").alias("source"))), "source").select(F.col("target").alias("name")).distinct()
        new = reached.join(F.broadcast(seen.select("name")), "name", "left_anti").join(degree, "name").select("name", F.lit(hops).alias("hops"), "degree")
        front = saved(new.orderBy(F.desc("degree"), "name").limit(most - n + 1), "frontier")  # one more tells whether any is left out
        got = front.count()
        cut |= got > most - n
        front = front.orderBy(F.desc("degree"), "name").limit(most - n)
        seen, n = seen.union(front), min(most, n + got)
        if not got or n >= most and cut:
            break
    return seen, cut


def search_entities(nodes: DataFrame, needle: str, most: int = 8) -> DataFrame:
    """Names that begin with needle, then those that hold it, in their order, whatever the case."""
    low = F.lower("name")
    tier = F.when(low.startswith(needle.lower()), 0).when(low.contains(needle.lower()), 1)
    return nodes.withColumn("tier", tier).where("tier is not null").orderBy("tier", "ordinal").limit(most)


def entity_detail(entities: DataFrame, relations: DataFrame, manifest: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the entity of that name, else of that name in another case; its relations; its documents with thread, span and
    number of messages, unknown keys too)."""
    exact = F.when(F.col("name") == name, 0).otherwise(1)
    one = entities.where(F.lower("name") == name.lower()).withColumn("_t", exact).orderBy("_t", "name").limit(1).drop("_t")
    own = one.select(F.col("name").alias("_own"))
    rel = relations.join(own, (F.col("source") == F.col("_own")) | (F.col("target") == F.col("_own"))).drop("_own")
    docs = one.select(F.explode("doc_keys").alias("doc_key")).join(manifest.select("doc_key", "thread_name", "span", F.size("message_guids").alias("n_messages")), "doc_key", "left")
    return one, rel, docs


def facts(relations: DataFrame) -> DataFrame:
    """source, target, fact of relations that say something."""
    said = F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.nullif(F.trim("label"), F.lit("")))
    return relations.withColumn("_said", said).where("_said is not null").select("source", "target", F.concat("source", F.lit(" -> "), "target", F.lit(": "), "_said").alias("fact"))


def dedupe_excerpts(excerpts: DataFrame) -> DataFrame:
    """The first excerpt of each doc_key (ordinal, doc_key, thread_name, thread_id, text), with the first thread name that
    is more than an id."""
    line = W.partitionBy("doc_key").orderBy("ordinal").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    named = F.first(F.when(F.col("thread_name") != F.col("thread_id"), F.col("thread_name")), ignorenulls=True).over(line)
    first = F.row_number().over(W.partitionBy("doc_key").orderBy("ordinal"))
    return excerpts.withColumns({"_name": named, "_nth": first}).where("_nth = 1").withColumn("thread_name", F.coalesce("_name", "thread_name")).drop("_name", "_nth")


def provenance(citations: DataFrame, manifest: DataFrame) -> DataFrame:
    """question, guids: distinct message guids of the documents whose keys stand in the citations (question, ordinal,
    citation), in the order met. A key inside a longer one found in the same string does not count.

    Keys are looked up by the thread part before '::', which every hit shares with its string, so the join is an equi-join.
    """
    threads = F.array_distinct(F.regexp_extract_all("citation", F.lit(r"([^\s,;<>()\[\]\"']+)::")))
    cited = citations.withColumn("thread_id", F.explode(threads))
    keyed = manifest.select("doc_key", "message_guids", F.substring_index("doc_key", "::", 1).alias("thread_id"))
    hits = cited.join(keyed, "thread_id").where(F.col("citation").contains(F.col("doc_key"))).drop("thread_id")
    hits = hits.dropDuplicates(["question", "ordinal", "doc_key"])
    inside = hits.alias("a").join(hits.alias("b"), (F.col("a.question") == F.col("b.question")) & (F.col("a.ordinal") == F.col("b.ordinal")) & (F.col("a.doc_key") != F.col("b.doc_key")) & F.col("b.doc_key").contains(F.col("a.doc_key")))
    short = inside.select("a.question", "a.ordinal", "a.doc_key").distinct()
    kept = hits.join(short, ["question", "ordinal", "doc_key"], "left_anti")
    each = kept.withColumn("at", F.expr("locate(doc_key, citation)"))
    each = each.select("question", "ordinal", "at", F.posexplode("message_guids").alias("nth", "guid"))
    first = each.groupBy("question", "guid").agg(F.min(F.struct("ordinal", "at", "nth")).alias("met"))
    return first.groupBy("question").agg(F.transform(F.array_sort(F.collect_list(F.struct("met", "guid"))), lambda x: x["guid"]).alias("guids"))


def match_citations(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """citation_id, source, tier of the best piece of evidence (source, rank) for each cited path: the same path, one that
    ends with it after a slash, or one of the same file name, whatever the case; then the best rank."""
    base = lambda c: F.lower(T.file_name(F.col(c)))
    a = citations.withColumn("_base", base("cited"))
    b = evidence.withColumn("_base", base("source"))
    cited, source = F.lower("cited"), F.lower("source")
    tier = F.when(cited == source, 1).when(source.endswith(F.concat(F.lit("/"), cited)), 2).when(~F.col("cited").contains("/"), 3)
    met = a.join(b, "_base").withColumn("tier", tier).where("tier is not null")
    best = W.partitionBy("citation_id").orderBy("tier", "rank", "source")
    return met.withColumn("_nth", F.row_number().over(best)).where("_nth = 1").select("citation_id", "source", "tier")


def graph_stats(entities: DataFrame, relations: DataFrame | None, manifest: DataFrame) -> DataFrame:
    """Sizes; null where a part is not reported."""
    n = entities.agg(F.count("*").alias("entities"))
    r = relations.agg(F.count("*").alias("relations")) if relations is not None else n.select(F.lit(None).cast("long").alias("relations"))
    m = manifest.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size("message_guids")), F.lit(0)).alias("messages"))
    return n.crossJoin(r).crossJoin(m)  # three single rows


def graph_context(fact_lines: DataFrame, excerpts: DataFrame, most: int, by: str = "question") -> DataFrame:
    """by and its context: facts first, then excerpts in what room is left; sections without content are left out."""
    # Facts that begin beyond the room left are not gathered.
    line = W.partitionBy(by).orderBy("fact").rowsBetween(W.unboundedPreceding, -1)
    near = fact_lines.select(by, "fact").distinct().withColumn("_before", F.coalesce(F.sum(F.length("fact") + 1).over(line), F.lit(0))).where(F.col("_before") <= most)
    f = near.groupBy(by).agg(F.concat(F.lit("Facts:\n"), F.array_join(F.array_sort(F.collect_list("fact")), "\n")).alias("facts"))
    e = excerpts.groupBy(by).agg(F.concat(F.lit("Excerpts:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n")).alias("excerpts"))
    both = f.join(e, by, "full_outer")
    return both.select(by, T.truncate_with_ellipsis(F.concat_ws("\n\n", "facts", "excerpts"), most).alias("context"))


def term_match(queries: DataFrame, rows: DataFrame, key: str, text: Column, k: int) -> DataFrame:
    """query_id, key, score of the k rows that share the most query terms."""
    asked = queries.select("query_id", F.explode(T.query_terms(F.col("text"))).alias("term"))
    held = rows.select(key, F.explode(F.array_distinct(T.words(text))).alias("term"))
    met = asked.join(held, "term").groupBy("query_id", key).agg(F.count("*").alias("score"))
    return met.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), key))).where(F.col("rank") <= k)


def graph_retrieve(questions: DataFrame, entities: DataFrame, relations: DataFrame, transcripts: DataFrame, mode: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(relations found: query_id, source, target; transcripts found: query_id, doc_key). local takes the entities nearest
    to the question and their relations, global the nearest relations, hybrid both, naive transcripts alone, mix all."""
    modes = ("global", "hybrid", "local", "mix", "naive")
    if mode not in modes:
        raise KeyError(f"unknown mode {mode}; there are: {', '.join(modes)}")
    empty = questions.where("1 = 0").select("query_id", F.lit("").alias("source"), F.lit("").alias("target"))
    found, docs = empty, questions.where("1 = 0").select("query_id", F.lit("").alias("doc_key"))
    if mode in ("local", "hybrid", "mix"):
        near = term_match(questions, entities, "name", F.col("name"), k)
        ends = relations.select("source", "target", F.explode(F.array("source", "target")).alias("name"))
        found = found.union(near.join(ends, "name").select("query_id", "source", "target"))
    if mode in ("global", "hybrid", "mix"):
        keyed = relations.withColumn("pair", F.concat_ws("\x1f", "source", "target"))
        near = term_match(questions, keyed, "pair", F.concat_ws(" ", "source", "target"), k)
        found = found.union(near.join(keyed, "pair").select("query_id", "source", "target"))
    if mode in ("naive", "mix"):
        docs = term_match(questions, transcripts, "doc_key", F.col("text"), k).select("query_id", "doc_key")
    return found.distinct(), docs
