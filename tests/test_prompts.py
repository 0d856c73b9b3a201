"""Passages, contexts and prompts given by the caller."""

from pyspark.sql import functions as F

from sparkrag.functions import text as T
from sparkrag.operators import chunking, search


def test_passages_steer_queries_that_have_a_usable_one(spark):
    queries = spark.createDataFrame([(i, f"q{i}") for i in range(6)], "query_id long, text string")
    passages = spark.createDataFrame([(0, "An answer."), (1, "  "), (2, "x" * 50), (3, None), (4, "<think>hm</think>Passage: said so")], "query_id long, passage string")
    embed = lambda df, text, mode: df.withColumn("vector", F.concat(F.lit(mode + " "), text))
    got = {r["query_id"]: (r["vector"], r["expanded"]) for r in search.hypothetical_vectors(queries, passages, embed, 40).collect()}
    assert got == {0: ("passage An answer.", True), 1: ("query q1", False), 2: ("query q2", False), 3: ("query q3", False), 4: ("passage said so", True), 5: ("query q5", False)}
    assert {r["vector"] for r in search.hypothetical_vectors(queries, None, embed).collect()} == {f"query q{i}" for i in range(6)}


def test_contexts_by_a_function(spark):
    docs = spark.createDataFrame([(1, "abcdefgh"), (2, None)], "doc_id long, text string")
    chunks = spark.createDataFrame([(1, 0, "c"), (1, 1, "blank"), (2, 0, "x"), (9, 0, "y"), (1, 2, None)], "doc_id long, chunk_index int, content string")
    got = {(r["doc_id"], r["chunk_index"]): r["context"] for r in chunking.contextualize_with(chunks, docs, lambda d, c: " " if c == "blank" else f" {c} of {d} ", 3).collect()}
    assert got == {(1, 0): "c of abc", (1, 1): None, (2, 0): None, (9, 0): None, (1, 2): None}


def test_templates_and_histories(spark):
    df = spark.sql("select array(struct('user' as role, 'a {x}' as content), struct('assistant' as role, 'b' as content)) as h, 'q {history}' as q union all select null, null")
    got = [r[0] for r in df.select(T.filled("{{<}}{history}|{query}>", history=T.format_history(F.col("h")), query=F.col("q")).alias("p")).collect()]
    assert got == ["{<}user: a {x}\nassistant: b|q {history}>", "{<}|>"]
