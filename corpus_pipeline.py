"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrag.llm import jaccard, langid, mixing, packing, pii
from sparkrag.llm.names import unused
from sparkrag.session import saved


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that language ID rejects go.

    Models are fitted on docs itself. Null, empty and letterless texts are rejected, and all rows if none has both a text
    and a lang. Kept rows keep all their columns, whatever their names; repeated rows stay or go together; ties between
    languages keep a row. No rows, no result rows.
    """
    into = unused(docs.columns, *langid.RESULT)
    return langid.identify(docs, langid.fit(docs), tuple(into)).where(~F.col(into[3])).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id (null last), the first of repeated rows.

    Null, empty and wordless texts are near nothing and all stay. Texts of any length are compared whole; kept rows keep
    all their columns, whatever their names. No rows, no result rows.
    """
    return jaccard.deduplicate(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked and disclosing terms taken out; no row goes.

    Null and empty texts stay as they are. Repeated rows are masked alike; of spans that overlap the first covers both.
    n_chars, where there is one, is counted anew; all other columns stay, whatever their names. No rows, no result rows.
    """
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, the last time perhaps only their first words.

    Rows of which nothing is taken go; null and empty texts have nothing to take. A null source is a source of its own.
    Repeated rows are taken each on its own; ties in the seeded order go by the row's place. n_chars, where there is one,
    is counted anew; all other columns stay, whatever their names. No rows, no result rows.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece of one token; texts of any length are cut and kept whole; a null doc_id stays
    null; repeated rows are packed each on its own. Other columns end here. No rows, no result rows.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}", compression="zstd")
    return docs
