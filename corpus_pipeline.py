"""The corpus pipeline: stages over ``documents``, each written and read again by the next.

Edge cases, for every stage: null and empty texts have no language and go with the first stage, a stage
that meets them keeps them as texts of their own; null doc_ids, languages and sources are values like
others; a text of any length is read whole; of rows alike in all that a stage looks at, the first by
content stays, or one of them where they are alike in everything; repeated rows are copies; an empty
table gives an empty table; extra columns keep their values whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from tidemark.llm.catalog import WORD_BPE
from tidemark.session import shared_dir, tune


def _tuned(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents, in a session that bounds broadcasts and Python batches by bytes."""
    tune(spark)
    return docs


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without a letter go."""
    return language_id.with_known_language(_tuned(spark, docs))


def one_of_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal but for white space."""
    return exact_dedup.without_copies(_tuned(spark, docs))


def one_of_near_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group: five words, similarity 0.8."""
    return near_dedup.one_of_each(_tuned(spark, docs), width=5)


def weighted_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixing.mixed(_tuned(spark, docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return bpe.encode_and_decode(_tuned(spark, docs), WORD_BPE)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", one_of_equal_texts),
    ("near_dedup", one_of_near_texts),
    ("source_mix", weighted_sources),
    ("bpe_encoding", token_ids),
]
# The models of the first and third stage are not expressible in SQL; a brute-force test takes its place.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the tables between them go to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
