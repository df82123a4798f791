"""Corpus pipeline: quality, near duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and read again as the
next stage's ``docs``. All stages but the last return the columns of documents, whatever their names and whatever
columns come besides. Near duplicates are taken on five-word shingles at a similarity of 0.8 or more. Nulls, empty
and very long texts, repeated rows and empty tables have the results that the stages' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import jaccard, mixing, packing, pii, quality
from millrace.llm.queries import vocabulary_path
from millrace.llm.scratch import small_batches, write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source. A null or empty text fails; an empty table stays empty."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id. Rows without id, and texts without words, stay; of rows that share an id one stays."""
    return jaccard.one_of_each(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and secrets replaced by their kind. Every row stays; a null text stays null."""
    return pii.redact(docs)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents by calibrated probabilities. A null source, language or topic is a value of its own; rows without id are drawn by their text."""
    small_batches(spark)
    return mixing.sample(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and place. A null or empty text is one piece of one token; rows that share an id are packed each."""
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("target_weights", target_weights),
    ("best_fit_packing", best_fit_packing),
]

#: Rolling windows, covariance estimates, graph scores and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
