"""A training-corpus pipeline: five corpus operators, one after another.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps. All but
the last return the columns of ``documents``. Between stages the rows are
written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrubsearch.llm import langid, mixing, neardup, pii, spiece
from scrubsearch.llm.common import bounded_batches
from scrubsearch.session import scratch_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known; rejected ones go."""
    bounded_batches(spark)
    return langid.keep_identified(docs, "text", "lang", "source")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, 0.8."""
    bounded_batches(spark)
    return neardup.drop_near_duplicates(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by placeholders."""
    bounded_batches(spark)
    return pii.redact_column(docs, pii.train_on(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.apply_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids of every row."""
    bounded_batches(spark)
    return spiece.encode_documents(docs)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("pii", redact),
          ("mixing", mix), ("sentencepiece", tokenize)]

# Trigram tables, minima, boosted trees and merges have no SQL form; tests/llm
# holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_dir(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
