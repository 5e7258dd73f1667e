"""Corpus pipeline: what a raw corpus goes through before training.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next stage's input.  All but the last return the columns of
``docs``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontam, dedup, langid, packing, pii, store


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that no centroid is near to go.

    Null and empty texts and those without a letter go; repeated rows are judged alike.
    """
    return langid.keep_recognised(docs, langid.fit(docs, F.lit(True)))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id.

    Rows of one id and set collapse; rows of an id with other texts, null and
    empty texts, and rows without an id stay.
    """
    return dedup.keep_one(docs, owner="pipeline-dedup")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts stay; rows that repeat an id go or stay together.
    """
    store.release(spark, "pipeline-dedup")  # that stage's result is written by now
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), owner="pipeline-decontam")


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data, secrets and disclosing terms out of their texts; null and empty ones as they are."""
    store.release(spark, "pipeline-decontam")
    return pii.sanitise(docs, owner="pipeline-pii")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids; a null or empty text is its end alone, repeated rows are documents."""
    store.release(spark, "pipeline-pii")
    return packing.pack(docs, owner="pipeline-packing")


STAGES = [
    ("language", identify_language),
    ("dedup", remove_near_duplicates),
    ("decontaminate", decontaminate),
    ("pii", sanitise),
    ("packing", pack),
]

#: Language centroids, sanitised texts and token ids can't be expressed in SQL; tests/llm/test_queries.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.table(stage(spark, docs, sf_dir), name, "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
