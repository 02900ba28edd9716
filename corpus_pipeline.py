"""Corpus pipeline: documents whose language can be told, exact and near duplicates removed, packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from govflow.llm import exact_dedup, language_id, near_dedup, packing
from govflow.llm.common import materialize


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (null, or without a letter) go; a null lang becomes the predicted one."""
    return language_id.with_language(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; see ``exact_dedup.keep_one`` for null ids and repeated rows."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id stays; see
    ``near_dedup.keep_one`` for null ids and repeated rows."""
    return near_dedup.keep_one(docs, k=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, packed into sequences of at most 2048 tokens. An empty table gives no pieces."""
    return packing.pack_documents(docs)


STAGES = [("language_id", tell_language), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("packing", pack)]

#: The stages are no SQL; the tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
