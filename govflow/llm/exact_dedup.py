"""Exact duplicates by skew-safe combining of salted digest groups.

Three combining stages, each of which compares full content because the content is a grouping key:

1. local: Spark's map-side partial aggregation collapses the copies that one task reads;
2. salted: what is left of a digest is merged in ``SALTS`` separate groups, so that a digest with a third of all rows
   never meets in one task;
3. global: at most ``SALTS`` winners of a digest and content are merged.

The winners (without content) are then joined back to the rows by digest. Should two contents ever share a digest, the
rows of that digest are joined by digest and content instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, materialize

SALTS = 16


def dedup_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct content: digest, content, keep_id, group_size, variants (contents with this digest).

    ``content`` is null unless a digest has several contents.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("content"),
    ).select("id", "content", F.unhex(F.sha2("content", 256)).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    salted = rows.groupBy("digest", "salt", "content").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    merged = salted.repartition("digest").groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    per_digest = merged.groupBy("digest").agg(
        F.count(F.lit(1)).alias("variants"),
        F.max("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size"),
        F.when(F.count(F.lit(1)) > 1, F.collect_list(F.struct("content", "keep_id", "group_size"))).alias("contents"),
    )
    return materialize(per_digest, "dedup-groups")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with the row that stays for its content.

    Returns doc_id, keep_id (largest id of the equal contents), group_size, kept, text_sha256 (hex).

    A null text counts as the empty text. Null ids lose to any other id; a group of null ids only keeps all of them
    (keep_id null). Rows that repeat both id and content can't be told apart and share one decision. An empty table
    gives an empty result; other columns of ``docs`` are not read.
    """
    groups = dedup_groups(docs, id_col, text_col)
    content = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(content, 256)).alias("digest"))
    single = groups.where("variants = 1").select("digest", "keep_id", "group_size")
    joined = rows.join(single, "digest")
    if groups.where("variants > 1").limit(1).count():
        several = groups.where("variants > 1").select("digest", F.explode("contents").alias("c")).select("digest", F.col("c.content").alias("content"), "c.keep_id", "c.group_size")
        full = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("content"))
        joined = joined.unionByName(full.join(several, ["digest", "content"]).drop("content"))
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A null text counts as empty. Rows that repeat both id and text share one decision, so all of them stay or go; null ids
    lose to any other, and where a text has none but null ids, all its rows stay. An empty table stays empty.
    """
    keep_name, digest_name = fresh_name("keep"), fresh_name("digest")
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(keep_name), F.unhex("text_sha256").alias(digest_name))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    on = F.col(id_col).cast("long").eqNullSafe(F.col(keep_name)) & (digest == F.col(digest_name))
    return docs.join(kept, on, "left_semi")
