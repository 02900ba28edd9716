"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to its smallest neighbour (or itself)."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component (smallest reachable id) of every node of ``edges`` (u, v, both long).

    Loops, repeated and reversed edges are harmless; edges with a null end are none. Nothing but two totals of the
    edges goes to the driver. A step's minima are joined back to the edges, so no task holds a node's neighbours.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct()
    edges, before = materialize(edges, "edges"), None
    while True:
        total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not total[0] or tuple(total) == before:
            break
        before = tuple(total)
        edges = materialize(_small_star(_large_star(edges)), "edges")
    # All edges are stars now: node to smallest node.
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
