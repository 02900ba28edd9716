"""Centroid clustering in exact integers by sort-means.

Each round orders, for every centroid, the other centroids by their distance from it. A vector starts at the centroid it
was assigned to in the round before and looks at the others in that order, until one stands strictly beyond twice its
distance from the start: neither that one nor any later one can be nearer, or as near with a smaller number.

The vectors are written once, in blocks of some thousand rows, as a table bucketed by block. What a round decides, one
number a vector and the sums of each block, is a table with the same buckets, so the next round joins the two without a
shuffle, reads the vectors once and never writes them again. The driver gets the sums of all blocks added up.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, remove, shared_dir

#: Vectors of a block.
BLOCK = 4096
#: Components whose squares and sums stay far within 64 bits; larger ones are counted in Python's integers.
SAFE = 1 << 27
#: Sums leave a task in digits of this base, so that they are exact at any size.
DIGIT_BITS = 40
LARGEST = (1 << 63) - 1


def finite_vectors(column: str, dim: int | None = None) -> Column:
    """Whether a vector has components (``dim`` of them, if given), none of them null, NaN or infinite."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    size = F.size(column) > 0 if dim is None else F.size(column) == dim
    return F.coalesce(size & fine, F.lit(False))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each value; an array of Python's integers where one is too large for exact squares."""
    if not values.size or np.abs(values).max() * scale < SAFE:
        return np.floor(values * scale).astype(np.int64)
    # A value beyond 2**53 is an integer, so it is scaled as one.
    exact = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


class Centroids:
    """Centroids (lists of integers) with each one's order of the others."""

    def __init__(self, rows: list[list[int]]):
        small = all(abs(x) < SAFE for row in rows for x in row)
        self.rows = np.array(rows, np.int64 if small else object)
        self.apart = np.array([squared(self.rows, c) for c in self.rows])
        self.order = [sorted((j for j in range(len(rows)) if j != i), key=lambda j: (self.apart[i][j], j)) for i in range(len(rows))]

    def assign(self, vectors: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The number of each vector's nearest centroid, its squared distance, and how many distances that took."""
        label, best, looked = before.copy(), np.zeros(len(vectors), vectors.dtype if self.rows.dtype != object else object), 0
        for start in np.unique(before):
            at = np.flatnonzero(before == start)
            from_start = squared(vectors[at], self.rows[start])
            # The farthest from the start first: those that go on looking are always the first ones.
            far = np.argsort(-from_start, kind="stable")
            at, from_start = at[far], from_start[far]
            near, number = from_start.copy(), np.full(len(at), start, label.dtype)
            looked += len(at)
            open_rows = len(at)
            for j in self.order[start]:
                while open_rows and self.apart[start][j] > 4 * from_start[open_rows - 1]:
                    open_rows = int(np.count_nonzero(4 * from_start[:open_rows] >= self.apart[start][j]))
                if not open_rows:
                    break
                d = squared(vectors[at[:open_rows]], self.rows[j])
                better = (d < near[:open_rows]) | ((d == near[:open_rows]) & (j < number[:open_rows]))
                near[:open_rows][better] = d[better]
                number[:open_rows][better] = j
                looked += open_rows
            label[at], best[at] = number, near
        return label, best, looked


def squared(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    off = vectors - centre
    return (off * off).sum(axis=1)


def _blocks(vectors: DataFrame, dim: int) -> DataFrame:
    """block, ids, packed: the vectors (id, vector) in the rows of their partition, BLOCK at a time."""
    wide = "double" in dict(vectors.dtypes)["vector"]
    kind = np.float64 if wide else np.float32

    def run(batches):
        number, ids, parts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def block(n):
            nonlocal ids, parts, held, number
            matrix = np.concatenate(parts)
            out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids[:n]], pa.list_(pa.int64())), pa.array([matrix[:n].tobytes()], pa.binary())], ["block", "ids", "packed"])
            ids, parts, held, number = ids[n:], [matrix[n:]], held - n, number + 1
            return out

        for batch in batches:
            ids += batch.column(0).to_pylist()
            parts.append(np.asarray(batch.column(1).flatten(), kind).reshape(-1, dim))
            held += batch.num_rows
            while held >= BLOCK:
                yield block(BLOCK)
        if held:
            yield block(held)

    return vectors.mapInArrow(run, "block long, ids array<long>, packed binary")


def _stored(rows: DataFrame, buckets: int) -> tuple[str, str]:
    """Write ``rows`` bucketed by block in the shared folder: its name in the catalog, and its path."""
    name = f"blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(rows.sparkSession)}/{name}"
    rows.write.bucketBy(buckets, "block").sortBy("block").format("parquet").option("path", path).saveAsTable(name)
    return name, path


def _digits(total: int) -> list[int]:
    """``total`` in digits of the base, lowest first; the last one has the sign."""
    out = []
    while not -(1 << DIGIT_BITS) < total < 1 << DIGIT_BITS:
        out.append(total & ((1 << DIGIT_BITS) - 1))
        total >>= DIGIT_BITS
    return [*out, total]


def _sums(vectors: np.ndarray, label: np.ndarray) -> list[tuple[int, int, int, int]]:
    """cluster, component (-1: the number of vectors), digit, value: what the vectors of a block add to each cluster."""
    out = []
    for c in np.unique(label).tolist():
        mine = vectors[label == c]
        for i, total in enumerate([len(mine), *mine.sum(axis=0).tolist()], -1):
            out += [(c, i, digit, v) for digit, v in enumerate(_digits(total))]
    return out


SUMS = pa.list_(pa.struct([("cluster", pa.int32()), ("at", pa.int32()), ("digit", pa.int32()), ("v", pa.int64())]))


def _added_up(sums: DataFrame) -> dict[tuple[int, int], int]:
    """The totals of (cluster, component), at most k * (dimension + 1) numbers of a few digits."""
    total: dict[tuple[int, int], int] = {}
    rows = sums.select(F.inline("sums")).groupBy("cluster", "at", "digit").agg(F.sum("v"))
    for cluster, at, digit, v in rows.collect():
        total[cluster, at] = total.get((cluster, at), 0) + (v << (DIGIT_BITS * digit))
    return total


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector with ``dim`` finite components.

    A component x counts as the integer floor(scale * x). Centroids start as the k vectors with the smallest sha256 of
    ``<seed>:<id>``; each round assigns all vectors (squared Euclidean distance, ties to the smaller number) and moves
    every centroid that has vectors to floor(sum / count); they are assigned once more at the end.

    Null vectors, those of another size and those with a null, NaN or infinite component have no row. Null ids are
    clustered like others; they come last among possible starts. Of rows that repeat an id, the starts are taken in the
    order of their components. With fewer than k vectors there are as many centroids as vectors; an empty table gives
    an empty result. A squared distance or a sum beyond a 64-bit integer is null. Other columns are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(finite_vectors("vector", dim))
    kind = np.float64 if "double" in dict(kept.dtypes)["vector"] else np.float32
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(named.asc_nulls_last(), "vector").limit(k).collect()
    centres = [[int(x) for x in integers(np.array(r.vector, np.float64), scale).tolist()] for r in first]
    buckets = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(kept.count() / BLOCK)))
    table, path = _stored(_blocks(kept, dim).repartition(buckets, "block"), buckets)
    labels, labels_path, used = None, None, [path]

    def decided(centroids: Centroids, before: str | None, last: bool) -> DataFrame:
        blocks = spark.table(table) if last else spark.table(table).drop("ids").withColumn("ids", F.lit(None).cast("array<bigint>"))
        if before is None:
            blocks = blocks.withColumn("labels", F.lit(None).cast("binary"))
        else:  # both have the same buckets; the small side is hashed, so that the vectors are neither shuffled nor sorted
            blocks = blocks.join(spark.table(before).select("block", "labels").hint("shuffle_hash"), "block")

        def run(batches):
            for batch in batches:
                for block, ids, packed, labels in zip(*batch.columns, strict=True):
                    x = integers(np.frombuffer(packed.as_buffer(), kind).reshape(-1, dim).astype(np.float64), scale)
                    start = np.frombuffer(labels.as_buffer(), np.int32) if labels.is_valid else np.zeros(len(x), np.int32)
                    label, best, _ = centroids.assign(x, start)
                    if last:
                        distance = [d if d <= LARGEST else None for d in best.tolist()]
                        yield pa.RecordBatch.from_arrays([ids.values.cast(pa.int64()), pa.array(label, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])
                    else:
                        sums = [dict(zip(("cluster", "at", "digit", "v"), r, strict=True)) for r in _sums(x, label)]
                        yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([label.tobytes()], pa.binary()), pa.array([sums], SUMS)], ["block", "labels", "sums"])

        fields = "vec_id long, cluster int, distance long" if last else "block long, labels binary, sums array<struct<cluster int, at int, digit int, v long>>"
        return blocks.select("block", "ids", "packed", "labels").mapInArrow(run, fields)

    for _ in range(rounds if centres else 0):
        before = labels
        labels, labels_path = _stored(decided(Centroids(centres), before, False), buckets)
        used.append(labels_path)
        if before is not None:
            _forget(spark, before, used.pop(-2))
        total = _added_up(spark.table(labels).select("sums"))
        centres = [[total[c, i] // total[c, -1] for i in range(dim)] if (c, -1) in total else row for c, row in enumerate(centres)]
    found = materialize(decided(Centroids(centres), labels, True), "clusters")
    for name, where in zip([table, labels], used, strict=False):
        _forget(spark, name, where)
    summed = F.when(F.count_if(F.col("distance").isNull()) == 0, F.sum(F.col("distance").cast("decimal(38,0)")))
    inertia = {r.cluster: r.d for r in found.groupBy("cluster").agg(summed.alias("d")).collect()}
    whole = None if None in inertia.values() else sum(int(d) for d in inertia.values())
    fits = lambda d: None if d is None or d > LARGEST else int(d)
    rows = [(c, fits(inertia.get(c)), fits(whole), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for c in range(len(centres))]
    per = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _forget(spark: SparkSession, name: str, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    remove(spark, path)
