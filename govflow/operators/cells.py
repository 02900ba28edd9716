"""Approximate nearest neighbours with a filter: vectors in cells around centres, of which a query reads the nearest.

The centres are fitted on a bounded sample; every row is in the cell of its nearest centre and is written to that cell's
folder. A search reads the folders of the cells it probes, applies its filter in that scan, and scores what passes
exactly, so only neighbours in cells that aren't probed can be missed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable, new_path
from .retrieval import _blocks, _cosines, _keep_best, top_k

#: Rows of the sample, rounds of the fit, most cells, rows that the number of probed cells is fitted on, and the share of
#: their neighbours that it has to reach.
SAMPLE, ROUNDS, MOST_CELLS, TRIED, REACHED = 20_000, 8, 1024, 400, 0.97


@dataclass
class Cells:
    """``path``: a table (chunk_key, vector, metadata) by cell; the centres, how many of them a query probes, and the rows' columns."""

    path: str
    centres: np.ndarray
    probed: int
    fields: str


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, float)
    norms = np.sqrt((x * x).sum(axis=1))[:, None]
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def _fit(sample: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, int]:
    rng = np.random.default_rng(7)
    n = max(1, min(round(math.sqrt(rows)), MOST_CELLS, len(sample) // 8))
    distinct = np.unique(sample, axis=0)
    n = min(n, len(distinct))
    centres = distinct[rng.choice(len(distinct), n, replace=False)]
    for _ in range(ROUNDS):
        home = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        norms = np.sqrt((sums * sums).sum(axis=1))[:, None]
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    home, places = (sample @ centres.T).argmax(axis=1), []
    for i in rng.choice(len(sample), min(TRIED, len(sample)), replace=False):
        near = sample @ sample[i]
        near[i] = -np.inf
        order = np.argsort(-(centres @ sample[i]), kind="stable")
        place = np.empty(n, int)
        place[order] = np.arange(n)
        places += place[home[np.argsort(-near)[: min(k, len(sample) - 1)]]].tolist()
    return centres, (int(np.quantile(places, REACHED, method="higher")) + 1 if places else n)


def build(vectors: DataFrame, k: int = 10) -> Cells:
    """Cells of ``vectors`` (chunk_key, vector, any metadata), all of one size; null vectors and other sizes than the first
    sampled one are in no cell. An empty table has no centres."""
    spark = vectors.sparkSession
    known = vectors.where("vector is not null and size(vector) > 0")
    total = known.count()
    share = min(1.0, SAMPLE / max(1, total))
    drawn = [r[0] for r in known.where(F.pmod(F.xxhash64("chunk_key"), F.lit(1_000_000)) < share * 1_000_000).select("vector").limit(2 * SAMPLE).collect()] or [r[0] for r in known.select("vector").limit(1).collect()]
    size = len(drawn[0]) if drawn else 0
    centres, probed = _fit(_unit([v for v in drawn if len(v) == size]), total, k) if drawn else (np.zeros((0, 0)), 0)
    schema = vectors.schema

    def run(batches):
        for batch in batches:
            rows = _unit(batch.column("vector").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((rows @ centres.T).argmax(axis=1), pa.int32())], [*batch.schema.names, "cell"])

    path, fields = new_path(spark, "vector-cells"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    usable = known.where(F.size("vector") == size)
    dealt = usable.mapInArrow(run, f"{fields}, cell int") if drawn else usable.withColumn("cell", F.lit(0))
    # A cell with many rows is written by several tasks, each row to one of eight by its key.
    dealt.repartition("cell", F.pmod(F.xxhash64("chunk_key"), F.lit(8))).write.partitionBy("cell").parquet(path)
    return Cells(path, centres, probed, f"{fields}, cell int")


def search(cells: Cells, queries: DataFrame, k: int = 10, where: Column | None = None, probed: int | None = None) -> DataFrame:
    """query_id, rank, chunk_key, vec_score: the k best found of each query (query_id, vector), ties by key.

    ``where`` is a condition on the metadata; it is applied where the cells are read. With ``probed`` as large as the
    number of cells the result is exact.
    """
    spark, kind = queries.sparkSession, dict(queries.dtypes)["query_id"]
    probed, out = probed or cells.probed, []
    key_type = pa.string() if "`chunk_key` string" in cells.fields else pa.int64()
    key_kind = "string" if key_type == pa.string() else "bigint"
    fields = f"query_id {kind}, chunk_key {key_kind}, vec_score double"
    usable = queries.select("query_id", "vector").where(F.col("vector").isNotNull() & (F.size("vector") == cells.centres.shape[1]))
    for block in _blocks(usable):
        ids, given = [q.query_id for q in block], [q.vector for q in block]
        order = np.argsort(-(_unit(given) @ cells.centres.T), axis=1, kind="stable")[:, :probed]
        asked_in: dict[int, list[int]] = {}
        for i, row in enumerate(order.tolist()):
            for cell in row:
                asked_in.setdefault(cell, []).append(i)
        rows = spark.read.schema(cells.fields).parquet(cells.path).where(F.col("cell").isin(sorted(asked_in)))
        rows = rows.where(where) if where is not None else rows

        def run(batches, ids=ids, given=given, asked_in=asked_in):
            best, floor = [[] for _ in ids], np.full(len(ids), -np.inf)
            asked_vectors = [np.array(v, float) for v in given]
            for batch in batches:
                keys, vectors, where_of = batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.asarray(batch.column(2))
                for cell in np.unique(where_of).tolist():
                    mine, asked = np.flatnonzero(where_of == cell), asked_in[cell]
                    scores, names = _cosines([vectors[i] for i in mine], [asked_vectors[i] for i in asked]), [keys[j] for j in mine]
                    for column in np.flatnonzero(np.fmax.reduce(scores, axis=0) >= floor[asked]).tolist():
                        _keep_best(best, floor, asked[column], scores[:, column], names, k)
            found = [(ids[i], key, -score) for i, held in enumerate(best) for score, key in held]
            types = [pa.array(ids).type, key_type, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [()] * 3, types, strict=True)], ["query_id", "chunk_key", "vec_score"])

        out.append(durable(top_k(rows.select("chunk_key", "vector", "cell").mapInArrow(run, fields), "vec_score", k), "cells-top"))
    if not out:
        return queries.select("query_id", F.lit(0).alias("rank"), F.lit(None).cast(key_kind).alias("chunk_key"), F.lit(0.0).alias("vec_score")).where(F.lit(False))
    return reduce(DataFrame.union, out).select("query_id", "rank", "chunk_key", "vec_score")


def scanned(cells: Cells, queries: DataFrame, where: Column | None = None) -> tuple[int, int]:
    """How many scores a search computes, and how many a scan of all rows would."""
    spark = queries.sparkSession
    rows = spark.read.schema(cells.fields).parquet(cells.path)
    held = dict(map(tuple, (rows.where(where) if where is not None else rows).groupBy("cell").count().collect()))
    done = asked = 0
    for block in _blocks(queries.select("query_id", "vector").where(F.size("vector") == cells.centres.shape[1])):
        order = np.argsort(-(_unit([q.vector for q in block]) @ cells.centres.T), axis=1, kind="stable")[:, : cells.probed]
        done += sum(held.get(c, 0) for row in order.tolist() for c in row)
        asked += len(block)
    return done, asked * sum(held.values())


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact rows (query_id, chunk_key) that were found."""
    hit = exact.join(found.select("query_id", "chunk_key"), ["query_id", "chunk_key"], "left_semi").count()
    return hit / max(1, exact.count())
