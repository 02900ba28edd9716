"""Approximate nearest neighbours by cosine: inverted lists, scanned with adaptive numbers of dimensions.

Vectors are scaled to length one and rotated at random, so that the first d of D coordinates of a difference estimate its
length. Each list is kept in cells of bounded size whose rotated vectors stand in column blocks. A query scans the cells
of its nearest list in full; the k-th best cosine found there is its bound. In all other probed lists a candidate is
abandoned as soon as its partial distance over the blocks so far, scaled to all dimensions, exceeds the bound by more
than a hypothesis test allows. What is left is scored on the original vectors in double precision.

Lists, and how many of them a query probes, are fitted on a bounded sample; every row is in a list. Vectors of each size
have lists of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .centroids import finite_vectors
from .common import bounded_batches, materialize

#: Components of the sample that the lists are fitted on, and the lists of one size at most.
SAMPLE_VALUES, MOST_LISTS = 1 << 22, 4096
#: Rounds of the fit; sample rows that the number of probed lists is fitted on, and the share of their neighbours it has to reach.
FIT_ROUNDS, TRIED, REACHED = 8, 512, 0.985
#: Dimensions of a column block, and the strength of the test: an estimate is trusted within 1 + TEST / sqrt(d).
BLOCK_DIMS, TEST = 16, 2.1
#: Bytes of the rotated vectors of a cell, components of the queries that are sent together, and pairs scanned at a time.
CELL_BYTES, ASKED_VALUES, PAIRS = 2 << 20, 1 << 17, 1 << 21
SEED = 20_231


@lru_cache(maxsize=4)
def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED + size).normal(size=(size, size)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Divided by a power of two each, which changes no cosine but keeps squares within double precision."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def turned(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated."""
    x = scaled(vectors)
    return (x / np.sqrt((x * x).sum(axis=1))[:, None]).astype(np.float32) @ rotation(vectors.shape[1])


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``a`` and of ``b``."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)


@dataclass
class Lists:
    """The centres of the lists of one size of vectors, and how many lists a query probes."""

    centres: np.ndarray
    probed: int


def fit(sample: np.ndarray, rows: int, k: int) -> Lists:
    """Lists for ``rows`` vectors from a sample of them (turned already)."""
    number = max(1, min(round(math.sqrt(rows)), MOST_LISTS, len(sample) // 4))
    rng = np.random.default_rng(SEED)
    # Copies make no second centre as long as there is anything else.
    distinct = np.unique(sample, axis=0)
    number = min(number, len(distinct))
    centres = distinct[rng.choice(len(distinct), number, replace=False)]
    step = max(1, PAIRS // number)

    def homes() -> np.ndarray:
        return np.concatenate([gaps(sample[i : i + step], centres).argmin(axis=1) for i in range(0, len(sample), step)])

    for _ in range(FIT_ROUNDS):
        home = homes()
        sums, n = np.zeros_like(centres), np.bincount(home, minlength=number)
        np.add.at(sums, home, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    home = homes()
    places = []
    for i in rng.choice(len(sample), min(TRIED, len(sample)), replace=False):
        off = gaps(sample[i : i + 1], sample)[0]
        off[i] = np.inf
        near = np.argpartition(off, min(k, len(off)) - 1)[: min(k, len(off) - 1)]
        place = np.empty(number, int)
        place[np.argsort(gaps(sample[i : i + 1], centres)[0])] = np.arange(number)
        places += place[home[near]].tolist()
    probed = int(np.quantile(places, REACHED, method="higher")) + 1 if places else number
    return Lists(centres, probed)


def unpacked(packed: pa.Scalar, size: int, kind) -> np.ndarray:
    return np.frombuffer(packed.as_buffer(), kind).reshape(-1, size).astype(np.float64)


@dataclass
class Index:
    """``rows``: row, id, size, list, packed of every vector; ``cells``: the lists in column blocks; ``parts``: cells of each list."""

    fits: dict[int, Lists]
    rows: DataFrame
    cells: DataFrame
    parts: DataFrame
    kind: type


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> Index:
    """An index over all usable vectors: those with an id and with finite components that aren't all zero.

    Rows that repeat an id, or a vector, are rows of their own. An empty table gives an empty index.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    vector = F.col(vector_col).alias("vector")
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), vector).where(F.col("id").isNotNull() & finite_vectors("vector") & F.exists("vector", lambda x: x != 0))
    kind = np.float64 if "double" in dict(kept.dtypes)["vector"] else np.float32
    counts = {r.size: r.n for r in kept.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    fits = _fits(kept, counts, kind, k)
    shared = spark.sparkContext.broadcast(fits)

    def assign(batches):
        for batch in batches:
            vectors = batch.column(2)
            sizes = np.asarray(vectors.value_lengths())
            flat, ends = np.asarray(vectors.flatten(), kind), np.cumsum(sizes)
            lists, packed = np.zeros(len(sizes), np.int32), [flat[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)]
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                x = turned(np.stack([flat[ends[i] - size : ends[i]] for i in at]).astype(np.float64))
                lists[at] = gaps(x, shared.value[size].centres).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(lists), pa.array(packed, pa.binary())], ["row", "id", "size", "list", "packed"])

    numbered = kept.select(F.monotonically_increasing_id().alias("row"), "id", "vector")
    rows = materialize(numbered.mapInArrow(assign, "row long, id long, size int, list int, packed binary"), "ann-rows")
    # Lists of any length are dealt to cells of bounded size. There are at most MOST_LISTS lists of a size of vectors.
    per_cell = F.greatest(F.lit(1), F.floor(F.lit(CELL_BYTES) / (4 * F.col("size"))))
    parts = materialize(rows.groupBy("size", "list").agg(F.count(F.lit(1)).alias("n")).select("size", "list", F.ceil(F.col("n") / per_cell).cast("int").alias("parts")), "ann-parts")
    dealt = rows.join(F.broadcast(parts), ["size", "list"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
    keys = ["size", "list", "part"]
    cells = dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "row", "id", "packed").mapInArrow(_cells(kind), "size int, list int, part int, rows binary, ids binary, packed binary, turned binary")
    return Index(fits, rows, materialize(cells, "ann-cells"), parts, kind)


def _fits(kept: DataFrame, counts: dict[int, int], kind, k: int) -> dict[int, Lists]:
    """Lists of each size, fitted on a share of its rows by a hash of the id and the vector: SAMPLE_VALUES components in all."""
    if not counts:
        return {}
    wanted = {size: max(64, SAMPLE_VALUES // (size * len(counts))) for size in counts}
    share = F.create_map(*(F.lit(x) for size, n in counts.items() for x in (size, min(1.0, wanted[size] / n))))
    place = F.pmod(F.xxhash64("id", "vector"), F.lit(1_000_000)) / 1_000_000
    drawn = kept.where(place < F.element_at(share, F.size("vector"))).limit(2 * sum(wanted.values())).toArrow()
    vectors = drawn.column("vector").combine_chunks()
    by_size: dict[int, list[np.ndarray]] = {size: [] for size in counts}
    flat, at = np.asarray(vectors.flatten(), kind).astype(np.float64), 0
    for size in np.asarray(vectors.value_lengths()).tolist():
        by_size[size].append(flat[at : at + size])
        at += size
    out = {}
    for size, rows in by_size.items():
        if rows:
            out[size] = fit(turned(np.stack(rows)), counts[size], k)
        else:  # a single list, where a hash drew none
            out[size] = Lists(np.zeros((1, size), np.float32), 1)
    return out


def _cells(kind):
    def run(batches):
        key, rows, ids, packed = None, [], [], []

        def cell():
            x = turned(np.frombuffer(b"".join(packed), kind).reshape(len(rows), key[0]).astype(np.float64))
            columns = b"".join(np.ascontiguousarray(x[:, i : i + BLOCK_DIMS]).tobytes() for i in range(0, key[0], BLOCK_DIMS))
            values = [*key, np.array(rows, np.int64).tobytes(), np.array(ids, np.int64).tobytes(), b"".join(packed), columns]
            types = [pa.int32()] * 3 + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["size", "list", "part", "rows", "ids", "packed", "turned"])

        for batch in batches:
            for size, where, part, row, id_, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # Twice the intended size is never reached but by chance; a key may have several cells.
                if key and (key != (size, where, part) or len(rows) * size * 4 >= 2 * CELL_BYTES):
                    yield cell()
                    rows, ids, packed = [], [], []
                key = (size, where, part)
                rows.append(row)
                ids.append(id_)
                packed.append(vector)
        if rows:
            yield cell()

    return run


def _sent(index: Index, asked: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """The queries (row, id, size, packed, bound) for each cell of the lists that are ``first`` to ``last`` nearest (None:
    as many as the fit says), in rows of many queries: size, list, part, q_rows, q_packed, bounds."""
    kind, shared = index.kind, asked.sparkSession.sparkContext.broadcast(index.fits)

    def run(batches):
        held: dict[int, list] = {}

        def rows(size):
            lists, queries = shared.value[size], held.pop(size)
            x = np.frombuffer(b"".join(q[1] for q in queries), kind).reshape(-1, size)
            order = gaps(turned(x.astype(np.float64)), lists.centres).argsort(axis=1, kind="stable")
            begin = lists.probed if first is None else first
            end = lists.probed if last is None else last
            chosen = np.zeros(order.shape, bool)
            np.put_along_axis(chosen, order[:, begin:end], True, axis=1)
            ids, bounds = np.array([q[0] for q in queries], np.int64), np.array([np.nan if q[2] is None else q[2] for q in queries])
            out = []
            for where in np.flatnonzero(chosen.any(axis=0)).tolist():
                mine = chosen[:, where]
                out.append((size, where, ids[mine].tobytes(), x[mine].tobytes(), bounds[mine].tobytes()))
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            for at in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 64], strict=True), types, strict=True)], ["size", "list", "q_rows", "q_packed", "bounds"])

        for batch in batches:
            for row, size, packed, bound in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(size, []).append((row, packed, bound))
                if len(held[size]) * size >= ASKED_VALUES:
                    yield from rows(size)
        for size in list(held):
            yield from rows(size)

    sent = asked.select("row", "size", "packed", "bound").mapInArrow(run, "size int, list int, q_rows binary, q_packed binary, bounds binary")
    return sent.join(F.broadcast(index.parts), ["size", "list"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def survivors(queries: np.ndarray, blocks: list[np.ndarray], bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, candidate) that may be among the k best of the cell and reach the query's bound (a cosine; NaN: none),
    and how many block distances were computed. ``queries`` are turned, ``blocks`` the candidates' column blocks."""
    size = queries.shape[1]
    margin = 2e-5 * max(1.0, math.sqrt(size) / 8)
    most = np.where(np.isnan(bounds), np.inf, 2 - 2 * bounds)
    partial = np.zeros((len(queries), len(blocks[0])), np.float32)
    open_pairs = None  # all of them
    seen, looked = 0, 0
    for block in blocks:
        part = queries[:, seen : seen + block.shape[1]]
        if open_pairs is None or len(open_pairs[0]) * 4 > partial.size:
            partial += gaps(part, block)
            looked += partial.size
        else:
            q, c = open_pairs
            for at in range(0, len(q), PAIRS // 16):
                i, j = q[at : at + PAIRS // 16], c[at : at + PAIRS // 16]
                off = part[i] - block[j]
                partial[i, j] += (off * off).sum(axis=1)
            looked += len(q)
        seen += block.shape[1]
        trusted = 1.0 if seen == size else (1 + TEST / math.sqrt(seen)) ** 2
        limit = most * trusted * (seen / size) + margin
        if open_pairs is None:
            fine = partial <= limit[:, None]
            if not fine.all():
                open_pairs = np.nonzero(fine)
        else:
            q, c = open_pairs
            fine = partial[q, c] <= limit[q]
            open_pairs = q[fine], c[fine]
    if open_pairs is None:
        open_pairs = np.nonzero(np.ones(partial.shape, bool))
    q, c = open_pairs
    # Of what is left, a cell gives the k best of each query (and one more, as the query itself may be among them).
    if partial.shape[1] > k + 1:
        left = np.full(partial.shape, np.inf, np.float32)
        left[q, c] = partial[q, c]
        fine = partial[q, c] <= np.partition(left, k, axis=1)[q, k] + margin
        q, c = q[fine], c[fine]
    return q, c, looked


def _found(index: Index, asked: DataFrame, first: int | None, last: int | None, k: int) -> DataFrame:
    """query (row), vec_id, row, score: at most k of each cell that a query is sent to."""
    kind = index.kind

    def norms(x):
        return np.sqrt((x * x).sum(axis=1))

    def cell(size, q_rows, q_packed, bounds, rows, ids, packed, columns) -> Iterator[tuple[np.ndarray, ...]]:
        q_rows, bounds, rows, ids = np.frombuffer(q_rows, np.int64), np.frombuffer(bounds), np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64)
        asked, held = (scaled(np.frombuffer(x, kind).reshape(-1, size).astype(np.float64)) for x in (q_packed, packed))
        flat, blocks, at = np.frombuffer(columns, np.float32), [], 0
        for i in range(0, size, BLOCK_DIMS):
            width = min(BLOCK_DIMS, size - i)
            blocks.append(flat[at : at + len(rows) * width].reshape(-1, width))
            at += len(rows) * width
        asked_norms, held_norms, rotated = norms(asked), norms(held), turned(asked)
        step = max(1, PAIRS // len(rows))
        for at in range(0, len(asked), step):
            q, c, _ = survivors(rotated[at : at + step], blocks, bounds[at : at + step], k)
            q = q + at
            other = q_rows[q] != rows[c]
            q, c = q[other], c[other]
            score = np.empty(len(q))
            for i in range(0, len(q), PAIRS // 16):
                a, b = q[i : i + PAIRS // 16], c[i : i + PAIRS // 16]
                score[i : i + len(a)] = (asked[a] * held[b]).sum(axis=1) / (asked_norms[a] * held_norms[b])
            fine = ~(score < bounds[q])
            q, c, score = q[fine], c[fine], score[fine]
            order = np.lexsort((rows[c], ids[c], -score, q))
            q, c, score = q[order], c[order], score[order]
            begin = np.searchsorted(q, q)
            best = np.arange(len(q)) - begin < k
            yield q_rows[q[best]], ids[c[best]], rows[c[best]], score[best]

    def run(batches):
        for batch in batches:
            for size, *buffers in zip(*batch.columns, strict=True):
                for found in cell(size.as_py(), *(b.as_buffer() for b in buffers)):
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), ["query", "vec_id", "row", "score"])

    keys = ["size", "list", "part"]
    both = _sent(index, asked, first, last).join(index.cells, keys)
    return both.select("size", "q_rows", "q_packed", "bounds", "rows", "ids", "packed", "turned").mapInArrow(run, "query long, vec_id long, row long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: Index, asked: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query in ``asked`` (row, id, size, packed of ``index.rows``, or of ``outside``).

    A query never finds its own row. Where the probed lists have fewer than k others, all lists are scanned, so a query
    has fewer than k rows only if there are no more vectors of its size. Ties go to the smaller vec_id.
    """
    asked = materialize(asked.select("row", "id", "size", "packed"), "ann-asked")
    first = materialize(_best(_found(index, asked.withColumn("bound", F.lit(None).cast("double")), 0, 1, k), k), "ann-first")
    bounds = first.groupBy("query").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("bound"))
    told = asked.join(bounds, asked["row"] == bounds["query"], "left").drop("query")
    found = first.drop("rank").unionByName(_found(index, told, 1, None, k))
    found = materialize(_best(found, k), "ann-found")
    short = asked.join(found.where(F.col("rank") == k).select("query"), asked["row"] == F.col("query"), "left_anti").withColumn("bound", F.lit(None).cast("double"))
    if short.limit(1).count():
        found = _best(found.drop("rank").unionByName(_found(index, short, None, MOST_LISTS, k)), k)
    names = asked.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return found.join(names, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def outside(index: Index, queries: DataFrame, id_col: str = "query_id", vector_col: str = "vector") -> DataFrame:
    """Queries that are no rows of the index, for ``search``. Null vectors and those that the index has no like of are left out."""
    kind = "float" if index.kind is np.float32 else "double"
    rows = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector")).where(finite_vectors("vector") & F.exists("vector", lambda x: x != 0))
    rows = rows.where(F.size("vector").isin(*index.fits)).select((-1 - F.monotonically_increasing_id()).alias("row"), "id", "vector")
    np_kind = index.kind

    def pack(batches):
        for batch in batches:
            sizes = np.asarray(batch.column(2).value_lengths())
            flat, ends = np.asarray(batch.column(2).flatten(), np_kind), np.cumsum(sizes)
            packed = [flat[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], ["row", "id", "size", "packed"])

    return rows.mapInArrow(pack, "row long, id long, size int, packed binary")


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``search`` for the rows whose id is divisible by ``every``, among all rows of ``vectors`` (see ``build``)."""
    index = build(vectors, id_col, vector_col, k)
    return search(index, index.rows.where(F.pmod("id", F.lit(every)) == 0), k)
