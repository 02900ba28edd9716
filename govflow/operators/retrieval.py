"""Hybrid retrieval over chunks: keyword scores, cosine similarity, fusion, citations, and how good it is.

Queries are taken in blocks of about ``BLOCK``, each held against all chunks in one pass, so their number has no bound and
nothing is cross-joined. Ranks within a query keep the best rows of each partition before the shuffle.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govflow.functions import text as T

from .durable import durable

#: Queries of a block, pairs of a batch, runs of characters that are counted at once, and those (of so many at most) whose
#: terms a task remembers.
BLOCK, PAIRS, RUNS, REMEMBERED, BRIEF_RUN = 1000, 500_000, 200_000, 200_000, 50
WHOLE_QUERY, MOST_COUNTED, PER_COUNT = 12.0, 5, 0.25
RECALL, RECALL_LOW, MOST_K = 50, 25, 10


#: Terms stand within one of these.
RUN = re.compile(r"[a-z0-9\-.]+|[一-鿿]+")
WORD = re.compile(r"[a-z0-9]")


def _blocks(queries: DataFrame) -> Iterator[list]:
    """All queries, some ``BLOCK`` at a time."""
    parts = max(1, math.ceil(queries.count() / BLOCK))
    for i in range(parts):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).collect()
        if rows:
            yield rows


def _best(rows: DataFrame, score: str, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_key"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def in_scope(chunks: DataFrame, meta: DataFrame, scope: dict[str, set | None]) -> DataFrame:
    """Chunks whose document's metadata is in every given set; None is no restriction, an empty set admits nothing,
    and missing metadata is in no set."""
    where = F.lit(True)
    for column, values in scope.items():
        if values is not None:
            where = where & (F.coalesce(F.col(column).cast("string"), F.lit("")).isin(*sorted(map(str, values))) if values else F.lit(False))
            where = where & (F.coalesce(F.col(column).cast("string"), F.lit("")) != "")
    return chunks.join(meta.where(where).select("doc_id").distinct(), "doc_id", "left_semi")


def _hits(run: str, vocabulary: dict[str, int], prefixes: set[str]) -> tuple[list[int], list[int]]:
    """The terms in a run and how often each stands there, without overlaps."""
    there = set()
    for i in range(len(run)):
        for k in range(i + 1, len(run) + 1):
            piece = run[i:k]
            if piece not in prefixes:
                break
            if piece in vocabulary:
                there.add(piece)
    return [vocabulary[t] for t in there], [run.count(t) for t in there]


def _term_table(lows: list[str], vocabulary: dict[str, int], prefixes: set[str], known: dict) -> np.ndarray:
    """How often each term (column) stands in each text (row). Each different run of some texts is looked up once."""
    table = np.zeros(len(lows) * len(vocabulary), np.int64)
    ids, texts, place = [], [], defaultdict()
    place.default_factory = place.__len__

    def add_up():
        sizes, terms, counts = [], [], []
        for run in place:
            hits = known.get(run)
            if hits is None:
                hits = _hits(run, vocabulary, prefixes)
                if len(known) < REMEMBERED and len(run) <= BRIEF_RUN:
                    known[run] = hits
            sizes.append(len(hits[0]))
            terms += hits[0]
            counts += hits[1]
        sizes, runs = np.array(sizes, np.int64), np.array(ids, np.int64)
        each = sizes[runs]
        at = np.repeat((np.cumsum(sizes) - sizes)[runs] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        row = np.repeat(np.repeat([k for k, _ in texts], [n for _, n in texts]), each)
        np.add.at(table, row * len(vocabulary) + np.array(terms, np.int64)[at], np.array(counts, np.int64)[at])
        ids.clear(), texts.clear(), place.clear()

    for k, low in enumerate(lows):
        found = RUN.findall(low)
        for i in range(0, len(found), RUNS):
            ids.extend(map(place.__getitem__, found[i : i + RUNS]))
            texts.append((k, len(found[i : i + RUNS])))
            if len(ids) >= RUNS:
                add_up()
    if ids:
        add_up()
    return table.reshape(len(lows), len(vocabulary))


def _lists(row: np.ndarray, value: np.ndarray, rows: int) -> pa.Array:
    """The values of each row, given in the order of rows, as a list."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), pa.array(value, pa.int32()))


def _keyword_block(rows: DataFrame, asked: list, chunks: int, kind: str, best: int | None = None, wanted: dict | None = None) -> DataFrame:
    """Texts are read once: what they have of the queries' terms is written, counted for df, and scored from there."""
    terms = sorted({t for q in asked for t in q.terms})
    vocabulary, prefixes = {t: j for j, t in enumerate(terms)}, {t[:k] for t in terms for k in range(1, len(t) + 1)}
    ids, raws = [q.query_id for q in asked], [q.raw for q in asked]
    words = np.array([sum(bool(WORD.match(t)) for t in q.terms) for q in asked])
    places: list[list[int]] = [[] for _ in terms]
    for i, q in enumerate(asked):
        for t in q.terms:
            places[vocabulary[t]].append(i)
    word_places = [(j, places[j]) for j, t in enumerate(terms) if WORD.match(t)]
    step = max(1, PAIRS // max(len(ids), len(terms)))

    def count(batches):
        known: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                keys, lows = batch.column(0).slice(at, step), batch.column(1).slice(at, step).to_pylist()
                table = _term_table(lows, vocabulary, prefixes, known)
                have = np.zeros((len(lows), len(ids)), np.int32)
                for j, asking in word_places:
                    have[:, asking] += (table[:, j] > 0)[:, None]
                # A text with the whole query has all of its words.
                whole = [(k, i) for k, i in np.argwhere(have == words).tolist() if raws[i] and raws[i] in lows[k]]
                text, term = np.nonzero(table)
                with_query = np.array(whole, np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([keys, _lists(text, term, len(lows)), _lists(text, np.minimum(table[text, term], MOST_COUNTED), len(lows)), _lists(*with_query, len(lows))], ["chunk_key", "terms", "counts", "whole"])

    counted = durable(rows.mapInArrow(count, f"chunk_key {dict(rows.dtypes)['chunk_key']}, terms array<int>, counts array<int>, whole array<int>"), "keyword-counts")
    df = {r.term: r.df for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    idf = [math.log(1 + chunks / (1 + df.get(j, 0))) for j in range(len(terms))]

    def scored(batches):
        """(keys of some texts, places of texts, places of queries, scores) of their pairs with a score."""
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                n, (with_term, with_query) = part.num_rows, (pc.list_parent_indices(part.column(i)).to_numpy() for i in (1, 3))
                values = [part.column(i).flatten().to_numpy() for i in (1, 2, 3)]
                table, sums = np.zeros((n, len(terms)), np.int32), np.zeros((n, len(ids)))
                table[with_term, values[0]] = values[1]
                for j in np.unique(values[0]).tolist():
                    sums[:, places[j]] += np.where(table[:, j] > 0, idf[j] * (1 + table[:, j] * PER_COUNT), 0.0)[:, None]
                sums[with_query, values[2]] += WHOLE_QUERY
                chunk, query = np.nonzero(sums)
                yield part.column(0), chunk, query, sums[chunk, query]

    def rows_of(keys, chunk, query, value):
        return pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(query)), keys.take(pa.array(chunk)), pa.array(value)], ["query_id", "chunk_key", "kw_score"])

    def score(batches):
        for found in scored(batches):
            yield rows_of(*found)

    def score_best(batches):
        held, least, kind_of_key = pd.DataFrame({"query": [], "key": [], "value": []}), np.zeros(len(ids)), None
        for keys, chunk, query, value in scored(batches):
            sums, asked_for, names, kind_of_key = np.zeros((len(keys), len(ids))), np.zeros((len(keys), len(ids)), bool), keys.to_pylist(), keys.type
            sums[chunk, query] = np.round(value, 9)
            for k, name in enumerate(names):
                asked_for[k, list(wanted.get(name, ()))] = True
            at = np.nonzero(asked_for & (sums > 0))
            yield rows_of(keys, *at, sums[at])
            # Only scores that reach the last of the best, in these texts and in those before, can be among them.
            floor = np.maximum(least, np.partition(sums, -best, axis=0)[-best]) if len(keys) >= best else least
            chunk, query = np.nonzero((sums >= floor) & (sums > 0))
            new = pd.DataFrame({"query": query, "key": [names[k] for k in chunk], "value": sums[chunk, query]})
            held = pd.concat([held, new]) if len(held) else new
            held = held.sort_values(["query", "value", "key"], ascending=[True, False, True]).groupby("query").head(best)
            full = held.groupby("query")["value"].agg(["size", "min"])
            full = full[full["size"] == best]
            least[full.index.to_numpy(int)] = full["min"].to_numpy()
        if len(held):
            keys = pa.array(held["key"].tolist(), kind_of_key)
            yield rows_of(keys, np.arange(len(held)), held["query"].to_numpy(int), held["value"].to_numpy(float))

    return counted.dropDuplicates(["chunk_key"]).mapInArrow(score if best is None else score_best, f"query_id {kind}, chunk_key {dict(rows.dtypes)['chunk_key']}, kw_score double")


def keyword_scores(chunks: DataFrame, queries: DataFrame, best: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_key, kw_score of chunks with a score: 12 for the whole query, and for each term
    ln(1 + n / (1 + df)) * (1 + 0.25 * min(occurrences, 5)). n and df count every chunk given.

    queries: query_id, text; any number of them. Chunks of one key count each for n and df, and have one row.
    With ``best`` only the rows that may be among the ``best`` of their query are returned, as each task keeps its own
    best ones, and those of the pairs ``wanted`` (query_id, chunk_key: some for each query).
    """
    asked = queries.select("query_id", T.normal_query(F.col("text")).alias("raw"), T.query_terms(F.col("text")).alias("terms")).where("raw <> '' or size(terms) > 0")
    rows = chunks.select("chunk_key", F.lower(T.fold(F.col("text"))).alias("low"))
    n, kind, blocks = rows.count(), dict(queries.dtypes)["query_id"], []
    for block in _blocks(asked):
        places = {q.query_id: j for j, q in enumerate(block)}
        pairs: dict = defaultdict(set)
        for r in wanted.where(F.col("query_id").isin(*places)).collect() if wanted is not None else []:
            pairs[r.chunk_key].add(places[r.query_id])
        blocks.append(_keyword_block(rows, block, n, kind, best, dict(pairs)))
    if not blocks:
        return rows.select(F.lit(None).cast(kind).alias("query_id"), "chunk_key", F.lit(0.0).alias("kw_score")).where(F.lit(False))
    found = reduce(DataFrame.union, blocks) if best is None else reduce(DataFrame.union, blocks).dropDuplicates(["query_id", "chunk_key"])
    # Rounded, as sums in another order would break ties in their last bits.
    return found.withColumn("kw_score", F.round("kw_score", 9)).where("kw_score > 0")


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for null or empty vectors, different lengths and zero norms."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def _cosines(vectors: list, queries: list) -> np.ndarray:
    """``cosine`` of each vector and query."""
    out = np.zeros((len(vectors), len(queries)))
    vectors, queries = ([np.array([] if v is None else v, float) for v in x] for x in (vectors, queries))
    for size in {len(q) for q in queries} - {0}:
        mine, asked = ([i for i, v in enumerate(x) if len(v) == size] for x in (vectors, queries))
        if mine:
            a, b = np.stack([vectors[i] for i in mine]), np.stack([queries[i] for i in asked])
            norms = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))
            out[np.ix_(mine, asked)] = np.divide(a @ b.T, norms, out=np.zeros_like(norms), where=norms > 0)
    # Rounded, as equal vectors may differ in their last bits by their place in a batch.
    return np.round(out, 12)


def _keep_best(best: list[list], floor: np.ndarray, i: int, column: np.ndarray, names: list, k: int) -> None:
    """Add a query's scores to its k best (negative score, key); ``floor`` is the score of the k-th once there are k."""
    known = column[~np.isnan(column)]
    least = max(np.partition(known, -k)[-k] if len(known) > k else -np.inf, floor[i])
    held = best[i]
    held += [(-column[j], names[j]) for j in np.flatnonzero(column >= least)]
    held.sort()
    del held[k:]
    if len(held) == k:
        floor[i] = -held[-1][0]


def _vector_block(vectors: DataFrame, asked: list, kind: str, k: int | None) -> DataFrame:
    ids, given = [q.query_id for q in asked], [q.vector for q in asked]
    step = max(1, PAIRS // len(ids))

    def run(batches):
        best, floor = [[] for _ in ids], np.full(len(ids), -np.inf)
        asked_vectors = [None if v is None else np.array(v, float) for v in given]
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                keys, values = (batch.column(i).slice(at, step) for i in (0, 1))
                scores = _cosines(values.to_pylist(), asked_vectors)
                if k is None:
                    chunk, query = (x.ravel() for x in np.indices(scores.shape))
                    yield pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(query)), keys.take(pa.array(chunk)), pa.array(scores.ravel())], ["query_id", "chunk_key", "vec_score"])
                    continue
                names = keys.to_pylist()
                # Most texts behind the first ones reach the k-th score of few queries.
                for i in np.flatnonzero(np.fmax.reduce(scores, axis=0) >= floor).tolist():
                    _keep_best(best, floor, i, scores[:, i], names, k)
        if k is not None:
            rows = [(ids[i], name, -score) for i, held in enumerate(best) for score, name in held]
            yield pa.RecordBatch.from_pylist([dict(zip(("query_id", "chunk_key", "vec_score"), r, strict=True)) for r in rows], schema=pa.schema([("query_id", pa.array(ids).type), ("chunk_key", batch_type), ("vec_score", pa.float64())]))

    batch_type = pa.string() if dict(vectors.dtypes)["chunk_key"] == "string" else pa.int64()
    return vectors.select("chunk_key", "vector").mapInArrow(run, f"query_id {kind}, chunk_key {dict(vectors.dtypes)['chunk_key']}, vec_score double")


def vector_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_key, vec_score: every vector (chunk_key, vector) against every query (query_id, vector)."""
    kind = dict(queries.dtypes)["query_id"]
    blocks = [_vector_block(vectors, block, kind, None) for block in _blocks(queries.select("query_id", "vector"))]
    if not blocks:
        return vectors.select(F.lit(None).cast(kind).alias("query_id"), "chunk_key", F.lit(0.0).alias("vec_score")).where(F.lit(False))
    return reduce(DataFrame.union, blocks)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``top_k`` of ``vector_scores``; each task keeps the k best of a query, and a block is done before the next."""
    kind, out = dict(queries.dtypes)["query_id"], []
    for block in _blocks(queries.select("query_id", "vector")):
        best = top_k(_vector_block(vectors, block, kind, k), "vec_score", k)
        out.append(durable(best, "vector-top"))
    return reduce(DataFrame.union, out) if out else top_k(vector_scores(vectors, queries), "vec_score", k)


def top_k(scores: DataFrame, score: str, k: int) -> DataFrame:
    """The k best rows of each query with their rank, ties by key."""
    return _best(scores, score, k)


def hybrid(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, k: int = 5, low: bool = False) -> DataFrame:
    """``fused`` of texts (chunk_key, text) and vectors (chunk_key, vector), for queries (query_id, text) and
    (query_id, vector). Of keyword scores only those of the nearest and each task's best are written; the cosine is taken
    of the nearest and of candidates only."""
    recall = _recall(k, low)
    first = vector_top_k(vectors, query_vectors, recall).select("query_id", "chunk_key", F.col("rank").alias("position"))
    kw = durable(keyword_scores(chunks, queries, max(1, recall // 2), first), "keyword-scores")
    second = _best(kw, "kw_score", max(1, recall // 2)).select("query_id", "chunk_key", (F.col("rank") + recall).alias("position"))
    both = durable(first.union(second).groupBy("query_id", "chunk_key").agg(F.min("position").cast("long").alias("position")), "candidates")
    asked = query_vectors.select("query_id", F.col("vector").alias("asked"))
    rows = both.join(kw, ["query_id", "chunk_key"], "left").join(vectors.select("chunk_key", "vector"), "chunk_key", "left").join(asked, "query_id", "left")
    return rows.select("query_id", "chunk_key", "position", F.round(cosine(F.col("vector"), F.col("asked")), 12).alias("vec_score"), F.coalesce("kw_score", F.lit(0.0)).alias("kw_score"))


def _recall(k: int, low: bool) -> int:
    return max(min(max(k, 1), MOST_K), RECALL_LOW if low else RECALL)


def fused(vec: DataFrame, kw: DataFrame, k: int = 5, low: bool = False) -> DataFrame:
    """query_id, chunk_key, position, vec_score, kw_score: candidates of both kinds, vectors first, each once."""
    recall = _recall(k, low)
    first = _best(vec, "vec_score", recall).select("query_id", "chunk_key", "vec_score", F.lit(None).cast("double").alias("kw_score"), F.col("rank").alias("position"))
    second = _best(kw, "kw_score", max(1, recall // 2)).select("query_id", "chunk_key", F.lit(None).cast("double").alias("vec_score"), "kw_score", (F.col("rank") + recall).alias("position"))
    both = first.union(second).groupBy("query_id", "chunk_key").agg(F.min("position").alias("position"), F.max("vec_score").alias("vec_score"))
    # The other score of a candidate may lie outside of its own top rows.
    rows = both.join(kw, ["query_id", "chunk_key"], "left").drop("vec_score").join(vec, ["query_id", "chunk_key"], "left")
    return rows.select("query_id", "chunk_key", F.col("position").cast("long").alias("position"), F.coalesce("vec_score", F.lit(0.0)).alias("vec_score"), F.coalesce("kw_score", F.lit(0.0)).alias("kw_score"))


def ranked(candidates: DataFrame, k: int = 5) -> DataFrame:
    """The k best candidates by 2 * vector + keyword score (no reranking model), ties by position; the score that is
    shown is the vector's. Rounded as hits are: four and two digits."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(F.col("vec_score") * 2 + F.col("kw_score"), 9)), "position")
    rows = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(max(k, 1), MOST_K))
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_key", T.rounded(F.col("vec_score"), 4).alias("score"), T.rounded(F.col("kw_score"), 2).alias("kw_score"), F.lit(False).alias("reranked"))


def citations(hits: DataFrame) -> DataFrame:
    """conv_id, number, doc_id, page_no, snippet of hits (conv_id, position, doc_id, page_no, score, snippet): numbers in
    the order of first hits; the snippet is that of the best score, the earlier one on ties."""
    best = F.max_by(F.col("snippet"), F.struct(F.col("score"), -F.col("position")))
    pages = hits.groupBy("conv_id", "doc_id", "page_no").agg(F.min("position").alias("first"), best.alias("snippet"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("first")).cast("long")
    return pages.select("conv_id", number.alias("number"), "doc_id", "page_no", T.snippet(F.col("snippet")).alias("snippet"))


def judged(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """case_id, recall, rr, status of cases (case_id, doc_id, pages, keys) and hits (case_id, rank, doc_id, page_no,
    chunk_key). Expected keys go before pages; with a doc_id only its pages count; without labels a case is skipped."""
    by_key = F.size(F.coalesce("keys", F.array().cast("array<string>"))) > 0
    wanted = F.when(by_key, F.size("keys")).otherwise(F.coalesce(F.size("pages"), F.lit(0)))
    mine = cases.select("case_id", F.col("doc_id").alias("_doc"), "pages", "keys", by_key.alias("by_key"), F.greatest(wanted, F.lit(0)).alias("wanted"))
    in_doc = F.col("_doc").isNull() | (F.col("_doc") == F.col("doc_id"))
    hit = F.when(F.col("by_key"), F.array_contains("keys", F.col("chunk_key"))).otherwise(in_doc & F.array_contains("pages", F.col("page_no")))
    what = F.when(F.col("by_key"), F.col("chunk_key")).otherwise(F.col("page_no").cast("string"))
    found = mine.join(hits, "case_id", "left").groupBy("case_id", "wanted").agg(F.countDistinct(F.when(hit, what)).alias("n"), F.min(F.when(hit, F.col("rank"))).alias("first"))
    labelled = F.col("wanted") > 0
    return found.select(
        "case_id",
        F.when(labelled, T.rounded(F.col("n") / F.col("wanted"), 4)).alias("recall"),
        F.when(labelled, T.rounded(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4)).alias("rr"),
        F.when(~labelled, "SKIPPED_UNLABELED").when(F.col("n") > 0, "PASS").otherwise("FAIL").alias("status"),
    )


def overall(cases: DataFrame) -> DataFrame:
    """One row: labelled cases, mean recall, MRR and hit rate over them; null where there are none.

    Recalls and reciprocal ranks have four digits and are added up as decimals, so a mean on a tie rounds up.
    """
    mean = lambda c: T.rounded(F.avg(F.col(c).cast("decimal(12,4)")).cast("decimal(20,8)"), 4)
    labelled = cases.where("status <> 'SKIPPED_UNLABELED'")
    return labelled.agg(
        F.count(F.lit(1)).alias("cases"),
        mean("recall").alias("recall"),
        mean("rr").alias("mrr"),
        T.rounded(F.try_divide(F.count_if(F.col("status") == "PASS"), F.count(F.lit(1))), 4).alias("hit_rate"),
    )


def agreement(one: DataFrame, two: DataFrame, k: int) -> DataFrame:
    """query_id, overlap (shared of k), top1: how far two rankings (query_id, rank, chunk_key) agree."""
    a, b = (x.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("chunk_key").alias(n), F.min_by("chunk_key", "rank").alias(f"{n}1")) for x, n in ((one, "a"), (two, "b")))
    rows = a.join(b, "query_id", "full")
    empty = F.array().cast("array<string>")
    return rows.select("query_id", (F.size(F.array_intersect(F.coalesce("a", empty), F.coalesce("b", empty))) / k).alias("overlap"), F.coalesce(F.col("a1") == F.col("b1"), F.lit(False)).alias("top1"))
