"""BM25 over an inverted index that is kept as tables, with a scope of documents.

Chunks are numbered; ``SPAN`` consecutive ones form a block. The postings table has a row for each term and block with the
numbers, frequencies and lengths of its chunks, and the highest frequency and least length among them, dealt to folders
by a hash of the term. A search reads the folders of its terms only, and of these first the bounds: the blocks that
promise most give a score that k chunks reach, and chunks are then scored in the blocks that can reach it.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .durable import durable, new_path

#: Saturation and length normalisation (fixed values).
K1, B = 1.2, 0.75
#: Chunks of a block, blocks that are inverted at once, folders of the postings, blocks that are scored first.
SPAN, BLOCKS, FOLDERS, FIRST = 128, 8, 64, 4
#: Rows of an index or of a scope that are broadcast at most.
SMALL = 1_000_000
TERM = re.compile("[一-鿿]|[^\x00-\x2f\x3a-\x60\x7b-\x7f一-鿿]+")


@dataclass
class Index:
    """``postings`` (path of a table by folder), ``chunks`` (no, chunk_key, doc_id, length), ``terms`` (term, df), and their totals."""

    postings: str
    chunks: DataFrame
    terms: DataFrame
    n: int
    length: int

    @property
    def average(self) -> float:
        return self.length / self.n if self.n else 0.0


def folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


POSTINGS = "term string, block long, nos array<long>, tfs array<int>, lengths array<int>, most int, least int"


def _postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{POSTINGS}, folder int").parquet(path)


def build(chunks: DataFrame, key: str = "chunk_key", doc: str = "doc_id", text: str = "text") -> Index:
    """The index of ``chunks``. Null texts count as empty; chunks that repeat a key are chunks of their own."""
    spark = chunks.sparkSession
    kept = chunks.select(F.col(key).cast("string").alias("chunk_key"), F.col(doc).alias("doc_id"), F.lower(F.coalesce(text, F.lit(""))).alias("low"))
    # A few small files would keep most cores idle; a large input has partitions enough and isn't dealt anew.
    if kept.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        kept = kept.repartition(spark.sparkContext.defaultParallelism)
    numbered = kept.select(F.monotonically_increasing_id().alias("no"), "*")

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SPAN):
                *given, lows = batch.slice(at, SPAN).columns
                bags = [Counter(TERM.findall(low)) for low in lows.to_pylist()]
                offsets = pa.array(np.cumsum([0, *map(len, bags)]), pa.int32())
                terms, tfs = pa.array([t for bag in bags for t in bag], pa.string()), pa.array([n for bag in bags for n in bag.values()], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (terms, tfs)]
                yield pa.RecordBatch.from_arrays([*given, pa.array([bag.total() for bag in bags], pa.int64()), *lists], ["no", "chunk_key", "doc_id", "length", "terms", "tfs"])

    # A text is searched for its terms once.
    counted = durable(numbered.mapInArrow(count, f"no bigint, chunk_key string, doc_id {dict(kept.dtypes)['doc_id']}, length bigint, terms array<string>, tfs array<int>"), "bm25-counts")

    def run(batches):
        for batch in batches:
            blocks = batch.column(0).to_numpy() // SPAN
            cuts = [*np.flatnonzero(np.diff(blocks, prepend=-1))[::BLOCKS].tolist(), batch.num_rows]
            for at, end in zip(cuts, cuts[1:], strict=False):
                no, length, terms, tfs = batch.slice(at, end - at).columns
                row, words = pc.list_parent_indices(terms).to_numpy(), terms.flatten().dictionary_encode()
                code, block = words.indices.to_numpy(), blocks[at:end][row]
                order = np.lexsort((code, block))  # stable, so numbers ascend
                row, code, block, tf = row[order], code[order], block[order], tfs.flatten().to_numpy()[order]
                starts = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
                if not len(starts):
                    continue
                size = length.to_numpy()[row].astype(np.int32)
                offsets = pa.array([*starts.tolist(), len(row)], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (no.to_numpy()[row], tf, size)]
                out = [words.dictionary.take(pa.array(code[starts])), pa.array(block[starts]), *lists, pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(size, starts))]
                yield pa.RecordBatch.from_arrays(out, ["term", "block", "nos", "tfs", "lengths", "most", "least"])

    # Files are read whole rows at a time and in order, so a block is in one task or its parts are rows of their own.
    made = counted.select("no", "length", "terms", "tfs").mapInArrow(run, POSTINGS).withColumn("folder", folder(F.col("term")))
    path = new_path(spark, "bm25-postings")
    # A frequent term has a row a block, so rows are dealt by folder and block range and sorted by term.
    made.repartition("folder", F.col("block") % 16).sortWithinPartitions("folder", "term", "block").write.partitionBy("folder").parquet(path)
    postings = _postings(spark, path)
    terms = durable(postings.groupBy("term").agg(F.sum(F.size("nos")).alias("df")), "bm25-terms")
    known = counted.select("no", "chunk_key", "doc_id", "length")
    n, total = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    return Index(path, known, terms, n, total)


def terms_of(low: Column) -> Column:
    """All terms of a text in small letters, in order."""
    return F.regexp_extract_all(low, F.lit("([一-鿿]|[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F一-鿿]+)"), 1)


def query_terms(queries: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
    """query_id, term, times: the terms of each query and how often each stands in it."""
    found = terms_of(F.lower(F.coalesce(text, F.lit(""))))
    return queries.select(F.col(query).alias("query_id"), F.explode(found).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def asked_postings(spark: SparkSession, index: Index, asked: DataFrame) -> DataFrame:
    """The postings of the asked terms (query_id, term, weight), read from their folders only."""
    folders = sorted(r[0] for r in asked.select(folder(F.col("term"))).distinct().collect())
    rows = _postings(spark, index.postings).where(F.col("folder").isin(folders))
    return rows.join(asked, "term")


def _saturated(tf: Column, length: Column, average: float) -> Column:
    return tf / (tf + K1 * (1 - B + B * length / F.lit(average or 1.0)))


def _scored(rows: DataFrame, average: float, live: DataFrame | None) -> DataFrame:
    """query_id, no, score of the chunks in postings of asked terms (weight)."""
    each = rows.select("query_id", "weight", F.explode(F.arrays_zip("nos", "tfs", "lengths")).alias("p")).select("query_id", F.col("p.nos").alias("no"), (F.col("weight") * _saturated(F.col("p.tfs"), F.col("p.lengths"), average)).alias("part"))
    if live is not None:
        each = each.join(live, "no", "left_semi")
    # Rounded, as sums in another order would break ties in their last bits.
    return each.groupBy("query_id", "no").agg(F.round(F.sum("part"), 9).alias("score"))


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def search(index: Index, queries: DataFrame, k: int = 10, scope: Column | None = None) -> DataFrame:
    """query_id, rank, chunk_key, score: the k best chunks of each query (query_id, text), ties by key and number.

    ``scope`` is a condition on the index's chunks (chunk_key, doc_id). As in a search engine, numbers and lengths of
    all chunks count for the scores, whatever the scope. Queries without a known term have no row.
    """
    spark = queries.sparkSession
    idf = F.log(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = durable(query_terms(queries).join(index.terms, "term").select("query_id", "term", (F.col("times") * idf).alias("weight")), "bm25-asked")
    live = None if scope is None else _small(durable(index.chunks.where(scope).select("no"), "bm25-live"))
    hits = asked_postings(spark, index, asked)
    # Only the bounds are read here; no chunk of a block can score more.
    bound = F.sum(F.col("weight") * _saturated(F.col("most"), F.col("least"), index.average))
    bounds = hits.groupBy("query_id", "block").agg(bound.alias("bound"))
    if live is not None:
        bounds = bounds.join(index.chunks.where(scope).select(F.expr(f"no div {SPAN}").alias("block")).distinct(), "block", "left_semi")
    bounds = durable(bounds, "bm25-bounds")
    promising = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    first = bounds.withColumn("place", promising).where(F.col("place") <= FIRST).select("query_id", "block")
    reached = _best(_named(index, _scored(hits.join(first, ["query_id", "block"]), index.average, live)), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    open_blocks = durable(bounds.join(reached, "query_id", "left").where("reached is null or bound >= reached - 1e-6").select("query_id", "block"), "bm25-open")
    scores = _scored(hits.join(open_blocks, ["query_id", "block"], "left_semi"), index.average, live)
    return _best(_named(index, scores), k).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_key", "score")


def _named(index: Index, scores: DataFrame) -> DataFrame:
    return scores.join(index.chunks.select("no", "chunk_key"), "no")


def _best(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_key", "no"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)
