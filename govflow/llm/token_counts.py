"""Token counts of documents in flat token files that have no index.

A flat file is a run of big-endian unsigned 16-bit ids in which each document ends with an end-of-document id. A
stream is one or more such files (shards) in order, and a document may run from one shard into the next. Each shard is
searched for end ids in blocks by numpy; what blocks and shards found is stitched by prefix scans: within a shard over
its blocks, and over the shards' totals. Both are Spark windows over summaries; tokens are never shuffled.
"""

from __future__ import annotations

import uuid

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from . import packing
from .common import bounded_batches, shared_dir

#: The end id is above the vocabulary, and its two bytes are UTF-8 for this character, so that Spark's text writer can
#: end every record with it.
END_CHAR = "Đ"
END_ID = int.from_bytes(END_CHAR.encode(), "big")
#: Tokens of a block. Bytes of a run of documents that is written at a time, and runs of a file: a file has up to 32 MB
#: and a document's tokens.
BLOCK, RUN_BYTES, FILE_RUNS = 1 << 18, 4 << 20, 8
#: A document of ours begins with its id in as many tokens of 15 bits; a null id has the highest bit pattern.
ID_TOKENS, ID_BITS = 5, 15
NULL_ID = (1 << (ID_TOKENS * ID_BITS)) - 1


def _id_tokens(doc_id: int | None) -> bytes:
    number = NULL_ID if doc_id is None else doc_id + (1 << 63)
    return b"".join(((number >> (ID_BITS * i)) & 0x7FFF).to_bytes(2, "big") for i in reversed(range(ID_TOKENS)))


def write_flat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> str:
    """Tokenise whole texts and write them as flat files, each a stream of its own; returns their folder.

    A document is its id, its tokens and the end id. A null text counts as empty. Files are cut by bytes between
    documents, so that a file takes little memory to read, however long its documents are.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    vocabulary = public_tokenizers.path(packing.TOKENIZER)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encode(batches):
        held, size = [], 0

        def packed():
            # The end id of the last document comes from the writer.
            return pa.RecordBatch.from_arrays([pa.array([END_CHAR.encode().join(held)], pa.binary())], ["value"])

        for batch in batches:
            ids = packing.load(vocabulary).encode_batch(batch.column(1).to_pylist())
            for i, x in zip(batch.column(0).to_pylist(), ids, strict=True):
                held.append(_id_tokens(i) + np.frombuffer(x, "<u4").astype(">u2").tobytes())
                size += len(held[-1])
                if size >= RUN_BYTES:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    path = path or f"{shared_dir(spark)}/flat-tokens-{uuid.uuid4().hex}"
    flat = rows.mapInArrow(encode, "value binary").select(F.col("value").cast("string"))
    flat.write.option("lineSep", END_CHAR).option("maxRecordsPerFile", FILE_RUNS).text(path)
    return path


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """stream, shard, content of the flat files in a folder, each file a stream of its own."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select(name.alias("stream"), F.lit("0").alias("shard"), "content")


def scan_blocks(files: DataFrame, end_id: int = END_ID, head: int = ID_TOKENS, block: int = BLOCK) -> DataFrame:
    """One row per block: stream, shard, block, tokens, ends (positions of end ids), heads, first.

    ``heads`` are the first tokens of the documents that begin behind each end, ``first`` those at the block's own
    begin. They are shorter where the shard ends.
    """
    fields = "stream string, shard string, block long, tokens long, ends array<int>, heads array<array<int>>, first array<int>"

    def run(batches):
        for batch in batches:
            for stream, shard, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.frombuffer(content, ">u2").astype(np.int32)
                rows = []
                for at in range(0, len(ids), block):
                    part = ids[at : at + block]
                    ends = np.flatnonzero(part == end_id)
                    heads = [ids[at + e + 1 : at + e + 1 + head].tolist() for e in ends.tolist()]
                    rows.append((stream, shard, at // block, len(part), ends.tolist(), heads, ids[at : at + head].tolist()))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 7
                types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["stream", "shard", "block", "tokens", "ends", "heads", "first"])

    bounded_batches(files.sparkSession)
    return files.select("stream", "shard", "content").mapInArrow(run, fields)


def _scan(rows: DataFrame, over: WindowSpec) -> DataFrame:
    """What lies before each row of ``over``: tokens, ends, where the last end is, and the head of what begins there."""
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    return rows.withColumns(
        {
            "ends_before": F.coalesce(F.sum("n_ends").over(before), F.lit(0)),
            "end_before": F.max(F.col("before") + F.col("last_end")).over(before),
            "head_before": F.last("last_head", ignorenulls=True).over(before),
        }
    )


def documents(blocks: DataFrame) -> DataFrame:
    """stream, ordinal (from 0), start (tokens of the stream before it), n_tokens (without the end id), head, ended.

    A document that the end of its stream cuts off comes with ``ended`` false. An end id right behind another, or at the
    begin, ends a document of no tokens. Shards are in the order of their names.
    """
    blocks = blocks.withColumns({"n_ends": F.size("ends").cast("long"), "last_end": F.try_element_at("ends", F.lit(-1)).cast("long"), "last_head": F.try_element_at("heads", F.lit(-1))})
    blocks = _scan(blocks, Window.partitionBy("stream", "shard").orderBy("block"))
    shards = blocks.groupBy("stream", "shard").agg(
        F.sum("tokens").alias("tokens"),
        F.sum("n_ends").alias("n_ends"),
        F.max(F.col("before") + F.col("last_end")).alias("last_end"),
        F.max_by("last_head", F.when(F.col("n_ends") > 0, F.col("block"))).alias("last_head"),
        F.min_by("first", "block").alias("first"),
        F.max("block").alias("final_block"),
    )
    shards = _scan(shards, Window.partitionBy("stream").orderBy("shard"))
    in_order = Window.partitionBy("stream").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shards = shards.withColumns({"head_before": F.coalesce("head_before", F.first("first").over(in_order)), "final_shard": F.last("shard").over(in_order)})
    shards = shards.select("stream", "shard", "final_shard", "final_block", *[F.col(c).alias(f"shard_{c}") for c in ("before", "ends_before", "end_before", "head_before")])
    placed = blocks.join(shards, ["stream", "shard"]).select(
        "stream",
        "ends",
        "heads",
        (F.col("shard_before") + F.col("before")).alias("base"),
        (F.col("shard_ends_before") + F.col("ends_before")).alias("ordinal"),
        (F.coalesce(F.col("shard_before") + F.col("end_before"), F.col("shard_end_before"), F.lit(-1).cast("long")) + 1).alias("opened"),
        F.coalesce("head_before", "shard_head_before").alias("opened_head"),
        (F.col("shard_before") + F.col("before") + F.col("tokens")).alias("stop"),
        ((F.col("shard") == F.col("final_shard")) & (F.col("block") == F.col("final_block"))).alias("final"),
    )
    # The documents that end in a block, and in the last block of a stream the one that its end cuts off.
    starts = F.concat(F.array("opened"), F.transform("ends", lambda e: F.col("base") + e + 1))
    heads = F.concat(F.array("opened_head"), F.col("heads"))
    stops = F.concat(F.transform("ends", lambda e: F.col("base") + e), F.when(F.col("final"), F.array("stop")).otherwise(F.array().cast("array<bigint>")))
    spans = F.transform(stops, lambda stop, i: F.struct((F.col("ordinal") + i).alias("ordinal"), F.get(starts, i).alias("start"), (stop - F.get(starts, i)).alias("n_tokens"), F.get(heads, i).alias("head"), (i < F.size("ends")).alias("ended")))
    found = placed.select("stream", F.explode(spans).alias("d")).select("stream", "d.*")
    return found.where("ended or n_tokens > 0")


def _id_of(head: Column) -> Column:
    """The document id in a head; null for the null id."""
    token = lambda i: F.get(head, i).cast("long")
    number = F.shiftleft(token(0), ID_BITS * (ID_TOKENS - 1))
    for i in range(1, ID_TOKENS):
        number = number.bitwiseOR(F.shiftleft(token(i), ID_BITS * (ID_TOKENS - 1 - i)))
    return F.when(token(0) != NULL_ID >> (ID_BITS * (ID_TOKENS - 1)), number.bitwiseXOR(F.lit(-(2**63))))


def document_counts(files: DataFrame) -> DataFrame:
    """doc_id, n_tokens, stream, ordinal, start of every document in files that ``write_flat`` has written."""
    found = documents(scan_blocks(files))
    return found.select(_id_of(F.col("head")).alias("doc_id"), (F.col("n_tokens") - ID_TOKENS).alias("n_tokens"), "stream", "ordinal", "start")
