"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; a batch ends at whichever comes first, and holds one row at least.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Longer words are looked up anew each time, so that a worker's table of words is bounded in bytes as in words.
CACHED_CHARS = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep what one Arrow batch holds small, as document texts have no length limit. These settings of the session stay."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset and Spark runs on one machine, one
    under /tmp; a cluster without the setting is an error, as its executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return found.rstrip("/")


def fresh_name(kind: str) -> str:
    """A column name that no input has."""
    return f"{kind}_{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts the lineage.

    Unlike cached blocks the files survive the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that no later result reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Characters of texts that a task splits into words at a time.
SLICE_CHARS = 2_000_000


def slices(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in parts of bounded size; a longer text is a part of its own."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > SLICE_CHARS:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


#: Keys that a semi-join broadcasts at most: 8 bytes each, a few tens of MB with Spark's hash table.
BROADCAST_KEYS = 1_000_000


def checked_broadcast(rows: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """``rows`` (written already, a few numbers each) with a broadcast hint where there are at most ``limit``, counted here."""
    return F.broadcast(rows) if rows.count() <= limit else rows


def checked_semi_join(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` is in ``keys`` (one distinct long column, already written).

    The keys are broadcast where their number, counted here, is small enough; beyond that Spark shuffles both sides.
    """
    return rows.join(checked_broadcast(keys), column, "left_semi")
