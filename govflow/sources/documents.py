"""Document, vector and token stores on files, read and written through Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .versions import Folder

PAGE = "struct<page_no:int,text:string,confidence:double,source:string,chars:int,tables:int,seals:int,blocks:array<struct<label:string,bbox:array<double>>>,error:string,note:string>"
DOCUMENT = f"doc_id string, filename string, pages array<{PAGE}>, stages map<string,double>, checks array<map<string,string>>, notes array<string>, _corrupt_record string"


def read_json_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Documents of a folder of JSON files, one document each, or, with ``lines``, one a line; of a store that
    ``write_documents`` keeps, those of its newest version. What can't be parsed is left out."""
    path = Folder(spark, path).data() or path
    rows = spark.read.schema(DOCUMENT).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record is null and doc_id is not null").drop("_corrupt_record")


def document_pages(documents: DataFrame) -> DataFrame:
    """doc_id, filename, page_no, text, source, error: one row per page."""
    return documents.select("doc_id", "filename", F.explode("pages").alias("p")).select("doc_id", "filename", F.col("p.page_no").cast("long").alias("page_no"), "p.text", "p.source", "p.error")


def documents_by_id(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """doc_id and document of each given id in a folder of files ``<doc_id>.json``: null where the file can't be parsed, no
    row where there is none. The names select files before any is opened."""
    names = [f"{i}.json" for i in ids]
    rows = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    mine = rows.where(F.col("_metadata.file_name").isin(names)).select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("name"), "*")
    whole = F.col("_corrupt_record").isNull() & F.col("doc_id").isNotNull()
    return mine.select(F.col("name").alias("doc_id"), F.when(whole, F.struct("filename", "pages", "stages", "checks", "notes")).alias("document"))


def write_documents(documents: DataFrame, path: str) -> int:
    """Replace the store's documents, one a line, and the number of the version: a folder of its own, which readers see
    once it is whole. A write that fails leaves the version before."""
    return Folder(documents.sparkSession, path).replace(documents.write.json)


def read_vectors(spark: SparkSession, path: str, keys: DataFrame | None = None, **revisions) -> DataFrame:
    """Vectors of one model and revision, which select partitions, and of the given chunk keys."""
    rows = spark.read.parquet(path)
    for name, value in revisions.items():
        rows = rows.where(F.col(name) == value)
    return rows if keys is None else rows.join(keys.select("chunk_key").distinct(), "chunk_key", "left_semi")


def write_vectors(vectors: DataFrame, path: str, mode: str = "append") -> None:
    """Append vectors, rounded to six digits, in partitions by embedding, cleaning and chunking revision."""
    rows = vectors.withColumn("vector", F.transform("vector", lambda x: F.round(x.cast("double"), 6).cast("float")))
    rows.write.mode(mode).partitionBy("embed_rev", "clean_rev", "chunk_rev").parquet(path)


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks to embed: the known ones go before the model is asked."""
    return chunks.join(vectors.select("chunk_key"), "chunk_key", "left_anti")


def upserted(table: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """``table`` with ``changes`` applied: for each key the row of the largest version, changes before old rows."""
    new, place = (f"{kind}_{uuid.uuid4().hex}" for kind in ("new", "place"))  # names that no table has
    both = table.withColumn(new, F.lit(0)).unionByName(changes.withColumn(new, F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version), F.desc(new)))
    return both.withColumn(place, rank).where(F.col(place) == 1).drop(place, new)


def without(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``table`` without the rows of the given ids; a null key is never deleted."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def next_revision(table: DataFrame, *keys: str) -> DataFrame:
    """keys, revision: the revision that a new artifact of each key gets."""
    return table.groupBy(*keys).agg((F.coalesce(F.max("revision"), F.lit(0)) + 1).alias("revision"))


def manifest(chunks: DataFrame, most: int = 4000) -> DataFrame:
    """doc_id, content: the chunks of a document as JSON, clipped."""
    held = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "order_in_page", "chunk_key"))).alias("chunks"))
    return held.select("doc_id", F.substring(F.to_json(F.struct("chunks")), 1, most).alias("content"))


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows of an audit log or of events; what stands there is never changed."""
    rows.write.mode("append").parquet(path)


def write_snapshot(rows: DataFrame, path: str) -> int:
    """Replace a snapshot of expected figures, one JSON object a row, all at once (see ``write_documents``)."""
    return Folder(rows.sparkSession, path).replace(rows.write.json)


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(Folder(spark, path).data())


def read_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """object_key (the path), size, modified, content of the files below a path; what isn't selected isn't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return rows.select(F.col("path").alias("object_key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
