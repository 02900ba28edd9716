import json

import pytest
from pyspark.sql import functions as F

from govflow.sources import documents, keyed
from govflow.sources.versions import Conflict, Folder


def docs(spark, n, name):
    return spark.range(n).select(F.col("id").cast("string").alias("doc_id"), F.lit(name).alias("filename"))


def names(spark, path):
    return sorted((r.doc_id, r.filename) for r in documents.read_json_documents(spark, path, lines=True).select("doc_id", "filename").collect())


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    documents.write_documents(docs(spark, 3, "one"), path)
    fails = docs(spark, 300, "two").repartition(4).withColumn("filename", F.when(F.col("doc_id") == "250", F.raise_error(F.lit("broken"))).otherwise(F.col("filename")))
    with pytest.raises(Exception, match="broken"):
        documents.write_documents(fails, path)
    assert names(spark, path) == [("0", "one"), ("1", "one"), ("2", "one")]
    assert documents.write_documents(docs(spark, 2, "three"), path) == 2
    assert names(spark, path) == [("0", "three"), ("1", "three")]
    folder = Folder(spark, path)
    assert len([n for n in folder.names() if n.startswith("data-")]) == 3
    folder.tidy()
    assert len([n for n in folder.names() if n.startswith("data-")]) == 1 and names(spark, path) == [("0", "three"), ("1", "three")]


def test_of_two_writers_the_later_fails(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    folder = Folder(spark, path)

    def slow(where):
        docs(spark, 1, "slow").write.json(where)
        documents.write_documents(docs(spark, 2, "fast"), path)

    with pytest.raises(Conflict):
        folder.replace(slow)
    assert names(spark, path) == [("0", "fast"), ("1", "fast")]
    assert [n for n in folder.names("_versions") if n.startswith("_draft")] == []


def rows_of(store):
    return sorted(map(tuple, store.read().collect()), key=repr)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = spark.range(1000).selectExpr("id AS k", "1L AS v", "'old' AS x")
    store = keyed.KeyedStore.create(table, f"file://{tmp_path}/kv", "k", "v", buckets=32)
    before = dict(store.folder.latest()[1]["buckets"])
    changes = spark.createDataFrame([(1, 2, "new"), (2, 1, "tie"), (3, 0, "late"), (5000, 1, "add"), (1, 1, "older")], "k long, v long, x string")
    done = store.upsert(changes)
    after = store.folder.latest()[1]["buckets"]
    touched = {b for b in after if after[b] != before.get(b)}
    assert {str(b) for b in done.rewritten} == touched and 1 <= len(touched) <= 3
    held = {r.k: (r.v, r.x) for r in store.read().collect()}
    assert len(held) == 1001 and [held[i] for i in (1, 2, 3, 5000)] == [(2, "new"), (1, "tie"), (1, "old"), (1, "add")]
    again = store.upsert(changes)
    assert again.rewritten == [] and again.version == done.version and store.folder.latest()[1]["buckets"] == after
    gone = store.delete(spark.createDataFrame([(1,), (None,), (7777,)], "k long"))
    assert len(gone.rewritten) == 1 and store.read().where("k = 1").count() == 0
    assert store.delete(spark.createDataFrame([(1,), (None,)], "k long")).rewritten == []
    found = store.get(spark.createDataFrame([(2,), (3,), (1,)], "k long"))
    assert sorted(r.k for r in found.collect()) == [2, 3] and len([f for f in found.inputFiles() if f.startswith(store.folder.path)]) <= 3


def test_a_failed_change_is_none_at_all(spark, tmp_path):
    table = spark.range(50).selectExpr("id AS k", "1L AS v", "'old' AS x")
    store = keyed.KeyedStore.create(table, f"file://{tmp_path}/kv", "k", "v", buckets=4)
    before = rows_of(store)
    broken = table.withColumn("x", F.when(F.col("k") == 49, F.raise_error(F.lit("broken"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="broken"):
        store.upsert(broken)
    real = store._write

    def raced(rows, manifest, number, buckets):
        keyed.KeyedStore(spark, store.folder.path).delete(spark.createDataFrame([(3,)], "k long"))
        return real(rows, manifest, number, buckets)

    store._write = raced
    with pytest.raises(Conflict):
        store.upsert(spark.createDataFrame([(4, 2, "new")], "k long, v long, x string"))
    assert rows_of(store) == [r for r in before if r[0] != 3]


def test_null_keys_and_empty_stores(spark, tmp_path):
    table = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (1, None, "c")], "k long, v long, x string")
    store = keyed.KeyedStore.create(table, f"file://{tmp_path}/kv", "k", "v", buckets=3)
    assert rows_of(store) == [(1, None, "c"), (None, 2, "b")]
    store.upsert(spark.createDataFrame([(None, 3, "d"), (1, None, "e")], "k long, v long, x string"))
    assert rows_of(store) == [(1, None, "e"), (None, 3, "d")]
    empty = keyed.KeyedStore.create(table.limit(0), f"file://{tmp_path}/none", "k", None)
    assert rows_of(empty) == [] and empty.upsert(table.where("k = 1")).rewritten and rows_of(empty) == [(1, None, "c")]
    with pytest.raises(Conflict):
        keyed.KeyedStore.create(table, f"file://{tmp_path}/none", "k", None)


def test_one_id_opens_one_file(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"{i}.json").write_text(json.dumps({"doc_id": str(i), "filename": f"f{i}", "pages": []}, indent=1))
    (tmp_path / "7.json").write_text("{broken")
    found = documents.documents_by_id(spark, f"file://{tmp_path}", ["3", "7", "99"])
    assert {r.doc_id: r.document and r.document.filename for r in found.collect()} == {"3": "f3", "7": None}
    plan = found._jdf.queryExecution().executedPlan()
    read = [n for n in plan.toString().split("\n") if "Scan json" in n]
    assert read and "_metadata" in plan.toString()
    assert plan.execute().getNumPartitions() <= 2
