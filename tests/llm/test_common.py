import pytest

from govflow.llm import common, exact_dedup


def test_batches_are_bounded_by_bytes(spark):
    common.bounded_batches(spark)
    rows = spark.range(0, 60, 1, 1).selectExpr("id", "repeat('x', 1000000) as text")

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    found = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(found) == 60 and max(found) <= common.BATCH_BYTES // 1_000_000 + 1


def test_shared_folder_of_a_cluster_has_to_be_set(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = spark.conf, Context()

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            common.shared_dir(Session())
    assert common.shared_dir(spark)


def test_clashing_column_names(spark):
    docs = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 6, "y"), (3, None, 7, "z")], "doc_id long, text string, _keep int, _digest string")
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r._keep for r in kept.collect()) == [6, 7]
