import numpy as np
from pyspark.sql import functions as F

from govflow.operators import cells, retrieval


def some(n, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 32))
    return [(i, (centres[i % 20] * 0.7 + rng.normal(size=32)).tolist(), i % 3) for i in range(n)]


def test_recall_and_filter(spark):
    table = spark.createDataFrame(some(3000), "chunk_key long, vector array<double>, project int").repartition(4)
    asked = table.where("chunk_key % 20 = 0").select(F.col("chunk_key").alias("query_id"), "vector")
    index = cells.build(table)
    for where, rows in ((None, table), (F.col("project") == 1, table.where("project = 1"))):
        exact = retrieval.vector_top_k(rows, asked, 10)
        found = cells.search(index, asked, 10, where)
        assert found.count() == 1500 and cells.recall(found, exact) >= 0.9
        done, full = cells.scanned(index, asked, where)
        assert full == 150 * rows.count() and done < 0.75 * full
        same = found.join(exact.select("query_id", "chunk_key", F.col("vec_score").alias("s")), ["query_id", "chunk_key"])
        assert same.where("vec_score <> s").count() == 0
        whole = cells.search(index, asked, 10, where, probed=len(index.centres))
        assert sorted(map(tuple, whole.select("query_id", "rank", "chunk_key").collect())) == sorted(map(tuple, exact.select("query_id", "rank", "chunk_key").collect()))


def test_filter_and_cells_are_in_the_scan(spark):
    index = cells.build(spark.createDataFrame(some(600), "chunk_key long, vector array<double>, project int"))
    rows = spark.read.schema(index.fields).parquet(index.path).where(F.col("cell").isin(1, 2) & (F.col("project") == 1))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "EqualTo(project,1)" in plan


def test_nulls_other_sizes_and_nothing(spark):
    rows = [(i, [float(i), 1.0], 0) for i in range(30)] + [(100, None, 0), (101, [], 0), (102, [0.0, 0.0], 0)]
    index = cells.build(spark.createDataFrame(rows, "chunk_key long, vector array<double>, project int"))
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (2, None), (3, [1.0])], "query_id long, vector array<double>")
    found = cells.search(index, asked, 3, probed=99).collect()
    assert [(r.query_id, r["rank"], r.chunk_key) for r in sorted(found)] == [(1, 1, 1), (1, 2, 2), (1, 3, 3)]
    none = cells.build(spark.createDataFrame([], "chunk_key long, vector array<double>, project int"))
    assert cells.search(none, asked, 3).collect() == []
