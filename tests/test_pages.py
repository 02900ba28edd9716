import random
import re

from pyspark.sql import functions as F

from govflow.operators import lists

def order():
    return [F.desc_nulls_last("t"), "id"]


def table(spark, n=200):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *range(12)]), f"x{i}") for i in range(n)]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    return spark.createDataFrame(rows, "id long, t long, x string").repartition(3), want


def test_every_page(spark):
    rows, want = table(spark)
    pages = lists.Pages(rows, order())
    assert pages.total == 200
    for page in (1, 2, 7, 11, 12, 13, 40):
        got = [tuple(r) for r in pages.page(page, 17).collect()]
        assert got == [(*r, 200) for r in want[(page - 1) * 17 : page * 17]], page
    assert [r.id for r in lists.page_of(rows, order(), 3, 5).collect()] == [r[0] for r in want[10:15]]
    assert lists.page_of(rows.limit(0), order()).collect() == []


def test_a_page_reads_the_range_that_holds_it(spark):
    rows, _ = table(spark, 4000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    try:
        pages = lists.Pages(rows, order())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(pages.counts) > 1
    plan = pages.page(2, 10)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*\(part_\w+#\d+", plan) and "TakeOrderedAndProject" in plan
    assert len(pages.page(2, 10).select("id").collect()) == 10


def test_rows_after_a_row(spark):
    rows, want = table(spark)
    by, last, got = [("t", True), ("id", False)], None, []
    while page := lists.rows_after(rows, by, last, 30).collect():
        got += [tuple(r) for r in page]
        last = page[-1].asDict()
    assert got == want
