from pyspark.sql import functions as F

from govflow.operators import hits


def test_shaped_hits(spark):
    chunks = [("a", 1, 1, 0, "one", "1:1"), ("b", 1, 1, 1, "two " * 100, "1:1"), ("c", 1, 2, 0, "alone", "1:2"), ("d", 2, 1, 0, " same ", "2:1"), ("e", 2, 1, 1, None, "2:1"), ("f", 3, 1, 0, "x", "3:1"), ("g", 3, 1, 1, "y", "3:1")]
    table = spark.createDataFrame(chunks, "chunk_key string, doc_id int, page_no int, order_in_page int, text string, parent_key string")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "f"), (6, "gone")], "rank int, chunk_key string")
    got = {r.rank: (r.doc_id, r.page_no, r.snippet, r.parent_summary) for r in hits.shaped(asked, table, snippet=10, summary=12).collect()}
    assert got[1] == (1, 1, "one", "one\ntwo two …") and got[2][2] == "two two tw…" and got[3] == (1, 2, "alone", None) and got[5] == (3, 1, "x", "x\ny") and 6 not in got
    assert {r.parent_summary for r in hits.shaped(asked, table, summary=0).collect()} == {None}
    assert hits.shaped(asked.limit(0), table).collect() == []


def test_a_summary_that_is_the_hit_is_left_out(spark):
    table = spark.createDataFrame([("a", 1, 1, 0, "text", "p"), ("b", 1, 1, 1, "", "p")], "chunk_key string, doc_id int, page_no int, order_in_page int, text string, parent_key string")
    whole = table.withColumn("text", F.when(F.col("chunk_key") == "a", "text\n").otherwise(F.col("text")))
    asked = spark.createDataFrame([("a",)], "chunk_key string")
    assert hits.shaped(asked, table).collect()[0].parent_summary == "text\n"
    assert hits.shaped(asked, whole, summary=4).collect()[0].parent_summary == "text…"


def test_fallback_note(spark):
    notes = ["命中 3 段（已降级为关键词）", "（无）", "）关键词（", "", None, "（不可用"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(notes)], "i int, note string")
    assert [r.n for r in rows.orderBy("i").select(hits.fallback_note(F.col("note")).alias("n")).collect()] == ["已降级为关键词", None, None, None, None, None]
