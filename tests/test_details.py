"""Names, statuses and artifacts against literals."""

import pytest
from pyspark.sql import functions as F

from govflow.operators import cleaning, details


def test_statuses_are_parsed_in_order():
    assert details.parse_statuses(" queued, RUNNING,,queued ") == ["QUEUED", "RUNNING"]
    assert details.parse_statuses(None) == details.parse_statuses("  ") == []
    for bad in ("PENDING", "done,skipped", "nothing", ",,"):
        with pytest.raises(ValueError):
            details.parse_statuses(bad)


def test_run_ids_json_and_notes(spark):
    rows = spark.createDataFrame([("run-12",), (" run-7 ",), ("run-",), ("run-x",), ("run-1234567890123456789",), (None,)], "r string")
    assert [r.t for r in rows.select(details.task_of(F.col("r")).alias("t")).collect()] == [12, 7, None, None, None, None]
    texts = spark.createDataFrame([('{"a": [1]}',), ("plain text",), ("",), (None,), ("12",)], "c string")
    assert [r.f and r.f.is_json for r in texts.select(details.json_or_text(F.col("c")).alias("f")).collect()] == [True, False, False, None, True]
    notes = spark.createDataFrame([('{"n":1}', "a \"b\""), (None, "x"), ('"t"', None), (None, " ")], "c string, n string")
    got = [r.v for r in notes.select(details.artifact_content(F.col("c"), F.col("n"), 100).alias("v")).collect()]
    assert got == ['{"_note":"a \\"b\\"","_content":{"n":1}}', '{"_note":"x"}', '"t"', None]


def test_table_ranges_count_live_lines_only(spark):
    lines = [(1, 1, i, x, x == "t", "c2" if x == "gone" else None) for i, x in enumerate(["gone", "a", "t", "t", "gone", "t", "b", "t"])]
    frame = spark.createDataFrame(lines, "doc_id long, page_no long, line_no int, text string, table boolean, rule string")
    assert sorted(tuple(r) for r in cleaning.table_ranges(frame).select("start", "end", "rows").collect()) == [(1, 3, 3), (5, 5, 1)]


def test_default_templates(spark):
    rows = [(5, "A", 1, 1, 2), (6, "A", 1, 1, 1), (1, "A", 0, 1, 0), (9, "B", None, 1, 0), (8, "B", 0, 1, 5), (7, "C", 1, 0, 1)]
    frame = spark.createDataFrame(rows, "id long, project_type string, is_default int, enabled int, sort_no int")
    assert {r.project_type: r.template_id for r in details.default_templates(frame).collect()} == {"A": 6, "B": 8}
    assert details.next_sort_no(frame.where("false")).first().sort_no == 1


@pytest.mark.parametrize(("text", "valid"), [("4397110767823743 +1 (654)", False), ('{"a": 1} {"b": 2}', False), ("[1] x", False), ("1], [2", False), ('1}, {"a": 2', False), ("1, 2", False), ('1, "b": 2', False), ("]", False), (' [1, {"a": "]"}] ', True), ('"x"', True), (" -1.5e3 ", True), ("null", True)])
def test_a_value_with_something_behind_it_is_no_json(spark, text, valid):
    assert spark.createDataFrame([(text,)], "c string").select(details.json_or_text(F.col("c"))["is_json"]).first()[0] is valid


@pytest.mark.parametrize("search", [False, True])
def test_payments_without_a_contract_are_dealt_out(spark, search):
    """Rows of a null key match nothing and must not all go to one task."""
    payments = spark.range(4000).selectExpr("id", "if(id % 2 = 0, id % 7, null) AS contract_id", "if(id % 3 = 0, id % 5, null) AS project_id", "'N7' AS node")
    names = spark.range(10).selectExpr("id", "concat('name ', id) AS name")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = details.keyword_payments(payments, names, ["node"], ["name"], "n7") if search else details.with_names(payments, names, names)
        got = rows.withColumn("task", F.spark_partition_id()).where("contract_id is null").groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r["count"] for r in got) == 2000 and max(r["count"] for r in got) < 800
