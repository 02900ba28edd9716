import pytest
from pyspark.sql import functions as F

from govflow.operators import documents, runs, tasks
from govflow.sources import documents as store

TASKS = "id long, status string, doc_id string"


def by_id(df):
    return {r.id: tuple(r)[1:] for r in df.collect()}


def test_finished_keeps_what_is_refused_and_ignores_repeats(spark):
    rows = spark.createDataFrame([(1, "RUNNING", None), (2, "DONE", "d"), (3, "CANCELLED", None), (4, "RUNNING", "d"), (5, "RUNNING", None), (6, None, None)], TASKS)
    reports = spark.createDataFrame(
        [(1, 1, "done", " ", None), (1, 2, "FAILED", None, "late"), (2, 1, "DONE", "x", None), (3, 1, "DONE", None, None), (4, 1, "PARTIAL", None, "two pages"), (5, 1, "QUEUED", None, None), (6, 1, "DONE", None, None), (7, 1, "DONE", None, None)],
        "id long, seq long, status string, doc_id string, error string",
    )
    assert by_id(runs.finished(rows, reports)) == {
        1: ("DONE", None, True, "AI_DONE", "PARSING"),
        2: ("DONE", "d", True, None, None),
        3: ("CANCELLED", None, False, None, None),
        4: ("PARTIAL", "d", True, "AI_PARTIAL:two pages", "READY"),
        5: ("RUNNING", None, False, None, None),
        6: (None, None, False, None, None),
    }
    assert runs.finished(rows, reports.limit(0)).count() == 0


def test_renewed_names_what_hinders(spark):
    rows = spark.createDataFrame([(1, "RUNNING", "a", 200), (2, "RUNNING", "a", 200), (3, "RUNNING", "a", 100), (4, "DONE", "a", 200), (5, "RUNNING", None, 200), (6, "RUNNING", "a", None), (7, "RUNNING", "a", 200)], "id long, status string, claimed_by string, lease_until long")
    beats = spark.createDataFrame([(1, 1, "a", 1), (2, 1, "b", None), (3, 1, "a", None), (4, 1, "a", None), (5, 1, "a", None), (6, 1, "", None), (7, 1, " ", 99999)], "id long, seq long, claimed_by string, seconds long")
    assert by_id(runs.renewed(rows, beats, F.lit(100))) == {1: ("renewed", 115), 2: ("other_holder", 200), 3: ("expired", 100), 4: ("not_running", 200), 5: ("expired", 200), 6: ("expired", None), 7: ("renewed", 3700)}


def test_released_and_interrupted(spark):
    rows = spark.createDataFrame([(1, "RUNNING"), (2, "QUEUED"), (3, "DONE"), (4, None)], "id long, status string")
    asked = spark.createDataFrame([(i, 1, None) for i in range(1, 6)], "id long, seq long, reason string")
    assert by_id(runs.released(rows, asked)) == {1: ("released", "QUEUED", "RELEASE"), 2: ("queued", "QUEUED", None), 3: ("refused", "DONE", None), 4: ("refused", None, None)}
    assert set(by_id(runs.interrupted(rows.withColumn("attachment_id", F.col("id"))))) == {1, 2}


def test_submissions_look_for_a_task_under_way(spark):
    rows = spark.createDataFrame([(1, 7, "QUEUED"), (2, 7, "RUNNING"), (3, 8, "DONE"), (4, None, "QUEUED")], "id long, attachment_id long, status string")
    asked = spark.createDataFrame([(7, True), (7, False), (7, None), (8, True), (None, True)], "attachment_id long, automatic boolean")
    got = sorted((tuple(r) for r in runs.submissions(asked, rows).select("attachment_id", "automatic", "outcome", "task_id").collect()), key=repr)
    assert got == sorted([(7, True, "reused", 2), (7, False, "refused", 2), (7, None, "refused", 2), (8, True, "new", None), (None, True, "new", None)], key=repr)


def test_project_waits_look_back_on_200(spark):
    calls = spark.range(300).select(F.lit("p").alias("project"), F.col("id").alias("seq"), F.when(F.col("id") < 100, 1000.0).otherwise(F.col("id") - 99.0).alias("wait"))
    assert [tuple(r) for r in runs.project_waits(calls).collect()] == [("p", 300, 190.0, 1000.0)]


def test_contracts_are_filled_by_number_then_name(spark):
    projects = spark.createDataFrame([(1, "A", "n1", 5, None), (2, "B", None, 5, None), (3, "B", None, None, None), (4, "B", "n9", 5, None), (5, "A", "n1", 5, 99)], "id long, name string, contract_no string, contract_amount long, contract_id long")
    contracts = spark.createDataFrame([(10, "X", "n1"), (11, "Y", "n1"), (12, "B", None), (13, "B", "n2")], "id long, name string, contract_no string")
    assert by_id(runs.filled_contracts(projects, contracts)) == {1: (10,), 2: (12,), 3: (None,), 4: (None,), 5: (99,)}
    assert {r.id for r in runs.contracts_to_make(projects, contracts).collect()} == {2, 4}
    links = spark.createDataFrame([(5, 98)], "project_id long, contract_id long")
    assert [tuple(r) for r in runs.unlinked(projects, links).collect()] == [(5, 99)]


def test_progress_and_remaining_time(spark):
    one = spark.range(1).select(
        tasks.task_percent(F.lit("DONE"), F.lit("ocr"), F.lit(0), F.lit(9)).alias("a"),
        tasks.task_percent(F.lit("RUNNING"), F.lit("ocr"), F.lit(12), F.lit(9)).alias("b"),
        tasks.task_percent(F.lit("RUNNING"), F.lit("other"), F.lit(1), F.lit(2)).alias("c"),
        tasks.remaining_seconds(F.lit(9.0), F.lit(0), F.lit(2)).alias("d"),
        tasks.remaining_seconds(F.lit(9.0), F.lit(3), F.lit(2)).alias("e"),
    )
    assert tuple(one.collect()[0]) == (100.0, 95.0, 2.5, 0.0, 0.0)


def test_availability_refuses_too_many(spark):
    records = spark.createDataFrame([(1, "k"), (2, None)], "id long, object_key string")
    objects = spark.createDataFrame([("k",)], "object_key string")
    assert [(r.id, r.state) for r in documents.availability([3, 2, 1, 3], records, objects).orderBy("position").collect()] == [(3, "missing_record"), (2, "missing_object"), (1, "ok")]
    for asked in ([], [0], list(range(1, 52))):
        with pytest.raises(ValueError):
            documents.availability(asked, records, objects)


def test_logs_and_stores(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a_b", "x"), (2, "2024-01-02 23:59:59.999", "a_b", "y"), (3, "2024-01-03 00:00:00", "acb", None)], "id long, create_time string, detail string, kind string").withColumn("create_time", F.col("create_time").cast("timestamp"))
    assert [r.id for r in runs.logs(rows, "2024-01-01", "2024-01-02").collect()] == [2, 1]
    assert [r.id for r in runs.logs(rows, end="2024-01-02", contains={"detail": "a_b"}, equal={"kind": "y"}).collect()] == [2]
    assert runs.logs(rows, contains={"detail": " "}, equal={"kind": None}).count() == 3
    log, snapshot = f"{tmp_path}/log", f"{tmp_path}/snapshot"
    store.append_log(rows, log)
    store.append_log(rows.limit(1), log)
    assert spark.read.parquet(log).count() == 4
    store.write_snapshot(rows.select("id"), snapshot)
    store.write_snapshot(rows.select("id").limit(2), snapshot)
    assert store.read_snapshot(spark, snapshot, "id long").count() == 2
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.txt").write_bytes(b"abc")
    (tmp_path / "deep" / "b.bin").write_bytes(b"")
    assert [(r.size, bytes(r.content)) for r in store.read_objects(spark, f"{tmp_path}/deep", "*.txt").collect()] == [(3, b"abc")]
