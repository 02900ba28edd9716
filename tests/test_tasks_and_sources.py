"""Task rules, streams and stores."""

import datetime
import json

from pyspark.sql import functions as F

from govflow.operators import tasks
from govflow.sources import documents
from govflow.streaming import tasks as streams

NOON = datetime.datetime(2024, 1, 1, 12)


def test_stage_edges(spark):
    rows = spark.createDataFrame([("PENDING", "RUNNING"), ("PENDING", "DONE"), ("DONE", "DONE"), ("SKIPPED", "DONE"), ("FAILED", "RUNNING")], "a string, b string")
    assert [r.ok for r in rows.select(tasks.allowed(F.col("a"), F.col("b"), tasks.STAGE_EDGES).alias("ok")).collect()] == [True, False, True, True, True]


def test_leases():
    assert (tasks.lease(None), tasks.lease(1), tasks.lease(99999), tasks.heartbeat(15), tasks.heartbeat(1800)) == (1800, 15, 3600, 5, 600)


def test_claims_go_by_priority_and_skip_running_leases(spark):
    rows = [(1, "QUEUED", 0, None), (2, "QUEUED", 5, NOON + datetime.timedelta(hours=1)), (3, "QUEUED", 5, NOON - datetime.timedelta(hours=1)), (4, "RUNNING", 9, None), (5, "QUEUED", 5, None)]
    table = spark.createDataFrame([(*r, None, 0) for r in rows], "id long, status string, priority int, lease_until timestamp, claimed_by string, attempts int")
    done = {r.id: r for r in tasks.claimed(table, ["w1", "w2"], F.lit(NOON)).collect()}
    assert {i: r.claimed_by for i, r in done.items()} == {1: None, 2: None, 3: "w1", 4: None, 5: "w2"}
    assert done[3].status == "RUNNING" and done[3].attempts == 1 and done[3].lease_until == NOON + datetime.timedelta(seconds=1800)


def test_stale_is_only_shown(spark):
    hour = datetime.timedelta(hours=1)
    rows = spark.createDataFrame([("RUNNING", NOON - hour, None, None), ("RUNNING", None, NOON, None), ("DONE", None, None, NOON - hour)], "status string, update_time timestamp, start_time timestamp, create_time timestamp")
    assert [r.s for r in rows.select(tasks.shown_status(F.lit(NOON)).alias("s")).collect()] == ["STALE", "RUNNING", "DONE"]


def test_percentiles_and_expressions(spark):
    calls = spark.createDataFrame([("q", float(i)) for i in range(1, 11)], "queue string, wait double")
    row = tasks.waits(calls).collect()[0]
    assert (row.p50, row.p95, row.p99, row.longest) == (5.0, 10.0, 10.0, 10.0)
    one = spark.range(1).select(tasks.progress(F.lit(1), F.lit(4), 20, 60).alias("p"), tasks.progress(F.lit(0), F.lit(0), 20, 60).alias("z"), tasks.remaining_seconds(F.lit(10.0), F.lit(4), F.lit(8)).alias("r")).collect()[0]
    assert (one.p, one.z, one.r) == (30.0, 20.0, 10.0)


EVENTS = [(1, 1, 0, "QUEUED"), (1, 2, 1, "RUNNING"), (1, 3, 2, "DEAD"), (1, 4, 3, "DONE"), (2, 5, 1, "QUEUED"), (2, 6, 2, "RUNNING"), (3, 7, 3, "RUNNING"), (1, 8, 5000, "QUEUED"), (4, 9, 9000, "QUEUED")]


def event_frame(spark, rows):
    return spark.createDataFrame([(run, seq, NOON + datetime.timedelta(seconds=s), state) for run, seq, s, state in rows], "run long, seq long, ts timestamp, state string")


def run_stream(spark, tmp_path, operator, mode="append"):
    """Each event is a file of its own, in order."""
    source, name = f"{tmp_path}/events", f"out_{operator.__name__ if hasattr(operator, '__name__') else 'x'}".replace("<lambda>", "x")
    for row in EVENTS:
        event_frame(spark, [row]).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("run long, seq long, ts timestamp, state string").option("maxFilesPerTrigger", 3).parquet(source)
    query = operator(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/checkpoint").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_streamed_transitions(spark, tmp_path):
    got = {(r.run, r.seq): (r.before, r.after, r.legal) for r in run_stream(spark, tmp_path, streams.judged_transitions)}
    assert got[(1, 3)] == ("RUNNING", "DEAD", False) and got[(1, 4)] == ("RUNNING", "DONE", True) and got[(3, 7)] == ("", "RUNNING", False) and len(got) == len(EVENTS)


def test_streamed_lease_expiry(spark, tmp_path):
    def leases(stream):
        return streams.expired_leases(stream, 60)

    got = {r.run: r.expired_at for r in run_stream(spark, tmp_path, leases)}
    assert got == {2: NOON + datetime.timedelta(seconds=62), 3: NOON + datetime.timedelta(seconds=63)}


def test_streamed_counts(spark, tmp_path):
    def counts(stream):
        return streams.state_counts(stream, "1 hour", "10 minutes")

    got = {(r.window_start, r.state): r.n for r in run_stream(spark, tmp_path, counts)}
    assert got[(NOON, "QUEUED")] == 2 and got[(NOON, "RUNNING")] == 3


def test_json_documents(spark, tmp_path):
    good = {"doc_id": "a", "filename": "f", "pages": [{"page_no": 1, "text": "x"}, {"page_no": 2, "text": None, "error": "e"}]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text("{broken")
    rows = documents.document_pages(documents.read_json_documents(spark, str(tmp_path))).collect()
    assert [(r.doc_id, r.page_no, r.text, r.error) for r in rows] == [("a", 1, "x", None), ("a", 2, None, "e")]


def test_vector_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", [0.12345678]), ("b", [1.0])], "chunk_key string, vector array<float>").withColumns({"embed_rev": F.lit("e1"), "clean_rev": F.lit(1), "chunk_rev": F.lit(2)})
    path = f"{tmp_path}/vectors"
    documents.write_vectors(rows, path)
    documents.write_vectors(rows.withColumn("chunk_rev", F.lit(3)), path)
    keys = spark.createDataFrame([("a",), ("c",)], "chunk_key string")
    found = documents.read_vectors(spark, path, keys, embed_rev="e1", chunk_rev=2)
    assert [(r.chunk_key, round(r.vector[0], 7)) for r in found.collect()] == [("a", 0.123457)]
    assert [r.chunk_key for r in documents.missing_vectors(keys, found).collect()] == ["c"]


def test_upsert_delete_and_revisions(spark):
    table = spark.createDataFrame([(1, 1, "old"), (2, 5, "kept"), (3, 1, "same")], "k long, v long, x string")
    changes = spark.createDataFrame([(1, 2, "new"), (2, 4, "late"), (3, 1, "tie"), (4, 1, "add")], table.schema)
    assert {r.k: r.x for r in documents.upserted(table, changes, "k", "v").collect()} == {1: "new", 2: "kept", 3: "tie", 4: "add"}
    assert {r.k for r in documents.without(table, changes.where("k = 2"), "k").collect()} == {1, 3}
    assert documents.next_revision(table.withColumn("revision", F.col("v")), "k").where("k = 2").collect()[0].revision == 6
