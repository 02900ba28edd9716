"""Task and pipeline queries over the driver's events, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from govflow.operators import hierarchy, tasks

QUERIES, ORACLE = {}, {}
AS_OF = "2024-01-15 12:00:00"
STATES = {"view": "QUEUED", "click": "RUNNING", "purchase": "DONE", "signup": "PARTIAL", "error": "FAILED"}
CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items())
EVENTS = f"ev AS (SELECT user_id AS run, event_id AS seq, ts, CASE event_type {CASES} ELSE 'QUEUED' END AS state, value FROM events)"
TASKS = f"""{EVENTS}, tasks AS (SELECT seq AS id, run, state AS status, (seq % 4)::INT AS priority, CASE WHEN seq % 3 > 0 THEN floor(epoch(ts))::BIGINT + 900 END AS lease_until, floor(epoch(ts))::BIGINT AS created FROM ev)"""


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def events(t):
    """run, seq, ts, state, value: a user's events stand for a task's."""
    state = F.lit("QUEUED")
    for kind, name in STATES.items():
        state = F.when(F.col("event_type") == kind, name).otherwise(state)
    return t("events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), "ts", state.alias("state"), "value")


def task_rows(t):
    """One task per event, with a lease that every third one lacks."""
    k, created = F.col("seq"), F.unix_timestamp(F.col("ts").cast("timestamp"))
    return events(t).select(k.alias("id"), "run", F.col("state").alias("status"), (k % 4).cast("int").alias("priority"), F.when(k % 3 > 0, created + 900).alias("lease_until"), created.alias("created"))


def middle(t):
    """A time in the middle of the events, in seconds: one row."""
    return t("events").agg(F.floor((F.min(F.unix_timestamp(F.col("ts").cast("timestamp"))) + F.max(F.unix_timestamp(F.col("ts").cast("timestamp")))) / 2).alias("now"))


MIDDLE = "(SELECT (min(floor(epoch(ts))::BIGINT) + max(floor(epoch(ts))::BIGINT)) // 2 FROM ev)"


@query(f"WITH {EVENTS} SELECT run, arg_max(state, seq) AS state, max(seq) AS seq FROM ev GROUP BY 1")
def latest_task(t):
    return hierarchy.latest(events(t), "run", "seq").select("run", "state", "seq")


EDGES = ", ".join(f"('{a}', '{b}')" for a, targets in tasks.TASK_EDGES.items() for b in targets)


@query(f"WITH {EVENTS}, pair AS (SELECT coalesce(lag(state) OVER (PARTITION BY run ORDER BY seq), '') AS before, state AS after FROM ev) SELECT before, after, before = after OR (before, after) IN ({EDGES}) AS legal, count(*) AS n FROM pair GROUP BY ALL")
def task_transitions(t):
    return tasks.transitions(events(t)).groupBy("before", "after", "legal").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVENTS}, pair AS (SELECT run, seq, coalesce(lag(state) OVER (PARTITION BY run ORDER BY seq), '') AS before, state AS after FROM ev) SELECT * FROM pair WHERE before <> after AND (before, after) NOT IN ({EDGES})")
def illegal_transitions(t):
    return tasks.transitions(events(t)).where("not legal").drop("legal")


@query(f"WITH {TASKS} SELECT id, priority FROM tasks WHERE status = 'QUEUED' AND (lease_until IS NULL OR lease_until < {MIDDLE}) ORDER BY priority DESC, id LIMIT 10")
def claim_order(t):
    rows = task_rows(t).crossJoin(middle(t))
    return tasks.claimable(rows, F.col("now")).select("id", "priority")


@query(f"WITH {TASKS} SELECT id, lease_until FROM tasks WHERE status = 'RUNNING' AND lease_until < {MIDDLE} ORDER BY id LIMIT 20")
def expired_leases(t):
    return tasks.expired(task_rows(t).crossJoin(middle(t)), F.col("now")).select("id", "lease_until")


@query(f"WITH {TASKS} SELECT CASE WHEN status = 'RUNNING' AND {MIDDLE} - created > 300 THEN 'STALE' ELSE status END AS shown, count(*) AS n FROM tasks GROUP BY 1")
def stale_stages(t):
    rows = task_rows(t).crossJoin(middle(t)).select("status", F.timestamp_seconds("now").alias("now"), F.lit(None).cast("timestamp").alias("update_time"), F.timestamp_seconds("created").alias("start_time"), F.lit(None).cast("timestamp").alias("create_time"))
    return rows.groupBy(tasks.shown_status(F.col("now")).alias("shown")).agg(F.count(F.lit(1)).alias("n"))


STAGE_LIST = "['PARSE', 'CLEAN', 'CHUNK', 'EMBED', 'INDEX', 'RETRIEVE', 'GENERATE']"


@query(
    f"""WITH {EVENTS}, st AS (SELECT *, {STAGE_LIST}[seq % 7 + 1] AS stage FROM ev)
    SELECT run, stage, arg_max(state, seq) AS status, count(*) FILTER (state = 'RUNNING') AS attempts, sum(seq % 10)::BIGINT AS items,
        greatest(max(floor(epoch(ts))::BIGINT) FILTER (state IN ('DONE', 'PARTIAL', 'FAILED')) - min(floor(epoch(ts))::BIGINT) FILTER (state = 'RUNNING'), 0) AS elapsed_s,
        list_position({STAGE_LIST}, stage)::BIGINT AS position FROM st GROUP BY 1, 2"""
)
def stage_summary(t):
    stage = F.element_at(F.array(*map(F.lit, tasks.STAGES)), (F.col("seq") % 7 + 1).cast("int"))
    # The driver's events are in the order of their ids.
    rows = events(t).select("run", "seq", F.col("ts").cast("timestamp").alias("ts"), F.col("state").alias("status"), stage.alias("stage"), (F.col("seq") % 10).alias("items"))
    return tasks.stage_summary(rows)


@query("SELECT event_type AS queue, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS longest FROM events WHERE value IS NOT NULL GROUP BY 1")
def wait_percentile(t):
    return tasks.waits(t("events").where("value is not null").select(F.col("event_type").alias("queue"), F.col("value").alias("wait")))


@query(f"WITH {EVENTS} SELECT run % 50 AS model, count(*) AS requests, count(*) FILTER (state = 'FAILED') AS errors, round(count(*) FILTER (state = 'FAILED') / count(*), 4) AS error_rate FROM ev GROUP BY 1")
def model_metrics(t):
    return tasks.model_metrics(events(t).select((F.col("run") % 50).alias("model"), (F.col("state") != "FAILED").alias("ok")))


@query(
    f"""WITH {EVENTS}, q AS (SELECT seq AS id, run % 20 AS project, (seq % 4) + CASE seq % 5 WHEN 0 THEN 100 WHEN 1 THEN 20 WHEN 2 THEN 10 WHEN 3 THEN 5 ELSE 0 END + least(40, floor((seq % 1000) / 30)::BIGINT * 2) AS effective FROM ev WHERE state = 'QUEUED')
    SELECT project, id, effective, place FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY effective DESC, id) AS place FROM q) WHERE place <= 3"""
)
def scheduled_requests(t):
    k = F.col("seq")
    channel = F.element_at(F.array(*map(F.lit, ("QA", "SEARCH", "PARSE", "EMBED", "OTHER"))), (k % 5 + 1).cast("int"))
    rows = events(t).where("state = 'QUEUED'").select(k.alias("id"), (F.col("run") % 20).alias("project"), channel.alias("channel"), (k % 4).alias("priority"), (k % 1000).alias("waited"))
    return tasks.scheduled(rows, 3).select("project", "id", "effective", "place")


@query("SELECT CASE WHEN e.vec_id IS NULL THEN 'missing' WHEN e.vec_id % 3 > 0 THEN 'fresh' ELSE 'stale' END AS state, count(*) AS n FROM documents LEFT JOIN embeddings e ON e.vec_id = doc_id GROUP BY 1")
def reindex_plan(t):
    chunks = t("documents").select(F.col("doc_id").cast("string").alias("chunk_key"))
    vectors = t("embeddings").select(F.col("vec_id").cast("string").alias("chunk_key"), F.lit("m").alias("model"), F.lit(2).alias("clean_rev"), F.when(F.col("vec_id") % 3 > 0, 5).otherwise(4).alias("chunk_rev"))
    return tasks.reindex_plan(chunks, vectors, "m", 2, 5)


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events WHERE ts >= (SELECT min(ts) FROM events)::DATE + 1 AND ts < (SELECT min(ts) FROM events)::DATE + 4 GROUP BY 1, 2")
def log_search(t):
    """Rows of three whole days, by day and kind."""
    begin = F.date_add(F.to_date("lo"), 1)
    rows = t("events").crossJoin(t("events").agg(F.min("ts").alias("lo"))).where((F.to_date("ts") >= begin) & (F.to_date("ts") < F.date_add(F.to_date("lo"), 4)))
    return rows.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
