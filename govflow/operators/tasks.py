"""Task events: the state machine, leases, stages and quality of the document pipeline.

A table has no compare-and-set, so claims are a deterministic ranking by one writer; ``as_of`` is the time of the call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# From which state a task or a stage may go to which, and the order of stages.
TASK_EDGES = {
    "": ("QUEUED",),
    "QUEUED": ("RUNNING", "FAILED"),
    "RUNNING": ("DONE", "PARTIAL", "FAILED", "QUEUED", "CANCELLED"),
    "PARTIAL": ("QUEUED",),
    "FAILED": ("QUEUED", "DEAD"),
    "DONE": ("QUEUED",),
}
STAGE_EDGES = {
    "PENDING": ("RUNNING", "SKIPPED"),
    "RUNNING": ("DONE", "PARTIAL", "SKIPPED", "FAILED", "CANCELLED"),
    "SKIPPED": ("DONE",),
    "FAILED": ("PENDING", "RUNNING"),
    "CANCELLED": ("PENDING", "RUNNING"),
    "DONE": ("PENDING", "RUNNING"),
    "PARTIAL": ("PENDING", "RUNNING"),
}
# The percents of an upload that a stage spans.
STAGE_SPANS = {"render": (5, 20), "ocr": (20, 95), "check": (95, 96), "embed": (96, 99), "store": (99, 100)}
STAGES = ("PARSE", "CLEAN", "CHUNK", "EMBED", "INDEX", "RETRIEVE", "GENERATE")
CHANNEL_WEIGHT = {"QA": 100, "SEARCH": 20, "PARSE": 10, "EMBED": 5}
LEASE, LEASE_RANGE, STALE_AFTER = 1800, (15, 3600), 300


def allowed(before: Column, after: Column, edges: dict[str, tuple[str, ...]] = TASK_EDGES) -> Column:
    """Whether a state may follow another; the same state again always may."""
    hit = before == after
    for state, targets in edges.items():
        hit = hit | ((before == state) & after.isin(*targets))
    return hit


def transitions(events: DataFrame, edges: dict[str, tuple[str, ...]] = TASK_EDGES) -> DataFrame:
    """run, seq, before, after, legal of events (run, seq, state), each judged against the event before it in its run."""
    before = F.coalesce(F.lag("state").over(Window.partitionBy("run").orderBy("seq")), F.lit(""))
    return events.select("run", "seq", before.alias("before"), F.col("state").alias("after")).withColumn("legal", allowed(F.col("before"), F.col("after"), edges))


def lease(seconds: int | None) -> int:
    return min(max(seconds if seconds is not None else LEASE, LEASE_RANGE[0]), LEASE_RANGE[1])


def heartbeat(seconds: int | None) -> int:
    return max(5, lease(seconds) // 3)


def claimable(tasks: DataFrame, as_of: Column, n: int = 10) -> DataFrame:
    """Queued tasks without a running lease, by priority, then age."""
    free = (F.col("status") == "QUEUED") & (F.col("lease_until").isNull() | (F.col("lease_until") < as_of))
    return tasks.where(free).orderBy(F.desc("priority"), "id").limit(n)


def claimed(tasks: DataFrame, workers: list[str], as_of: Column, seconds: int | None = None) -> DataFrame:
    """The tasks after one round in which each worker takes one claimable task, in order."""
    rank = F.row_number().over(Window.orderBy(F.desc("priority"), "id"))  # over at most as many rows as workers
    taken = claimable(tasks, as_of, len(workers)).withColumn("_rank", rank)
    taken = taken.select(F.col("id").alias("_id"), F.element_at(F.lit(workers), F.col("_rank")).alias("_worker"))
    rows = tasks.join(F.broadcast(taken), F.col("id") == F.col("_id"), "left")
    hit = F.col("_worker").isNotNull()
    until = as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lease(seconds)))
    changed = {"status": F.when(hit, "RUNNING").otherwise(F.col("status")), "claimed_by": F.coalesce("_worker", "claimed_by"), "lease_until": F.when(hit, until).otherwise(F.col("lease_until")), "attempts": F.col("attempts") + hit.cast("int")}
    return rows.withColumns(changed).drop("_id", "_worker")


def expired(tasks: DataFrame, as_of: Column, n: int = 20) -> DataFrame:
    """Running tasks whose lease is over, which go back to the queue; by id, at most ``n`` a call."""
    return tasks.where((F.col("status") == "RUNNING") & (F.col("lease_until") < as_of)).orderBy("id").limit(n)


def shown_status(as_of: Column, seconds: int = STALE_AFTER) -> Column:
    """STALE for what runs without a sign of life; only shown, never stored."""
    touched = F.coalesce("update_time", "start_time", "create_time")
    silent = F.unix_timestamp(as_of) - F.unix_timestamp(touched)
    return F.when((F.col("status") == "RUNNING") & (silent > seconds), "STALE").otherwise(F.col("status"))


def stage_summary(events: DataFrame) -> DataFrame:
    """run, stage, status, attempts, items, elapsed_s of events (run, stage, ts, status, items): the latest state of each
    stage, in stage order."""
    last = F.max_by("status", F.struct("ts", "seq"))
    started = F.min(F.when(F.col("status") == "RUNNING", F.unix_timestamp("ts")))
    ended = F.max(F.when(F.col("status").isin("DONE", "PARTIAL", "FAILED", "SKIPPED", "CANCELLED"), F.unix_timestamp("ts")))
    rows = events.groupBy("run", "stage").agg(last.alias("status"), F.count_if(F.col("status") == "RUNNING").alias("attempts"), F.sum("items").cast("long").alias("items"), F.greatest(ended - started, F.lit(0)).alias("elapsed_s"))
    return rows.withColumn("position", F.array_position(F.lit(list(STAGES)), F.col("stage")))


def nearest_rank(column: str, p: float) -> Column:
    """The smallest value with at least p of the rows at or below it; 0 for no rows."""
    return F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})"), F.lit(0.0))


def waits(calls: DataFrame) -> DataFrame:
    """queue, n, p50, p95, p99, longest of calls (queue, wait)."""
    return calls.groupBy("queue").agg(F.count(F.lit(1)).alias("n"), *[nearest_rank("wait", p).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)], F.max("wait").alias("longest"))


def rate(hits: Column, total: Column, digits: int = 4) -> Column:
    return F.round(F.try_divide(hits, total), digits)


def model_metrics(calls: DataFrame) -> DataFrame:
    """model, requests, errors, error_rate of calls (model, ok)."""
    return calls.groupBy("model").agg(F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("ok")).alias("errors"), rate(F.count_if(~F.col("ok")), F.count(F.lit(1))).alias("error_rate"))


def scheduled(queue: DataFrame, slots_per_project: int) -> DataFrame:
    """Queued requests (id, project, channel, priority, waited) in the order in which they are served: the task's priority,
    its channel's weight and an age bonus (2 for each 30 s, 40 at most); a project gets so many places at once."""
    weight = F.lit(0)
    for channel, points in CHANNEL_WEIGHT.items():
        weight = F.when(F.col("channel") == channel, points).otherwise(weight)
    effective = F.col("priority") + weight + F.least(F.lit(40), F.floor(F.col("waited") / 30) * 2)
    rows = queue.withColumn("effective", effective.cast("long"))
    place = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("effective"), "id"))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= slots_per_project)


def reindex_plan(chunks: DataFrame, vectors: DataFrame, model: str, clean_rev: int, chunk_rev: int) -> DataFrame:
    """state, n: fresh chunks have a vector of this model and these revisions, stale ones another, missing none."""
    current = (F.col("model") == model) & (F.col("clean_rev") == clean_rev) & (F.col("chunk_rev") == chunk_rev)
    known = vectors.groupBy("chunk_key").agg(F.bool_or(current).alias("_current"))
    rows = chunks.select("chunk_key").join(known, "chunk_key", "left")
    state = F.when(F.col("_current").isNull(), "missing").when(F.col("_current"), "fresh").otherwise("stale")
    return rows.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def stale_sample(chunks: DataFrame, vectors: DataFrame, model: str, clean_rev: int, chunk_rev: int, n: int = 20) -> DataFrame:
    """The least ``n`` keys of chunks that have vectors, but none of this model and these revisions."""
    current = (F.col("model") == model) & (F.col("clean_rev") == clean_rev) & (F.col("chunk_rev") == chunk_rev)
    known = vectors.groupBy("chunk_key").agg(F.bool_or(current).alias("_current")).where(~F.coalesce("_current", F.lit(False)))
    return chunks.select("chunk_key").join(known.select("chunk_key"), "chunk_key", "left_semi").orderBy("chunk_key").limit(n)


def progress(done: Column, total: Column, begin: Column | float, end: Column | float) -> Column:
    """Percent of a stage that spans [begin, end] of the whole, one digit; no more than its end."""
    share = F.when(total > 0, F.least(F.lit(1.0), done / total)).otherwise(F.lit(0.0))
    return F.round(begin + (end - begin) * share, 1)


def task_percent(status: Column, stage: Column, done: Column, total: Column) -> Column:
    """Percent of an upload task: 100 when done, else by the span of its stage; stages without one are the first 5."""
    span = lambda i, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in STAGE_SPANS.items() for x in (k, float(v[i]))]), stage), F.lit(other))
    return F.when(status == "DONE", 100.0).otherwise(progress(done, total, span(0, 0.0), span(1, 5.0)))


def remaining_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    """By the mean time of what is done, one digit; 0 before anything and once all is done."""
    left = F.round(F.try_divide(elapsed, done) * (total - done), 1)
    return F.when((done > 0) & (done < total), left).otherwise(F.lit(0.0))
