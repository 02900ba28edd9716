"""Reports on pipeline runs as joins of a table of tasks with a table of requests, run details with events, call statistics
and the filling of missing contract ids.

A table has no compare-and-set: each function judges requests against the tasks as they are read, and gives what is to be
written. Of several requests for one task the one of the least ``seq`` counts, the others are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govflow.operators.lists import in_days
from govflow.operators.tasks import TASK_EDGES, allowed, lease, nearest_rank, rate

# Final states of a task, states of one under way, states of an attachment's index, events' reasons.
FINAL_STATES = ("DONE", "PARTIAL", "FAILED", "CANCELLED", "DEAD")
PENDING_STATES = ("QUEUED", "RUNNING")
READY, PARSING, FAILED = "READY", "PARSING", "FAILED"
REASONS = {"DONE": "AI_DONE", "CANCELLED": "CANCEL", "DEAD": "RETRY_EXHAUSTED"}
REASON_PREFIXES = {"PARTIAL": ("AI_PARTIAL:", "有失败条目但文档可用"), "FAILED": ("AI_FAILED:", "-")}
#: Waits of a project that its percentile looks back on.
WAIT_SAMPLE = 200


def _blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def _requested(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """The first request of each task beside it; requests for unknown tasks are left out."""
    fields = F.struct(*[c for c in requests.columns if c != "id"])
    first = requests.groupBy("id").agg(F.min_by(fields, "seq").alias("q"))
    return tasks.join(first, "id")


def finished(tasks: DataFrame, reports: DataFrame) -> DataFrame:
    """id, status, doc_id, accepted, reason, attachment_status of tasks (id, status, doc_id) with a report (id, seq, status,
    doc_id, error).

    A report is accepted if it names a final state that may follow the task's. The same state again is accepted and changes
    nothing: reason and attachment_status are null. Done and partial tasks make their attachment READY, or leave it PARSING
    while neither report nor task has a doc_id; the others make it FAILED.
    """
    now, then = F.col("status"), F.upper(F.trim(F.col("q.status")))
    rows = _requested(reports, tasks).withColumns({"_legal": F.coalesce(then.isin(*FINAL_STATES) & allowed(now, then, TASK_EDGES), F.lit(False)), "_then": then})
    changed = F.col("_legal") & (F.col("_then") != now)
    doc_id = F.when(F.col("_legal") & (F.col("_then") != now), F.coalesce(_blank_to_null(F.col("q.doc_id")), "doc_id")).otherwise(F.col("doc_id"))
    reason = F.lit(None).cast("string")
    for state, text in REASONS.items():
        reason = F.when(F.col("_then") == state, text).otherwise(reason)
    for state, (prefix, other) in REASON_PREFIXES.items():
        reason = F.when(F.col("_then") == state, F.concat(F.lit(prefix), F.coalesce(F.col("q.error"), F.lit(other)))).otherwise(reason)
    shown = F.when(F.col("_then").isin("DONE", "PARTIAL"), F.when(doc_id.isNotNull(), READY).otherwise(PARSING)).otherwise(FAILED)
    return rows.select(
        "id", F.when(F.col("_legal"), F.col("_then")).otherwise(now).alias("status"), doc_id.alias("doc_id"), F.col("_legal").alias("accepted"), F.when(changed, reason).alias("reason"), F.when(changed, shown).alias("attachment_status")
    )


def renewed(tasks: DataFrame, heartbeats: DataFrame, as_of: Column) -> DataFrame:
    """id, outcome, lease_until of tasks (id, status, claimed_by, lease_until in seconds) with a heartbeat (id, seq, claimed_by,
    seconds): renewed for a running task whose lease goes on and whose holder is the caller (a blank caller is not compared),
    else not_running, other_holder or expired, in this order, with the lease as it was. A named caller can't renew a lease of
    nobody: expired."""
    caller = _blank_to_null(F.col("q.claimed_by"))
    outcome = (
        F.when(~F.col("status").eqNullSafe("RUNNING"), "not_running")
        .when(F.coalesce(caller != F.col("claimed_by"), F.lit(False)), "other_holder")
        .when(F.coalesce(F.col("lease_until") > as_of, F.lit(False)), F.when(caller.isNull() | F.col("claimed_by").isNotNull(), "renewed").otherwise("expired"))
        .otherwise("expired")
    )
    seconds = F.least(F.greatest(F.coalesce("q.seconds", F.lit(lease(None))), F.lit(lease(0))), F.lit(lease(10**9)))
    rows = _requested(heartbeats, tasks).withColumn("outcome", outcome)
    return rows.select("id", "outcome", F.when(F.col("outcome") == "renewed", as_of + seconds).otherwise(F.col("lease_until")).alias("lease_until"))


def released(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """id, outcome, status, reason of tasks (id, status) that are to go back to the queue (id, seq, reason): running ones do,
    with an event whose reason is RELEASE or RELEASE:<text>; queued ones are there already; all others are refused."""
    outcome = F.when(F.col("status") == "RUNNING", "released").when(F.col("status") == "QUEUED", "queued").otherwise("refused")
    rows = _requested(requests, tasks).withColumn("outcome", outcome)
    reason = F.concat_ws(":", F.lit("RELEASE"), _blank_to_null(F.col("q.reason")))
    return rows.select("id", "outcome", F.when(F.col("outcome") == "released", "QUEUED").otherwise(F.col("status")).alias("status"), F.when(F.col("outcome") == "released", reason).alias("reason"))


def interrupted(tasks: DataFrame) -> DataFrame:
    """id, attachment_id, status, attachment_status of the tasks that a restart finds under way: they fail, and with them
    their attachments' index."""
    return tasks.where(F.col("status").isin(*PENDING_STATES)).select("id", "attachment_id", F.lit(FAILED).alias("status"), F.lit(FAILED).alias("attachment_status"))


def submissions(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """Requests (attachment_id, automatic, ...) with outcome and task_id: where the attachment has a task under way, the latest
    one is reused by an automatic request and refuses any other; else a new task is due and task_id is null."""
    under_way = tasks.where(F.col("status").isin(*PENDING_STATES)).groupBy("attachment_id").agg(F.max("id").alias("task_id"))
    outcome = F.when(F.col("task_id").isNull(), "new").when(F.coalesce("automatic", F.lit(False)), "reused").otherwise("refused")
    return requests.join(under_way, "attachment_id", "left").withColumn("outcome", outcome)


def run_events(runs: DataFrame, artifacts: DataFrame, events: DataFrame) -> DataFrame:
    """run, artifacts, events of every run: all revisions of its artifacts (run, stage, type, revision) by stage, the latest
    first, and its events (run, id, state) by id. A run without either has empty arrays. A run must fit a row."""
    order = F.struct("stage", (-F.col("revision")).alias("at"), "type")
    held = artifacts.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: F.concat_ws("@", x["type"], (-x["at"]).cast("string"))).alias("artifacts"))
    passed = events.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "state"))), lambda x: x["state"]).alias("events"))
    none = F.array().cast("array<string>")
    return runs.join(held, "run", "left").join(passed, "run", "left").select("run", F.coalesce("artifacts", none).alias("artifacts"), F.coalesce("events", none).alias("events"))


def artifact_versions(artifacts: DataFrame) -> DataFrame:
    """Artifacts (run, type, revision) with their place among those of their run and type, the latest first."""
    place = F.row_number().over(Window.partitionBy("run", "type").orderBy(F.desc("revision")))
    return artifacts.withColumn("place", place.cast("long"))


def model_snapshot(calls: DataFrame, seconds: float) -> DataFrame:
    """model, requests, errors, error_rate, qps, p50, p95, p99 of calls (model, ok, ms) over so many seconds (at least a
    thousandth); a call whose ok is null is an error."""
    errors = F.count_if(~F.coalesce("ok", F.lit(False)))
    n = F.count(F.lit(1))
    return calls.groupBy("model").agg(
        n.alias("requests"), errors.alias("errors"), rate(errors, n).alias("error_rate"), F.round(n / F.lit(max(seconds, 0.001)), 4).alias("qps"), *[nearest_rank("ms", p).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)]
    )


def project_waits(calls: DataFrame) -> DataFrame:
    """project, admitted, p95, longest of admitted calls (project, seq, wait): all calls count, the percentile is that of the
    last 200 of a project."""
    place = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("seq")))
    sample = calls.withColumn("_place", place).where(F.col("_place") <= WAIT_SAMPLE).groupBy("project").agg(nearest_rank("wait", 0.95).alias("p95"))
    totals = calls.groupBy("project").agg(F.count(F.lit(1)).alias("admitted"), F.max("wait").alias("longest"))
    return totals.join(sample, "project").select("project", "admitted", "p95", "longest")


def logs(rows: DataFrame, begin: str | None = None, end: str | None = None, equal: dict[str, str] | None = None, contains: dict[str, str] | None = None) -> DataFrame:
    """Log rows (id, create_time, ...) of closed days whose columns equal or hold the given texts, the latest id first; a blank
    or missing parameter is no condition."""
    if begin or end:
        rows = rows.where(in_days("create_time", begin or "0001-01-01", end or "9998-12-31"))
    for column, text in (equal or {}).items():
        if text and text.strip():
            rows = rows.where(F.col(column) == text)
    for column, text in (contains or {}).items():
        if text and text.strip():
            rows = rows.where(F.col(column).contains(text))
    return rows.orderBy(F.desc("id"))


def filled_contracts(projects: DataFrame, contracts: DataFrame) -> DataFrame:
    """id, contract_id of projects (id, name, contract_no, contract_amount, contract_id): a missing id becomes that of the contract
    of the same number, or, for a project with an amount and no number, of the contract without number of the same name; the
    least id of several."""
    by_no = contracts.where("contract_no is not null").groupBy("contract_no").agg(F.min("id").alias("_by_no"))
    by_name = contracts.where("contract_no is null").groupBy(F.col("name").alias("_name")).agg(F.min("id").alias("_by_name"))
    named = F.when(F.col("contract_no").isNull() & F.col("contract_amount").isNotNull(), F.col("name"))
    rows = projects.withColumn("_key", named).join(by_no, "contract_no", "left").join(by_name, F.col("_key") == F.col("_name"), "left")
    return rows.select("id", F.coalesce("contract_id", "_by_no", "_by_name").alias("contract_id"))


def unlinked(projects: DataFrame, links: DataFrame) -> DataFrame:
    """project_id, contract_id of projects whose contract the bridge lacks; projects without contract need no link."""
    own = projects.where("contract_id is not null").select(F.col("id").alias("project_id"), "contract_id")
    return own.join(links.select("project_id", "contract_id").distinct(), ["project_id", "contract_id"], "left_anti")


def contracts_to_make(projects: DataFrame, contracts: DataFrame) -> DataFrame:
    """Projects with a contract number or amount for whose number there is no contract yet."""
    known = contracts.where("contract_no is not null").select("contract_no").distinct()
    return projects.where("contract_no is not null or contract_amount is not null").join(known, "contract_no", "left_anti")


def project_probe(projects: DataFrame, phases: DataFrame, attachments: DataFrame, contracts: DataFrame, links: DataFrame, payments: DataFrame) -> DataFrame:
    """id, attachments (of its phases), children, contracts, contract_total, payments, paid_total of each project. Every part is
    summed by project before it is joined; a count of nothing is 0, a sum of nothing null."""
    by = lambda rows, key, *sums: rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(*sums)
    n = F.count(F.lit(1))
    held = attachments.where("biz_type = 'PROJECT_PHASE'").select(F.col("biz_id").alias("phase")).join(phases.select(F.col("id").alias("phase"), "project_id"), "phase")
    linked = links.join(contracts.select(F.col("id").alias("contract_id"), "contract_amount"), "contract_id")
    total = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("decimal(18,2)")
    rows = projects.select("id")
    for part in (
        by(held, "project_id", n.alias("attachments")),
        by(projects, "parent_id", n.alias("children")),
        by(linked, "project_id", n.alias("contracts"), total("contract_amount").alias("contract_total")),
        by(payments, "project_id", n.alias("payments"), total("paid_amount").alias("paid_total")),
    ):
        rows = rows.join(part, "id", "left")
    return rows.na.fill(0, ["attachments", "children", "contracts", "payments"])
