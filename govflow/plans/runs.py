"""Queries over reports on runs, their details, call statistics, stores and event streams, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govflow.functions import text as X
from govflow.operators import concurrency, documents, runs, tasks
from govflow.operators.durable import new_path
from govflow.plans import details
from govflow.plans import tasks as T
from govflow.plans import texts
from govflow.sources import documents as store
from govflow.sources import keyed
from govflow.streaming import leases
from govflow.streaming import tasks as streaming
from govflow.views import Portfolio, oracle

QUERIES, ORACLE = {}, {}


def query(views: str, sql: str, more: str = ""):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Portfolio(spark, sf_dir))
        ORACLE[f.__name__] = oracle(views, sql, more) if views else f"WITH {more} {sql}" if more else sql
        return f

    return add


def pick(index, values):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def made_tasks(p) -> DataFrame:
    return made_tasks_of(T.events(p.table)).drop("ts")


def made_tasks_of(rows: DataFrame) -> DataFrame:
    """A task for each event: its state, an attachment, for some a document, a holder and a lease."""
    k = F.col("seq")
    created = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return rows.select("ts", k.alias("id"), (k % 300).alias("attachment_id"), F.col("state").alias("status"), F.when(k % 4 == 0, F.concat(F.lit("d"), k.cast("string"))).alias("doc_id"), F.when(k % 5 > 0, F.concat(F.lit("w"), (k % 3).cast("string"))).alias("claimed_by"), F.when(k % 7 > 0, created).alias("lease_until"))


MADE = f"""{T.EVENTS}, tasks AS (SELECT seq AS id, seq % 300 AS attachment_id, state AS status, CASE WHEN seq % 4 = 0 THEN 'd' || seq::VARCHAR END AS doc_id, CASE WHEN seq % 5 > 0 THEN 'w' || (seq % 3)::VARCHAR END AS claimed_by,
    CASE WHEN seq % 7 > 0 THEN floor(epoch(ts))::BIGINT END AS lease_until FROM ev)"""
EDGES = ", ".join(f"('{a}', '{b}')" for a, targets in tasks.TASK_EDGES.items() for b in targets)
REPORTED = ("DONE", " partial", "FAILED", "CANCELLED", "DEAD", "RUNNING", "nonsense")


@query(
    "",
    f"""SELECT id, CASE WHEN legal THEN after ELSE status END AS status, CASE WHEN legal AND after <> status THEN coalesce(new_doc, doc_id) ELSE doc_id END AS doc_id, legal AS accepted,
        CASE WHEN legal AND after <> status THEN CASE after WHEN 'DONE' THEN 'AI_DONE' WHEN 'CANCELLED' THEN 'CANCEL' WHEN 'DEAD' THEN 'RETRY_EXHAUSTED' WHEN 'PARTIAL' THEN 'AI_PARTIAL:' || coalesce(error, '有失败条目但文档可用') ELSE 'AI_FAILED:' || coalesce(error, '-') END END AS reason,
        CASE WHEN legal AND after <> status THEN CASE WHEN after IN ('DONE', 'PARTIAL') THEN CASE WHEN coalesce(new_doc, doc_id) IS NULL THEN 'PARSING' ELSE 'READY' END ELSE 'FAILED' END END AS attachment_status
    FROM (SELECT *, after IN ('DONE', 'PARTIAL', 'FAILED', 'CANCELLED', 'DEAD') AND (after = status OR (status, after) IN ({EDGES})) AS legal
        FROM (SELECT *, ['DONE', 'PARTIAL', 'FAILED', 'CANCELLED', 'DEAD', 'RUNNING', 'NONSENSE'][id % 7 + 1] AS after, CASE WHEN id % 6 = 0 THEN 'n' || id::VARCHAR END AS new_doc, CASE WHEN id % 2 = 0 THEN 'e' || id::VARCHAR END AS error FROM tasks))""",
    MADE,
)
def finished_runs(p):
    """Two reports a task, of which the first counts."""
    k = F.col("id")
    reports = made_tasks(p).select(k, F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")).select(
        "id", "seq", F.when(F.col("seq") == 1, pick(k % 7, REPORTED)).otherwise("DEAD").alias("status"), F.when(k % 6 == 0, F.concat(F.lit("n"), k.cast("string"))).otherwise(" ").alias("doc_id"), F.when(k % 2 == 0, F.concat(F.lit("e"), k.cast("string"))).alias("error")
    )
    return runs.finished(made_tasks(p), reports)


@query(
    "",
    f"""SELECT id, outcome, CASE WHEN outcome = 'renewed' THEN now + least(greatest(seconds, 15), 3600) ELSE lease_until END AS lease_until
    FROM (SELECT *, CASE WHEN status <> 'RUNNING' THEN 'not_running' WHEN caller IS NOT NULL AND claimed_by IS NOT NULL AND caller <> claimed_by THEN 'other_holder'
            WHEN lease_until > now AND (caller IS NULL OR caller = claimed_by) THEN 'renewed' ELSE 'expired' END AS outcome
        FROM (SELECT *, {T.MIDDLE} AS now, CASE WHEN id % 2 = 0 THEN 'w' || (id % 6)::VARCHAR END AS caller, coalesce(CASE WHEN id % 9 > 0 THEN id % 9 * 600 END, 1800) AS seconds FROM tasks))""",
    MADE,
)
def renewed_leases(p):
    k = F.col("id")
    beats = made_tasks(p).select(k, F.lit(1).alias("seq"), F.when(k % 2 == 0, F.concat(F.lit("w"), (k % 6).cast("string"))).otherwise("").alias("claimed_by"), F.when(k % 9 > 0, k % 9 * 600).alias("seconds"))
    return runs.renewed(made_tasks(p).crossJoin(T.middle(p.table)), beats, F.col("now"))


@query("", "SELECT id, CASE status WHEN 'RUNNING' THEN 'released' WHEN 'QUEUED' THEN 'queued' ELSE 'refused' END AS outcome, CASE WHEN status = 'RUNNING' THEN 'QUEUED' ELSE status END AS status, CASE WHEN status = 'RUNNING' THEN 'RELEASE' || CASE WHEN id % 2 = 0 THEN ':busy' ELSE '' END END AS reason FROM tasks", MADE)
def released_tasks(p):
    return runs.released(made_tasks(p), made_tasks(p).select("id", F.lit(1).alias("seq"), F.when(F.col("id") % 2 == 0, " busy ").otherwise(" ").alias("reason")))


@query("", "SELECT id, attachment_id, 'FAILED' AS status, 'FAILED' AS attachment_status FROM tasks WHERE status IN ('QUEUED', 'RUNNING')", MADE)
def interrupted_tasks(p):
    return runs.interrupted(made_tasks(p))


@query("", """SELECT doc_id, CASE WHEN t IS NULL THEN 'new' WHEN doc_id % 2 = 0 THEN 'reused' ELSE 'refused' END AS outcome, t AS task_id FROM documents LEFT JOIN (SELECT attachment_id, max(id) AS t FROM tasks WHERE status IN ('QUEUED', 'RUNNING') GROUP BY 1) ON attachment_id = doc_id""", MADE)
def submissions(p):
    k = F.col("doc_id")
    return runs.submissions(p.table("documents").select(k.alias("attachment_id"), k, (k % 2 == 0).alias("automatic")), made_tasks(p)).select("doc_id", "outcome", "task_id")


ARTIFACTS = f"{T.EVENTS}, art AS (SELECT run, seq % 3 AS stage, 'T' || (seq % 2)::VARCHAR AS type, seq AS revision FROM ev)"


def artifacts(p) -> DataFrame:
    k = F.col("seq")
    return T.events(p.table).select("run", (k % 3).alias("stage"), F.concat(F.lit("T"), (k % 2).cast("string")).alias("type"), k.alias("revision"))


@query("", """SELECT run, coalesce((SELECT string_agg(type || '@' || revision::VARCHAR, ' ' ORDER BY stage, revision DESC) FROM art WHERE art.run = r.run), '') AS artifacts,
    coalesce((SELECT string_agg(state, ' ' ORDER BY seq) FROM ev WHERE ev.run = r.run), '') AS events FROM (SELECT DISTINCT run FROM ev UNION SELECT -1) r""", ARTIFACTS)
def run_events(p):
    """Every user's run, and one without anything."""
    events = T.events(p.table)
    every = events.select("run").distinct().union(p.spark.range(1).select(F.lit(-1).cast("long")))
    rows = runs.run_events(every, artifacts(p), events.select("run", F.col("seq").alias("id"), "state"))
    return rows.select("run", *[F.array_join(c, " ").alias(c) for c in ("artifacts", "events")])


@query("", "SELECT run, stage, type, revision, row_number() OVER (PARTITION BY run, type ORDER BY revision DESC) AS place FROM art", ARTIFACTS)
def artifact_versions(p):
    return runs.artifact_versions(artifacts(p))


@query("", "SELECT event_type AS model, count(*) AS requests, count(*) FILTER (ok IS NULL OR NOT ok) AS errors, round(count(*) FILTER (ok IS NULL OR NOT ok) / count(*), 4) AS error_rate, round(count(*) / 3600.0::DOUBLE, 4) AS qps, coalesce(quantile_disc(value, 0.5), 0) AS p50, coalesce(quantile_disc(value, 0.95), 0) AS p95, coalesce(quantile_disc(value, 0.99), 0) AS p99 FROM (SELECT event_type, value, CASE WHEN event_id % 10 > 0 THEN event_id % 7 > 0 END AS ok FROM events) GROUP BY 1")
def model_snapshot(p):
    k = F.col("event_id")
    return runs.model_snapshot(p.table("events").select(F.col("event_type").alias("model"), F.when(k % 10 > 0, k % 7 > 0).alias("ok"), F.col("value").alias("ms")), 3600)


@query("", "SELECT project, count(*) AS admitted, max(value) AS longest, coalesce(quantile_disc(value, 0.95) FILTER (place <= 200), 0) AS p95 FROM (SELECT user_id % 20 AS project, value, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id DESC) AS place FROM events) GROUP BY 1")
def project_waits(p):
    return runs.project_waits(p.table("events").select((F.col("user_id") % 20).alias("project"), F.col("event_id").alias("seq"), F.col("value").alias("wait")))


@query("", "SELECT event_id AS id, event_type, user FROM (SELECT event_id, event_type, ts, 'user ' || user_id::VARCHAR AS user FROM events) WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21' AND event_type = 'click' AND contains(user, 'r 1')")
def logs_of_days(p):
    rows = p.table("events").select(F.col("event_id").alias("id"), "event_type", F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("user"), F.col("ts").alias("create_time"))
    return runs.logs(rows, "2024-01-05", "2024-01-20", {"event_type": "click"}, {"user": "r 1", "event_type": " "}).drop("create_time")


def numbered(p):
    """Projects and contracts with the contract numbers that the views lack: every third project has one, every other of these
    stands with one or two contracts; other contracts have names of projects."""
    k = F.col("id")
    projects = p.projects.select(k, F.col("name"), F.when(k % 3 == 0, F.concat(F.lit("NO-"), k.cast("string"))).alias("contract_no"), "contract_amount", "contract_id")
    name = F.concat(F.lit("Customer#"), F.lpad((k % 1000).cast("string"), 9, "0"))
    contracts = p.contracts.select(k, name.alias("name"), F.when(k % 2 == 0, F.concat(F.lit("NO-"), (k % 700).cast("string"))).alias("contract_no"))
    return projects, contracts


NUMBERED = """np AS (SELECT id, name, CASE WHEN id % 3 = 0 THEN 'NO-' || id::VARCHAR END AS contract_no, contract_amount, contract_id FROM projects),
    nc AS (SELECT id, 'Customer#' || lpad((id % 1000)::VARCHAR, 9, '0') AS name, CASE WHEN id % 2 = 0 THEN 'NO-' || (id % 700)::VARCHAR END AS contract_no FROM contracts)"""


@query("projects contracts", """SELECT id, coalesce(contract_id, (SELECT min(id) FROM nc WHERE nc.contract_no = np.contract_no), CASE WHEN contract_no IS NULL AND contract_amount IS NOT NULL THEN (SELECT min(id) FROM nc WHERE nc.name = np.name AND nc.contract_no IS NULL) END) AS contract_id FROM np""", NUMBERED)
def filled_contracts(p):
    return runs.filled_contracts(*numbered(p))


@query("projects contracts", "SELECT id FROM np WHERE (contract_no IS NOT NULL OR contract_amount IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM nc WHERE nc.contract_no = np.contract_no)", NUMBERED)
def contracts_to_make(p):
    return runs.contracts_to_make(*numbered(p)).select("id")


@query("projects links", "SELECT id AS project_id, contract_id FROM projects WHERE contract_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM links l WHERE l.project_id = projects.id AND l.contract_id = projects.contract_id AND l.contract_id % 3 > 0)")
def unlinked_contracts(p):
    """Every third link is missing from the bridge."""
    return runs.unlinked(p.projects, p.links.where("contract_id % 3 > 0"))


@query(
    "projects phases contracts links payments attachments",
    """SELECT id, (SELECT count(*) FROM attachments a JOIN phases x ON x.id = a.biz_id WHERE biz_type = 'PROJECT_PHASE' AND x.project_id = p.id) AS attachments, (SELECT count(*) FROM projects c WHERE c.parent_id = p.id) AS children,
        (SELECT count(*) FROM links l JOIN contracts c ON c.id = l.contract_id WHERE l.project_id = p.id) AS contracts, (SELECT sum(contract_amount) FROM links l JOIN contracts c ON c.id = l.contract_id WHERE l.project_id = p.id)::DECIMAL(18,2) AS contract_total,
        (SELECT count(*) FROM payments m WHERE m.project_id = p.id) AS payments, (SELECT sum(paid_amount) FROM payments m WHERE m.project_id = p.id)::DECIMAL(18,2) AS paid_total FROM projects p""",
)
def project_probe(p):
    return runs.project_probe(p.projects, p.phases, p.attachments, p.contracts, p.links, p.payments)


ASKED = [9, 4, 14, 9, 3, 5, 999_999_999, 2]


@query("attachments", "SELECT id, position, CASE WHEN a.id2 IS NULL THEN 'missing_record' WHEN id % 5 = 0 OR id % 3 = 0 THEN 'missing_object' ELSE 'ok' END AS state FROM (VALUES (9, 0), (4, 1), (14, 2), (3, 3), (5, 4), (999999999, 5), (2, 6)) q(id, position) LEFT JOIN (SELECT id AS id2 FROM attachments) a ON id2 = id")
def attachment_availability(p):
    """Every fifth record has no key, every third no object."""
    k = F.col("id")
    records = p.attachments.select(k, F.when(k % 5 > 0, F.col("file_name")).alias("object_key"))
    return documents.availability(ASKED, records, records.where(k % 3 > 0).select("object_key"))


STAGE_EDGES = ", ".join(f"('{a}', '{b}')" for a, targets in tasks.STAGE_EDGES.items() for b in targets)
STAGE_STATES = "['PENDING', 'RUNNING', 'DONE', 'PARTIAL', 'SKIPPED', 'FAILED', 'CANCELLED']"


@query("", f"SELECT before, after, before = after OR (before, after) IN ({STAGE_EDGES}) AS legal, count(*) AS n FROM (SELECT coalesce(lag(state) OVER (PARTITION BY run ORDER BY seq), '') AS before, state AS after FROM (SELECT user_id AS run, event_id AS seq, {STAGE_STATES}[(event_id * 31 + user_id) % 7 + 1] AS state FROM events)) GROUP BY ALL")
def stage_transitions(p):
    k = F.col("event_id")
    state = pick((k * 31 + F.col("user_id")) % 7, ("PENDING", "RUNNING", "DONE", "PARTIAL", "SKIPPED", "FAILED", "CANCELLED"))
    rows = p.table("events").select(F.col("user_id").alias("run"), k.alias("seq"), state.alias("state"))
    return tasks.transitions(rows, tasks.STAGE_EDGES).groupBy("before", "after", "legal").agg(F.count(F.lit(1)).alias("n"))


@query(
    "",
    """SELECT id, CASE WHEN status = 'DONE' THEN 100.0 ELSE round(lo + (hi - lo) * CASE WHEN total > 0 THEN least(1.0::DOUBLE, done::DOUBLE / total) ELSE 0 END, 1) END::DOUBLE AS percent, CASE WHEN done > 0 AND done < total THEN round(3.0::DOUBLE * total / done * (total - done), 1) ELSE 0 END::DOUBLE AS remaining
    FROM (SELECT *, CASE stage WHEN 0 THEN 5 WHEN 1 THEN 20 WHEN 2 THEN 95 WHEN 3 THEN 96 WHEN 4 THEN 99 ELSE 0 END::DOUBLE AS lo, CASE stage WHEN 0 THEN 20 WHEN 1 THEN 95 WHEN 2 THEN 96 WHEN 3 THEN 99 WHEN 4 THEN 100 ELSE 5 END::DOUBLE AS hi
        FROM (SELECT seq AS id, state AS status, seq % 6 AS stage, seq % 4 AS done, (seq % 3) * 2 AS total FROM ev))""",
    T.EVENTS,
)
def task_progress(p):
    """Quarters and halves of spans, so that no rounding is on a tie that the two engines break in different ways."""
    k = F.col("seq")
    done, total = k % 4, k % 3 * 2
    stage = pick(k % 6, (*tasks.STAGE_SPANS, "receive"))
    return T.events(p.table).select(k.alias("id"), tasks.task_percent(F.col("state"), stage, done, total).alias("percent"), tasks.remaining_seconds(total * 3.0, done, total).alias("remaining"))


@query("", "SELECT 'k' || vec_id::VARCHAR AS chunk_key FROM embeddings WHERE vec_id % 3 = 0 ORDER BY 1 LIMIT 20")
def stale_vectors(p):
    key = F.concat(F.lit("k"), F.col("vec_id").cast("string")).alias("chunk_key")
    rows = p.table("embeddings")
    vectors = rows.select(key, F.lit("m").alias("model"), F.lit(2).alias("clean_rev"), F.when(F.col("vec_id") % 3 > 0, 5).otherwise(4).alias("chunk_rev"))
    return tasks.stale_sample(rows.select(key), vectors, "m", 2, 5)


CHANGED = "changed AS (SELECT doc_id, 2 - doc_id % 3 AS version, 'new' AS value FROM documents WHERE doc_id % 2 = 0)"


@query("", "SELECT doc_id, CASE WHEN c.version >= 1 THEN c.version ELSE 1 END AS version, CASE WHEN c.version >= 1 THEN 'new' ELSE 'old' END AS value FROM documents LEFT JOIN changed c USING (doc_id)", CHANGED)
def upserted_documents(p):
    """Changes of greater, equal and smaller versions."""
    k = F.col("doc_id")
    table = p.table("documents").select(k, F.lit(1).cast("long").alias("version"), F.lit("old").alias("value"))
    changes = p.table("documents").where("doc_id % 2 = 0").select(k, (2 - k % 3).alias("version"), F.lit("new").alias("value"))
    return store.upserted(table, changes, "doc_id", "version")


@query("", "SELECT doc_id, length(text) AS n FROM documents WHERE doc_id NOT IN (SELECT user_id FROM events)")
def remaining_documents(p):
    rows = p.table("documents").select("doc_id", F.char_length("text").cast("long").alias("n"))
    return store.without(rows, p.table("events").select(F.col("user_id").alias("doc_id")), "doc_id")


KEPT = "kept AS (SELECT doc_id, CASE WHEN c.version >= 1 THEN c.version ELSE 1 END AS version, CASE WHEN c.version >= 1 THEN 'new' ELSE 'old' END AS value FROM documents LEFT JOIN changed c USING (doc_id))"


def changed_store(p):
    """A keyed store after an upsert and a deletion."""
    k = F.col("doc_id")
    table = p.table("documents").select(k, F.lit(1).cast("long").alias("version"), F.lit("old").alias("value"))
    kept = keyed.KeyedStore.create(table, new_path(p.spark, "keyed"), "doc_id", "version")
    kept.upsert(p.table("documents").where("doc_id % 2 = 0").select(k, (2 - k % 3).alias("version"), F.lit("new").alias("value")))
    kept.delete(p.table("documents").where("doc_id % 5 = 0").select(k))
    return kept


@query("", "SELECT * FROM kept WHERE doc_id % 5 > 0", f"{CHANGED}, {KEPT}")
def keyed_documents(p):
    return changed_store(p).read()


@query("", "SELECT * FROM kept WHERE doc_id % 5 > 0 AND doc_id % 7 = 0", f"{CHANGED}, {KEPT}")
def keyed_lookup(p):
    """Rows by key, from the buckets of the keys."""
    return changed_store(p).get(p.table("documents").where("doc_id % 7 = 0").select("doc_id"))


@query("", "SELECT doc_id, 2 AS round, n_chars FROM documents WHERE doc_id % 3 > 0")
def replaced_documents(p):
    """A document store read back after two writes: the second is what it holds."""
    path = new_path(p.spark, "versions")
    rows = p.table("documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.array(F.struct(F.lit(1).alias("page_no"), F.col("n_chars").cast("int").alias("chars"))).alias("pages"))
    store.write_documents(rows, path)
    store.write_documents(rows.where("doc_id % 3 > 0").withColumn("filename", F.lit("2")), path)
    found = store.read_json_documents(p.spark, path, lines=True)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("filename").cast("int").alias("round"), F.col("pages")[0]["chars"].cast("long").alias("n_chars"))


#: Every event as a call that lasts as many minutes as its value says; each seventh goes on.
CALLS = "calls AS (SELECT event_type AS model, floor(epoch(ts))::BIGINT AS begin, CASE WHEN event_id % 7 > 0 THEN floor(epoch(ts))::BIGINT + floor(abs(value) * 60)::BIGINT END AS stop FROM events)"
SWEPT = """steps AS (SELECT model, t, sum(d) AS d FROM (SELECT model, begin AS t, 1 AS d FROM calls WHERE stop IS NULL OR stop > begin UNION ALL SELECT model, stop, -1 FROM calls WHERE stop > begin) GROUP BY 1, 2),
    level AS (SELECT model, t, sum(d) OVER (PARTITION BY model ORDER BY t) AS n FROM steps), middle AS (SELECT (min(begin) + max(begin)) // 2 AS now FROM calls)"""


def began(p):
    return p.table("events").withColumn("begin", F.unix_timestamp(F.col("ts").cast("timestamp")))


@query("", "SELECT model, max(n)::BIGINT AS peak, min(t) FILTER (n = top)::BIGINT AS peak_at, coalesce(arg_max(n, t) FILTER (t <= (SELECT now FROM middle)), 0)::BIGINT AS current FROM (SELECT *, max(n) OVER (PARTITION BY model) AS top FROM level) GROUP BY 1", f"{CALLS}, {SWEPT}")
def requests_in_flight(p):
    rows = began(p)
    now = rows.agg(F.floor((F.min("begin") + F.max("begin")) / 2)).first()[0]
    calls = rows.select(F.col("event_type").alias("model"), "begin", F.when(F.col("event_id") % 7 > 0, F.col("begin") + F.floor(F.abs("value") * 60)).alias("end"))
    return concurrency.gauges(calls, "model", float(now or 0)).withColumn("peak_at", F.col("peak_at").cast("long"))


GATED = """req AS (SELECT event_id % 20 AS project, floor(epoch(ts))::BIGINT AS queued, floor(epoch(ts))::BIGINT + event_id % 90 AS admitted, floor(epoch(ts))::BIGINT + event_id % 90 + floor(abs(value) * 60)::BIGINT AS finished, CASE WHEN event_id % 11 = 0 THEN 'full' WHEN event_id % 13 = 0 THEN 'timeout' END AS rejected FROM events),
    open AS (SELECT 'q' AS what, project, queued AS b, CASE WHEN rejected IS NULL THEN admitted ELSE finished END AS e FROM req UNION ALL SELECT 'f', project, admitted, finished FROM req WHERE rejected IS NULL),
    level AS (SELECT what, project, t, sum(sum(d)) OVER (PARTITION BY what, project ORDER BY t) AS n FROM (SELECT what, project, b AS t, 1 AS d FROM open WHERE e IS NULL OR e > b UNION ALL SELECT what, project, e, -1 FROM open WHERE e > b) GROUP BY 1, 2, 3),
    gauge AS (SELECT project, max(n) FILTER (what = 'q') AS mq, max(n) FILTER (what = 'f') AS mf, arg_max(n, t) FILTER (what = 'q' AND t <= m) AS q, arg_max(n, t) FILTER (what = 'f' AND t <= m) AS f FROM level, (SELECT (min(queued) + max(queued)) // 2 AS m FROM req) GROUP BY 1),
    refused AS (SELECT project, string_agg(rejected || '=' || n, ',' ORDER BY rejected) AS rejections FROM (SELECT project, rejected, count(*) AS n FROM req WHERE rejected IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""


@query("", "SELECT project, coalesce(q, 0)::BIGINT AS depth, coalesce(mq, 0)::BIGINT AS most_depth, coalesce(f, 0)::BIGINT AS in_flight, coalesce(mf, 0)::BIGINT AS most_in_flight, coalesce(rejections, '') AS rejections FROM (SELECT DISTINCT project FROM req) LEFT JOIN gauge USING (project) LEFT JOIN refused USING (project)", GATED)
def gate_gauges(p):
    rows, k = began(p), F.col("event_id")
    now = rows.agg(F.floor((F.min("begin") + F.max("begin")) / 2)).first()[0]
    admitted = F.col("begin") + k % 90
    requests = rows.select((k % 20).alias("project"), F.col("begin").alias("queued"), admitted.alias("admitted"), (admitted + F.floor(F.abs("value") * 60)).alias("finished"), F.when(k % 11 == 0, "full").when(k % 13 == 0, "timeout").alias("rejected"))
    return concurrency.gate(requests, "project", float(now or 0))


@query("", "SELECT type, max(revision) + 1 AS revision FROM art GROUP BY 1", ARTIFACTS)
def next_revisions(p):
    return store.next_revision(artifacts(p), "type")


@query("", "SELECT doc_id, page_no, chunk_key FROM chunks WHERE page_no % 3 = 0", details.CHUNKS)
def chunks_to_embed(p):
    rows = details.chunks(p)
    return store.missing_vectors(rows, rows.where("page_no % 3 > 0"))


@query("", "SELECT vec_id, 'r' || (vec_id % 2)::VARCHAR AS embed_rev FROM embeddings WHERE vec_id % 2 = 1 AND vec_id % 3 > 0")
def stored_vectors(p):
    """Written in partitions by revision and read back: one revision, some keys."""
    k = F.col("vec_id")
    key = F.concat(F.lit("k"), k.cast("string")).alias("chunk_key")
    path = new_path(p.spark, "vectors")
    rows = p.table("embeddings").select(key, k, F.col("embedding").alias("vector"), F.concat(F.lit("r"), (k % 2).cast("string")).alias("embed_rev"), F.lit("c1").alias("clean_rev"), F.lit("h1").alias("chunk_rev"))
    store.write_vectors(rows, path)
    return store.read_vectors(p.spark, path, rows.where(k % 3 > 0), embed_rev="r1").select("vec_id", "embed_rev")


@query("", "SELECT doc_id, page_no, text FROM doc_pages", texts.PAGES)
def stored_pages(p):
    """Documents written as JSON and their pages read back."""
    path = new_path(p.spark, "documents")
    page = F.struct(F.col("page_no").cast("int").alias("page_no"), "text")
    rows = details.chunking.pages_of(p.table("documents")).groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    store.write_documents(rows.select(F.col("doc_id").cast("string").alias("doc_id"), "pages"), path)
    return store.document_pages(store.read_json_documents(p.spark, path, lines=True)).select(F.col("doc_id").cast("long").alias("doc_id"), "page_no", "text")


@query("", "SELECT event_id, before, after FROM (SELECT event_id, 'QUEUED' AS before, event_type AS after FROM events UNION ALL SELECT event_id, 'QUEUED', event_type FROM events WHERE event_type = 'click')")
def appended_audit(p):
    """Two appends to a log of changes."""
    path = new_path(p.spark, "audit")
    rows = p.table("events").select("event_id", F.lit("QUEUED").alias("before"), F.col("event_type").alias("after"))
    store.append_log(rows, path)
    store.append_log(rows.where("after = 'click'"), path)
    return p.spark.read.schema(rows.schema).parquet(path)


@query("", "SELECT doc_id, sha1(sha1(coalesce(text, '')) || '|c1.h2') AS task_key FROM documents")
def task_keys(p):
    return p.table("documents").select("doc_id", X.task_key(F.sha1(F.coalesce("text", F.lit("")).cast("binary")), "c1.h2").alias("task_key"))


@query("", "SELECT date_trunc('hour', ts) AS window_start, state, count(*) AS n FROM ev GROUP BY 1, 2 HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ev) - INTERVAL 1 HOUR", T.EVENTS)
def streamed_counts(p):
    """The events as a stream, counted in windows that the watermark has passed, up to its end."""
    return streamed(p, lambda events: streaming.state_counts(events), "counts").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("", ORACLE["renewed_leases"].removeprefix(f"WITH {MADE} "), MADE)
def streamed_leases(p):
    """The tasks and heartbeats of ``renewed_leases`` as one stream, a task's state before its heartbeat."""
    leases.use_timers(p.spark)
    k, now = F.col("id"), T.middle(p.table).first()[0]

    def judged(events):
        made = made_tasks_of(events).withColumn("ts", F.col("ts"))
        caller = F.when(k % 2 == 0, F.concat(F.lit("w"), (k % 6).cast("string"))).otherwise("")
        empty = lambda kind: F.lit(None).cast(kind)
        task = F.struct(F.lit(0).cast("long").alias("seq"), F.lit(leases.TASK).alias("kind"), "status", "claimed_by", "lease_until", empty("long").alias("seconds"))
        beat = F.struct(F.lit(1).cast("long").alias("seq"), F.lit(leases.HEARTBEAT).alias("kind"), empty("string").alias("status"), caller.alias("claimed_by"), empty("long").alias("lease_until"), F.when(k % 9 > 0, k % 9 * 600).alias("seconds"))
        rows = made.select("id", "ts", F.explode(F.array(task, beat)).alias("e")).select("id", "ts", "e.*", F.lit(now).cast("long").alias("at"), empty("string").alias("reason"))
        return leases.judged_leases(rows)

    return streamed(p, judged, "leases").where("kind = 'heartbeat'").select("id", "outcome", "lease_until")


def streamed(p, counted, name: str) -> DataFrame:
    """The result of a stream over the events that are there, written through the file sink."""
    kinds = p.table("events").schema
    rows = p.spark.readStream.schema(kinds).parquet(f"{p.sf_dir}/event[s].parquet")
    events = T.events(lambda _: rows).withColumn("ts", F.col("ts").cast("timestamp"))
    path, progress = new_path(p.spark, name), new_path(p.spark, f"{name}-progress")
    run = counted(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return p.spark.read.parquet(path)
