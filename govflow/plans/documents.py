"""Document and attachment queries, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from govflow.operators import chunking, documents, hierarchy, judging, lists
from govflow.operators.stats import RESULT, money
from govflow.plans import tasks as T
from govflow.plans import texts
from govflow.views import Portfolio, oracle

QUERIES, ORACLE = {}, {}


def query(views: str = "", sql: str = "", more: str = ""):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Portfolio(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = oracle(views, sql, more) if views else f"WITH {more} {sql}" if more else sql
        return f

    return add


OWNED = """owned AS (SELECT a.id AS attachment_id, ai_doc_id, CASE biz_type WHEN 'PROJECT' THEN (SELECT id FROM projects x WHERE x.id = biz_id) WHEN 'PROJECT_PHASE' THEN (SELECT project_id FROM phases x WHERE x.id = biz_id)
    WHEN 'CONTRACT' THEN (SELECT min(project_id) FROM links x WHERE x.contract_id = biz_id) WHEN 'PAYMENT' THEN (SELECT min(project_id) FROM payments x WHERE x.id = biz_id) END AS project_id FROM attachments a),
    task AS (SELECT event_id AS id, event_id % 300 AS attachment_id, event_type AS status FROM events)"""


@query(
    "projects phases links payments attachments",
    "SELECT d.doc_id::VARCHAR AS doc_id, attachment_id, project_id, (SELECT arg_max(status, id) FROM task WHERE task.attachment_id = owned.attachment_id) AS status FROM documents d LEFT JOIN owned ON ai_doc_id = d.doc_id::VARCHAR",
    OWNED,
)
def document_list(p):
    owners = lists.attachment_projects(p.attachments, p.projects, p.phases, p.links, p.payments)
    tasks = p.table("events").select(F.col("event_id").alias("id"), (F.col("event_id") % 300).alias("attachment_id"), F.col("event_type").alias("status"))
    return documents.document_list(p.table("documents").select(F.col("doc_id").cast("string").alias("doc_id")), p.attachments, owners, tasks)


@query("attachments", "SELECT id, file_name FROM attachments WHERE lower(file_name) LIKE '%c_12%' OR ai_doc_id LIKE '%c_12%'")
def document_search(p):
    return p.attachments.withColumn("doc_id", F.col("ai_doc_id")).where(documents.named(" C_12")).select("id", "file_name")


@query("attachments", "SELECT id, id % 2 = 0 AS usable FROM attachments WHERE id IN (1, 2, 3, 4, 5, 6, 8)")
def chat_scope(p):
    """Asked-for attachments: usable ones, and those that are an error."""
    state = F.when(F.col("id") % 2 == 0, "READY").otherwise("PARSING")
    good, bad = documents.eligible(p.attachments.withColumn("ai_index_status", state), [1, 2, 3, 4, 5, 6, 8])
    return good.select("id", F.lit(True).alias("usable")).union(bad.select("id", F.lit(False).alias("usable")))


@query("phases attachments", """SELECT biz_type, biz_id, count(*) AS n, min(a.id) AS first_id, (CASE biz_type WHEN 'PROJECT_PHASE' THEN 0 WHEN 'CONTRACT' THEN 1 WHEN 'PROJECT' THEN 2 ELSE 4 END)::BIGINT AS kind_rank,
    coalesce(max(sort_no), 0)::BIGINT AS sort_no FROM attachments a LEFT JOIN phases ON biz_type = 'PROJECT_PHASE' AND phases.id = biz_id GROUP BY 1, 2""")
def attachment_groups(p):
    return documents.grouped(p.attachments, p.phases)


@query("contracts payments", """SELECT node_code, node_place, status, count(*) AS n, sum(paid_amount)::DECIMAL(18,2) AS paid FROM (SELECT p.*, coalesce(nullif(list_position(['N3', 'N1', 'N2'], node_code), 0), 99)::BIGINT AS node_place FROM payments p LEFT JOIN contracts c ON c.id = contract_id
    WHERE status IN ('PAID', 'PART') AND (lower(c.name) LIKE '%c1%' OR lower(node_code) LIKE '%c1%' OR lower(status) LIKE '%c1%')) GROUP BY 1, 2, 3""")
def payment_filter(p):
    rows = documents.filtered_payments(p.payments, p.contracts, ["N3", "N1", "N2"], ["PAID", "PART"], " c1")
    return rows.groupBy("node_code", "node_place", "status").agg(F.count(F.lit(1)).alias("n"), money("paid_amount").cast(RESULT).alias("paid"))


STAGED = f"""{T.EVENTS}, st AS (SELECT run, {T.STAGE_LIST}[seq % 7 + 1] AS stage, arg_max(state, seq) AS status, count(*) FILTER (state = 'FAILED') AS failed, max(floor(epoch(ts))::BIGINT) - min(floor(epoch(ts))::BIGINT) AS elapsed_s FROM ev GROUP BY 1, 2),
    art AS (SELECT run, 'T' || (seq % 3)::VARCHAR AS type, row_number() OVER (PARTITION BY run, seq % 3 ORDER BY seq) AS revision FROM ev)"""


@query(
    "",
    f"""SELECT r.run, coalesce((SELECT string_agg(stage || ':' || status, ' ' ORDER BY list_position({T.STAGE_LIST}, stage)) FROM st WHERE st.run = r.run), '') AS stages,
        coalesce((SELECT string_agg(x, ' ' ORDER BY x) FROM (SELECT type || '@' || max(revision)::VARCHAR AS x FROM art WHERE art.run = r.run GROUP BY type)), '') AS artifacts,
        coalesce((SELECT sum(failed) FROM st WHERE st.run = r.run), 0)::BIGINT AS failed, coalesce((SELECT sum(elapsed_s) FROM st WHERE st.run = r.run), 0)::BIGINT AS elapsed_s
    FROM (SELECT DISTINCT run FROM ev UNION SELECT -1) r""",
    STAGED,
)
def run_detail(p):
    rows = T.events(p.table)
    stage = F.element_at(F.array(*map(F.lit, documents.STAGES)), (F.col("seq") % 7 + 1).cast("int"))
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    stages = rows.withColumn("stage", stage).groupBy("run", "stage").agg(F.max_by("state", "seq").alias("status"), F.count_if(F.col("state") == "FAILED").alias("failed"), (F.max(second) - F.min(second)).alias("elapsed_s"))
    kind = F.concat(F.lit("T"), (F.col("seq") % 3).cast("string"))
    artifacts = rows.withColumn("type", kind).groupBy("run", "type").agg(F.count(F.lit(1)).alias("revision"))
    runs = rows.select("run").distinct().union(p.spark.range(1).select(F.lit(-1).cast("long")))
    return documents.run_detail(runs, stages, artifacts)


@query(
    "",
    """SELECT round(sum(l % 3) / sum(l % 7 + 3), 4) AS empty_ratio, round(sum(l % 11) / sum(l), 4) AS removed_ratio, round(sum(l) / sum(l // 500 + 1), 4) AS chunk_chars, NULL::DOUBLE AS embed_rate
    FROM (SELECT length(text) + 2 AS l FROM documents)""",
)
def quality_board(p):
    """Artifacts made of text lengths; the first of two revisions must not count."""
    n = F.char_length("text")
    content = lambda n: F.to_json(F.struct((n % 7 + 3).alias("pages"), (n % 3).alias("empty_pages"), n.alias("chars"), (n % 11).alias("removed_chars"), n.alias("chunk_chars"), (F.floor(n / 500) + 1).alias("chunks")))
    revisions = F.explode(F.array(F.lit(1), F.lit(2))).alias("revision")
    rows = p.table("documents").select(F.col("doc_id").alias("run"), F.lit("CLEAN").alias("type"), n.alias("n"), revisions)
    return documents.quality_board(rows.select("run", "type", "revision", content(F.col("n") + F.col("revision")).alias("content")))


@query("", "SELECT id, CASE WHEN id % 5 = 0 THEN 'LOST' WHEN id % 3 = 0 THEN 'DONE' ELSE 'RUNNING' END AS status FROM (SELECT event_id AS id FROM events WHERE event_type = 'click')")
def reconciled_tasks(p):
    k = F.col("id")
    pending = p.table("events").where("event_type = 'click'").select(F.col("event_id").alias("id"), F.lit("RUNNING").alias("status"))
    remote = p.table("events").select(F.col("event_id").alias("id")).where(k % 5 != 0).select("id", F.when(k % 3 == 0, "DONE").otherwise("QUEUED").alias("status"))
    return documents.reconciled(pending, remote)


@query("", "SELECT doc_id, (CASE WHEN doc_id % 4 > 0 THEN (doc_id % 4) * greatest(1, ceil(ceil(length(text) / (doc_id % 4)) / 500)) ELSE ceil(greatest(length(text), 0) / 500) END)::BIGINT AS chunks FROM documents")
def estimated_chunks(p):
    return p.table("documents").select("doc_id", documents.estimated_chunks(F.col("doc_id") % 4, F.char_length("text")).alias("chunks"))


@query("all_projects", "SELECT 'P-1995-' || lpad((SELECT count(*) + 1 FROM all_projects WHERE code LIKE 'P-1995-%')::VARCHAR, 3, '0') AS code")
def next_code(p):
    """Codes of the view aren't padded, so the first try is free."""
    return documents.next_codes(p.all_projects.withColumn("code", F.regexp_replace("code", r"-(\d+)$", "-x$1")), "P", 1995)


@query(
    "",
    r"""SELECT kind, count(*) AS n, round(count(*) FILTER (regexp_matches(plain, '(^|[^0-9.])' || replace(expected, '.', '\.') || '($|[^0-9.]|\.($|[^0-9]))')) / count(*), 4) AS number_rate, round(count(*) FILTER (cited > 0) / count(*), 4) AS cited_rate
    FROM (SELECT role AS kind, turn % 3 AS cited, (conv_id + 1000)::VARCHAR || '.5' AS expected, regexp_replace(concat_ws('; ', text, CASE WHEN turn % 2 = 0 THEN (conv_id + 1000)::VARCHAR || '.5' END), '[,，\s]', '', 'g') AS plain FROM conversations) GROUP BY 1""",
)
def answer_rates(p):
    """Over whole turns, with a number in every second one behind its text."""
    number = F.concat((F.col("conv_id") + 1000).cast("string"), F.lit(".5"))
    answer = F.concat_ws("; ", "text", F.when(F.col("turn") % 2 == 0, number))
    return documents.answer_rates(p.table("conversations").select(F.col("role").alias("kind"), number.alias("expected"), answer.alias("answer"), (F.col("turn") % 3).alias("cited")))


PLAIN = r"regexp_replace(regexp_replace(regexp_replace({0}, '[\s\x{{a0}}\x{{2000}}-\x{{200b}}\x{{3000}}]', '', 'g'), '[，,]([0-9]{{3}})($|[^0-9])', '\1\2', 'g'), '([0-9])[元个条份项次户人页天%％]', '\1', 'g')"
GROUPS = rf"""said AS (SELECT conv_id, turn, {PLAIN.format("text")} AS hay FROM conversations),
    groups AS (SELECT item_id AS group_id, list_distinct(string_split(lower(text), ' ')[1:2]) AS tokens FROM benchmark),
    token AS (SELECT group_id, len(tokens) AS n, unnest(tokens) AS token FROM groups),
    hits AS (SELECT conv_id, turn, group_id FROM said JOIN token ON CASE WHEN regexp_full_match(token, '[0-9]+') THEN regexp_matches(hay, '(^|[^A-Za-z0-9])' || token || '($|[^0-9,]|,($|[^0-9]))') ELSE contains(hay, regexp_replace(token, '\s', '', 'g')) END GROUP BY conv_id, turn, group_id, n HAVING count(*) = n)"""


@query("", "SELECT conv_id, turn, count(group_id) AS groups, coalesce(min(group_id), -1) AS least FROM said LEFT JOIN hits USING (conv_id, turn) GROUP BY 1, 2", GROUPS)
def token_groups(p):
    """The first words of each item as a group, looked up in every turn."""
    words = F.array_distinct(F.slice(F.split(F.lower("text"), " "), 1, 2))
    groups = p.table("benchmark").select(F.col("item_id").alias("group_id"), words.alias("tokens"))
    found = judging.complete_groups(p.table("conversations").select("conv_id", "turn", F.col("text").alias("answer")), groups)
    return found.select("conv_id", "turn", F.size("complete").cast("long").alias("groups"), F.coalesce(F.get("complete", F.lit(0)), F.lit(-1).cast("long")).alias("least"))


@query(
    "",
    """SELECT category, count(*) AS cases, count(*) FILTER (NOT bad AND NOT open) AS passed, count(*) FILTER (bad) AS failed, count(*) FILTER (NOT bad AND open) AS skipped,
        round(count(*) FILTER (tool) / count(tool), 4) AS tool_rate, round(count(*) FILTER (refused) / nullif(count(refused), 0), 4) AS refusal_rate, round(count(*) FILTER (turn % 4 > 0) / count(*), 4) AS citation_rate, round(count(*) FILTER (agree) / count(agree), 4) AS agree_rate
    FROM (SELECT *, NOT tool OR NOT truth OR NOT pages OR NOT coalesce(refused, true) AS bad FROM (
        SELECT turn, CASE conv_id % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'negative' ELSE 'list' END AS category, conv_id % 5 > 0 AS tool, conv_id % 4 > 0 AS truth, turn % 4 > 0 OR conv_id % 7 = 0 AS pages, conv_id % 7 = 0 AS open, CASE WHEN conv_id % 3 = 1 THEN turn % 3 = 0 END AS refused, conv_id % 2 = 0 AS agree FROM conversations))
    GROUP BY 1""",
)
def judged_answers(p):
    """Every turn as an answer behind which its number, and for some a refusal, was put."""
    k, turn = F.col("conv_id"), F.col("turn")
    number = F.format_string("%d", k + 7_000_000)
    shown = F.when(k % 4 > 0, F.concat(F.lit("; 7,"), F.substring(F.lpad((k % 1_000_000).cast("string"), 6, "0"), 1, 3), F.lit(","), F.substring(F.lpad((k % 1_000_000).cast("string"), 6, "0"), 4, 3), F.lit(" 元")))
    answer = F.concat_ws("", "text", shown, F.when(turn % 3 == 0, "; 未找到"))
    none = F.array().cast("array<string>")
    rows = p.table("conversations").select(
        F.struct(k, turn).alias("case_id"), turn, F.when(k % 3 == 0, "fact").when(k % 3 == 1, "negative").otherwise("list").alias("category"), answer.alias("answer"),
        F.when(k % 5 > 0, F.array(F.lit("search"))).otherwise(none).alias("tools"), F.lit("search").alias("tool"), none.alias("must"), F.array().cast("array<array<string>>").alias("anyof"), F.array(number).alias("truth"), none.alias("forbidden"),
        F.when(k % 7 > 0, F.array(F.lit(1))).alias("pages"), F.when(turn % 4 > 0, F.array(F.lit(1))).alias("cited"), F.lit(True).alias("refusal"), F.when(k % 2 == 0, F.array(number)).otherwise(F.array(F.lit("0"))).alias("cross"), F.lit(False).alias("asks_truth"),
    )
    return judging.judging_table(judging.judged(rows))


@query("", "SELECT doc_id, count(*) AS pages FROM (SELECT doc_id, page_no, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page_no) AS s FROM doc_pages) WHERE s <= 1500 OR page_no = 1 GROUP BY 1", texts.PAGES)
def page_budget(p):
    return documents.within_budget(chunking.pages_of(p.table("documents")), 1500).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))


@query("", "SELECT doc_id, page_no, CASE WHEN length(text) > 300 THEN left(text, 300) || '…' ELSE text END AS text FROM doc_pages WHERE doc_id = 11 AND page_no = 1", texts.PAGES)
def read_page(p):
    return documents.read_page(chunking.pages_of(p.table("documents")), "11", 1, 300)


@query(
    "",
    "SELECT id FROM walk WHERE id = anc",
    "RECURSIVE edge AS (SELECT c_custkey AS id, (c_custkey * c_custkey + 3) % (SELECT max(c_custkey) + 1 FROM customer) AS parent_id FROM customer), walk AS (SELECT id, parent_id AS anc FROM edge UNION SELECT w.id, e.parent_id FROM walk w JOIN edge e ON e.id = w.anc)",
)
def cyclic_projects(p):
    """Projects that reach themselves, in a made-up hierarchy of all customers with cycles."""
    k = F.col("c_custkey")
    rows = p.table("customer")
    n = rows.agg((F.max(k) + 1).alias("n"))
    return hierarchy.on_cycle(rows.join(F.broadcast(n), how="cross").select(k.alias("id"), ((k * k + 3) % F.col("n")).alias("parent_id")))
