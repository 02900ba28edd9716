"""Queries over names, attachments, counters, templates and checks, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from govflow.functions import checks
from govflow.functions import text as X
from govflow.operators import chunking, details, documents, hits, lists, retrieval
from govflow.operators.durable import new_path
from govflow.operators.query import intersect
from govflow.plans import texts
from govflow.sources import documents as store
from govflow.views import Portfolio, oracle

QUERIES, ORACLE = {}, {}


def query(views: str, sql: str, more: str = ""):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Portfolio(spark, sf_dir))
        ORACLE[f.__name__] = oracle(views, sql, more) if views else f"WITH {more} {sql}" if more else sql
        return f

    return add


@query("projects", "SELECT id AS project_id, s_name AS manager_name FROM projects LEFT JOIN supplier ON s_suppkey = manager_user_id")
def project_managers(p):
    """Suppliers stand for users."""
    return details.with_manager(p.projects, p.table("supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("user_name")))


@query("projects contracts payments", "SELECT p.*, x.name AS project_name, c.name AS contract_name FROM payments p LEFT JOIN projects x ON x.id = p.project_id LEFT JOIN contracts c ON c.id = p.contract_id")
def payment_names(p):
    return details.with_names(p.payments, p.projects, p.contracts)


def chunks(p):
    """Pages stand for chunks, every third of a document is not live."""
    return chunking.pages_of(p.table("documents")).select("doc_id", "page_no", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("page_no").cast("string")).alias("chunk_key"))


CHUNKS = f"{texts.PAGES}, chunks AS (SELECT doc_id, page_no, doc_id::VARCHAR || ':' || page_no::VARCHAR AS chunk_key FROM doc_pages)"


@query("", "SELECT chunk_key, event_id FROM (SELECT event_id, (user_id % 200)::VARCHAR || ':' || (event_id % 4 + 1)::VARCHAR AS chunk_key FROM events) WHERE chunk_key IN (SELECT chunk_key FROM chunks WHERE page_no % 3 > 0)", CHUNKS)
def live_hits(p):
    hits = p.table("events").select("event_id", F.concat_ws(":", (F.col("user_id") % 200).cast("string"), (F.col("event_id") % 4 + 1).cast("string")).alias("chunk_key"))
    return details.live_hits(hits, chunks(p).where("page_no % 3 > 0"))


@query("attachments", """SELECT answer, coalesce(CASE WHEN position % 3 > 0 THEN position * 2 END, position)::BIGINT AS number, doc_id, (SELECT min(id) FROM attachments WHERE ai_doc_id = doc_id) AS attachment_id
    FROM (SELECT conv_id AS answer, turn + 1 AS position, ((conv_id * 7 + turn) % 300)::VARCHAR AS doc_id FROM conversations)""")
def cited_attachments(p):
    place = (F.col("turn") + 1).cast("long")
    rows = p.table("conversations").select(F.col("conv_id").alias("answer"), place.alias("position"), F.when(place % 3 > 0, place * 2).alias("number"), ((F.col("conv_id") * 7 + F.col("turn")) % 300).cast("string").alias("doc_id"))
    return details.cited_attachments(rows, p.attachments)


def uploads(p):
    k = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("PROJECT", "PROJECT_PHASE", "CONTRACT"))), (k % 3 + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, ("QUEUED", "RUNNING", "DONE", "FAILED", "DEAD"))), (k % 5 + 1).cast("int"))
    return p.table("events").select(k.alias("id"), (k % 40).alias("project_id"), kind.alias("biz_type"), (k % 500).alias("biz_id"), F.col("ts").alias("create_time"), F.when(k % 11 > 0, status).alias("status"))


UPLOADS = "uploads AS (SELECT event_id AS id, event_id % 40 AS project_id, ['PROJECT', 'PROJECT_PHASE', 'CONTRACT'][event_id % 3 + 1] AS biz_type, event_id % 500 AS biz_id, ts AS create_time, CASE WHEN event_id % 11 > 0 THEN ['QUEUED', 'RUNNING', 'DONE', 'FAILED', 'DEAD'][event_id % 5 + 1] END AS status FROM events)"


@query("phases contracts", "SELECT u.id, biz_type, biz_id, phase_name, c.name AS contract_name FROM uploads u LEFT JOIN phases x ON biz_type = 'PROJECT_PHASE' AND x.id = biz_id LEFT JOIN contracts c ON biz_type = 'CONTRACT' AND c.id = biz_id", UPLOADS)
def upload_names(p):
    return details.named_tasks(uploads(p), p.phases, p.contracts).select("id", "biz_type", "biz_id", "phase_name", "contract_name")


@query("", "SELECT id, status FROM uploads WHERE project_id = 7 ORDER BY create_time DESC, id DESC LIMIT 30", UPLOADS)
def recent_uploads(p):
    return details.recent_tasks(uploads(p), 7, 0).select("id", "status")


@query("", "SELECT count(*) AS n FROM uploads WHERE status IN ('QUEUED', 'RUNNING')", UPLOADS)
def pending_uploads(p):
    return details.pending(uploads(p))


@query("", "SELECT id FROM uploads WHERE status IN ('QUEUED', 'DEAD')", UPLOADS)
def uploads_of_statuses(p):
    return details.of_statuses(uploads(p), " dead, queued,,DEAD").select("id")


@query("", "SELECT coalesce(status, 'UNKNOWN') AS status, count(*) AS n, CASE WHEN status IN ('FAILED', 'DEAD') THEN count(*) ELSE 0 END AS failed FROM uploads GROUP BY status", UPLOADS)
def stage_totals(p):
    return details.stage_totals(uploads(p))


@query("", "SELECT coalesce(status, 'skip') AS status, count(*) AS n FROM (SELECT CASE turn % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' WHEN 2 THEN 'fail' END AS status FROM conversations) GROUP BY 1")
def check_summary(p):
    k = F.col("turn") % 4
    return details.status_counts(p.table("conversations").select(F.when(k == 0, "pass").when(k == 1, "warn").when(k == 2, "fail").alias("status")), "skip")


@query("", "SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1", CHUNKS)
def index_counts(p):
    return details.chunk_counts(chunks(p))


@query("", "SELECT doc_id, count(*) AS pages, sum(length(text))::BIGINT + count(*) - 1 AS text_chars, count(*) FILTER (NOT regexp_matches(text, '\\S')) AS empty_pages, count(*) FILTER (page_no % 5 = 0) AS failed_pages FROM (SELECT doc_id, page_no, CASE WHEN page_no % 4 > 0 THEN text ELSE ' ' || chr(10) END AS text FROM doc_pages) GROUP BY 1", texts.PAGES)
def parse_counters(p):
    n = F.col("page_no")
    pages = chunking.pages_of(p.table("documents")).select("doc_id", "page_no", F.when(n % 4 > 0, F.col("text")).otherwise(" \n").alias("text"), F.when(n % 5 == 0, "timeout").alias("error"))
    return details.parse_counters(pages)


@query("", """SELECT doc_id, count(*) AS chunks, count(*) FILTER (page_no % 5 > 0 AND page_no % 2 > 0) AS embedded, count(*) FILTER (page_no % 5 > 0 AND page_no % 2 = 0) AS reused, count(*) FILTER (page_no % 5 = 0) AS skipped_existing,
    ceil(count(*) FILTER (page_no % 5 > 0 AND page_no % 2 > 0) / 32)::BIGINT AS batches FROM chunks GROUP BY 1""", CHUNKS)
def embed_counters(p):
    rows = chunks(p)
    return details.embed_counters(rows.select("doc_id", "chunk_key"), rows.where("page_no % 2 = 0"), rows.where("page_no % 5 = 0"))


@query("payments attachments", """SELECT id AS payment_id, string_agg(t, ',' ORDER BY t) AS missing FROM (SELECT DISTINCT id FROM payments WHERE status <> 'UNPAID') d, (VALUES ('PLAN'), ('VOUCHER')) r(t)
    WHERE NOT EXISTS (SELECT 1 FROM attachments a WHERE biz_type = 'PAYMENT' AND biz_id = d.id AND attach_type = t) GROUP BY 1""")
def payment_vouchers_missing(p):
    return details.missing_of_payments(p.payments, p.attachments, ("PLAN", "VOUCHER"))


@query("contracts payments", """SELECT p.id FROM payments p LEFT JOIN contracts c ON c.id = contract_id WHERE lower(node_code) LIKE '%n7%' OR lower('handler ' || (p.id % 97)::VARCHAR) LIKE '%n7%' OR lower('INV7N' || (p.id % 89)::VARCHAR || 'N7') LIKE '%n7%' AND p.id % 2 = 0
    OR lower('V' || (p.id % 83)::VARCHAR) LIKE '%n7%' OR lower('payee ' || status) LIKE '%n7%' OR lower('cond ' || plan_amount::VARCHAR) LIKE '%n7%' OR lower(c.name) LIKE '%n7%' OR lower('VN' || (c.id % 80)::VARCHAR) LIKE '%n7%'""")
def payment_search(p):
    """A keyword over eight fields: node, condition, handler, invoice, voucher and payee of a payment, name and vendor of its contract."""
    k = F.col("id")
    text = lambda prefix, of: F.concat(F.lit(prefix), of.cast("string"))
    rows = p.payments.withColumns(
        {"condition": text("cond ", F.col("plan_amount")), "handler": text("handler ", k % 97), "invoice": F.when(k % 2 == 0, F.concat(text("INV7N", k % 89), F.lit("N7"))), "voucher": text("V", k % 83), "payee": text("payee ", F.col("status"))}
    )
    contracts = p.contracts.withColumn("vendor", text("VN", k % 80))
    return details.keyword_payments(rows, contracts, ["node_code", "condition", "handler", "invoice", "voucher", "payee"], ["name", "vendor"], " N7 ").select("id")


@query("", "SELECT coalesce(max(p_size), 0)::BIGINT + 1 AS sort_no FROM part")
def next_sort_no(p):
    return details.next_sort_no(p.table("part").select(F.col("p_size").alias("sort_no")))


@query("", """SELECT project_type, coalesce(arg_min(id, sort_no * 1000000000 + id) FILTER (is_default = 1), min(id)) AS template_id
    FROM (SELECT p_partkey AS id, 'T' || (p_partkey % 9)::VARCHAR AS project_type, CASE WHEN p_partkey % 9 > 2 THEN (p_partkey % 13 = 0)::INT END AS is_default, p_size::BIGINT AS sort_no FROM part WHERE p_partkey % 4 > 0) GROUP BY 1""")
def default_templates(p):
    k = F.col("p_partkey")
    rows = p.table("part").select(k.alias("id"), F.concat(F.lit("T"), (k % 9).cast("string")).alias("project_type"), F.when(k % 9 > 2, (k % 13 == 0).cast("int")).alias("is_default"), (k % 4 > 0).cast("int").alias("enabled"), F.col("p_size").cast("long").alias("sort_no"))
    return details.default_templates(rows)


@query("", "SELECT doc_id, CASE WHEN doc_id % 6 > 0 THEN doc_id * 37 % 1000 END AS uploaded_at FROM documents ORDER BY uploaded_at DESC NULLS LAST, doc_id")
def newest_documents(p):
    k = F.col("doc_id")
    return details.newest_documents(p.table("documents").select("doc_id", F.when(k % 6 > 0, k * 37 % 1000).alias("uploaded_at")))


@query("", "SELECT event_id, 'run-' || event_id::VARCHAR AS run, CASE WHEN event_id % 3 > 0 THEN event_id END AS task FROM events")
def run_ids(p):
    k = F.col("event_id")
    made = F.when(k % 3 > 0, F.concat(F.lit(" "), details.run_id(k))).when(k % 2 > 0, F.concat(details.run_id(k), F.lit("x"))).otherwise(F.concat(F.lit("run--"), k.cast("string")))
    return p.table("events").select("event_id", details.run_id(k).alias("run"), details.task_of(made).alias("task"))


@query("", "SELECT doc_id, json_valid(content) AS is_json, content FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{\"t\":\"' || text || '\"}' ELSE text END AS content FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\"\\\\\\x00-\\x1f]', ' ', 'g') AS text FROM documents))")
def json_or_text(p):
    """Every second text is made a JSON object."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r'["\\\x00-\x1f]', " ")
    content = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"t":"'), text, F.lit('"}'))).otherwise(text)
    return p.table("documents").select("doc_id", details.json_or_text(content).alias("found")).select("doc_id", "found.*")


@query("", """SELECT conv_id, turn, left(CASE WHEN turn % 3 = 0 THEN '{"n":' || turn::VARCHAR || '}' WHEN turn % 3 = 1 THEN '{"_note":"see \\"' || role || '\\"","_content":{"n":' || turn::VARCHAR || '}}' ELSE '{"_note":"' || role || '"}' END, 24) AS content FROM conversations""")
def artifact_contents(p):
    k = F.col("turn") % 3
    content = F.when(k < 2, F.to_json(F.struct(F.col("turn").alias("n"))))
    note = F.when(k == 0, "  ").when(k == 1, F.concat(F.lit(' see "'), "role", F.lit('" '))).otherwise(F.col("role"))
    return p.table("conversations").select("conv_id", "turn", details.artifact_content(content, note, 24).alias("content"))


@query("", "SELECT doc_id, ((doc_id % 9 + 1) * 1000000 + (doc_id % 4 + 1) * 200 + 10 + doc_id % 7 + 1)::DECIMAL(38,2) AS amount FROM documents")
def amounts_in_words(p):
    """Amounts written in words from the digits of ids, in sections, with a unit that has no digit."""
    digit = lambda n: F.element_at(F.array(*map(F.lit, list(checks.DIGITS))), (n + 1).cast("int"))
    k = F.col("doc_id")
    words = F.concat(digit(k % 9 + 1), F.lit("佰万"), digit((k % 4 + 1) * 2), F.lit("佰拾"), digit(k % 7 + 1), F.lit("元整"))
    return p.table("documents").select("doc_id", checks.amounts_in_words(words).alias("amount"))


@query("", "SELECT doc_id, page_no, 1::BIGINT AS n, CASE WHEN doc_id % 2 = 0 THEN 'pass' ELSE 'fail' END AS status FROM doc_pages", texts.PAGES)
def amount_case_check(p):
    """Whole pages, with a sentence behind them that gives an amount in words and in figures."""
    figure = F.when(F.col("doc_id") % 2 == 0, "1,234.50 120.00").otherwise("120.01")
    pages = chunking.pages_of(p.table("documents")).withColumn("text", F.concat_ws("\n", "text", F.concat(F.lit("共壹佰贰拾元即"), figure)))
    return checks.amount_case(pages)


@query("", """SELECT doc_id, list_sort(list(page_no)) AS pages FROM (SELECT DISTINCT doc_id, page_no FROM doc_pages WHERE page_no % 7 = 0 OR NOT regexp_matches(text, '[^ ]') OR (page_no + doc_id) % 5 = 0) GROUP BY 1""", texts.PAGES)
def review_pages(p):
    n, k = F.col("page_no"), F.col("doc_id")
    pages = chunking.pages_of(p.table("documents")).withColumn("error", F.when(n % 7 == 0, "no text"))
    findings = pages.select("doc_id", "page_no", F.when((n + k) % 5 == 0, F.when(k % 2 == 0, "fail").otherwise("warn")).otherwise("pass").alias("status"))
    return checks.review_pages(pages, findings)


@query("", "SELECT event_id, CASE WHEN event_id % 6 > 0 THEN ((1000 + event_id) * 2 - event_id % 5) / (event_id % 6) END AS value, event_id % 6 = 0 AS failed FROM events")
def calculated(p):
    k = F.col("event_id")
    whole = F.concat(F.lit("((1,000 + "), k.cast("string"), F.lit(") * 2e0 + -"), (k % 5).cast("string"), F.lit(") / "), (k % 6).cast("string"))
    result = checks.calculated(whole)
    return p.table("events").select("event_id", result.alias("r")).select("event_id", F.col("r.value").cast("double").alias("value"), F.col("r.error").isNotNull().alias("failed"))


LINE_CHUNKS = f"{texts.LINES}, line AS (SELECT doc_id, page_no, line_no, text, concat_ws(':', doc_id, page_no, line_no) AS chunk_key FROM doc_lines)"


def line_chunks(p):
    """Lines of pages as chunks."""
    lines = chunking.pages_of(p.table("documents")).select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("order_in_page", "text"))
    named = lambda *names: F.concat_ws(":", *[F.col(n).cast("string") for n in names])
    return lines.withColumns({"chunk_key": named("doc_id", "page_no", "order_in_page"), "parent_key": named("doc_id", "page_no")})


@query(
    "",
    """SELECT chunk_key, rank, doc_id, page_no, CASE WHEN length(text) > 40 THEN left(text, 40) || '…' ELSE text END AS snippet, CASE WHEN n > 1 AND clipped <> trim(text, E' \t\r\n') THEN clipped END AS parent_summary
    FROM (SELECT *, line_no::BIGINT AS rank, CASE WHEN length(whole) > 200 THEN left(whole, 200) || '…' ELSE whole END AS clipped FROM line
        JOIN (SELECT doc_id, page_no, count(*) AS n, string_agg(text, chr(10) ORDER BY line_no) AS whole FROM line GROUP BY 1, 2) USING (doc_id, page_no)) WHERE line_no % 4 = 0""",
    LINE_CHUNKS,
)
def shaped_hits(p):
    """Every fourth line as a hit."""
    rows = line_chunks(p)
    found = rows.where("order_in_page % 4 = 0").select("chunk_key", F.col("order_in_page").cast("long").alias("rank"))
    return hits.shaped(found, rows, snippet=40)


@query("", "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN doc_id % 50 END::INT AS hits, CASE WHEN doc_id % 4 = 0 THEN '关键词 ' || doc_id::VARCHAR END AS note FROM documents")
def tool_notes(p):
    k = F.col("doc_id").cast("string")
    told = F.when(F.col("doc_id") % 3 > 0, F.concat(F.when(F.col("doc_id") % 2 == 0, "命中 ").otherwise("找到"), (F.col("doc_id") % 50).cast("string"), F.lit(" 段"))).otherwise("没有数字")
    brief = F.concat(told, F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("（关键词 "), k, F.lit("）"))).otherwise("（x）"), F.lit(" "), F.coalesce("text", F.lit("")))
    return p.table("documents").select("doc_id", documents.tool_counts(brief).alias("hits"), hits.fallback_note(brief).alias("note"))


@query("", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'at ' || event_id::VARCHAR END AS shown FROM events")
def iso_times(p):
    """Times as text, and text that is none."""
    raw = F.when(F.col("event_id") % 3 > 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.concat(F.lit("at "), F.col("event_id").cast("string")))
    return p.table("events").select("event_id", documents.iso_time(raw).alias("shown"))


@query("", "SELECT doc_id, 'd=' || doc_id || ':p=1:h=' || left(sha1(coalesce(text, '')), 12) || ':c=2:k=5' AS chunk_key, doc_id::VARCHAR AS doc, 1 AS page, left(sha1(coalesce(text, '')), 12) AS hash FROM documents")
def revision_keys(p):
    """Keys with revisions, and what they say once parsed."""
    key = X.chunk_key(F.col("doc_id").cast("string"), F.lit(1), F.coalesce("text", F.lit("")), F.lit(2), F.lit(5))
    rows = p.table("documents").select("doc_id", key.alias("chunk_key")).withColumn("parsed", X.parse_chunk_key(F.col("chunk_key")))
    return rows.select("doc_id", "chunk_key", "parsed.doc", F.col("parsed.page").cast("int").alias("page"), "parsed.hash")


@query("", "SELECT sum(strlen(text) + 1)::BIGINT AS bytes FROM (SELECT coalesce(text, '') AS text FROM documents)")
def stored_objects(p):
    """Texts written as files, and the files' sizes as objects."""
    path = new_path(p.spark, "objects")
    p.table("documents").select(F.coalesce("text", F.lit("")).alias("value")).write.text(path)
    return store.read_objects(p.spark, path, "*.txt").agg(F.sum("size").cast("long").alias("bytes"))


@query("", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def truth_snapshot(p):
    """Figures by language, written twice: the second is what the snapshot holds."""
    path, figures = new_path(p.spark, "truth"), p.table("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    store.write_snapshot(figures.withColumn("n", F.col("n") + 1), path)
    store.write_snapshot(figures, path)
    return store.read_snapshot(p.spark, path, "lang string, n long")


@query("", "SELECT vec_id, 'both' AS scope FROM embeddings WHERE label IN (3, 4) UNION ALL SELECT vec_id, 'one' FROM embeddings WHERE label IN (1, 3, 4)")
def scope_intersections(p):
    """Two scopes together, one with no restriction, and two that contradict each other, which admit nothing."""
    rows = p.table("embeddings").select("vec_id", F.col("vec_id").alias("doc_id"), F.lit("x").alias("chunk_key"))
    meta = p.table("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("project_id"))
    one, two, other = frozenset([1, 3, 4]), frozenset([3, 4, 9]), frozenset([9])
    given = {"both": intersect(one, two), "one": intersect(one, None), "none": intersect(one, other)}
    parts = [retrieval.in_scope(rows, meta, {"project_id": scope}).select("vec_id", F.lit(name).alias("scope")) for name, scope in given.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("", "SELECT what, n FROM (VALUES ('no query', 0::BIGINT), ('no scope', 0), ('nothing asked', 0)) v(what, n) WHERE EXISTS (SELECT 1 FROM embeddings)")
def empty_searches(p):
    """Searches without queries, within an empty scope, and for a text without words: no hit, and no error."""
    vectors = p.table("embeddings").select(F.col("vec_id").alias("chunk_key"), F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    asked = vectors.where("chunk_key % 20 = 0").select(F.col("chunk_key").alias("query_id"), "vector")
    closed = retrieval.in_scope(vectors, vectors.select("doc_id", F.col("label").alias("project_id")), {"project_id": set()})
    texts = p.table("documents").select(F.col("doc_id").alias("chunk_key"), "text")
    blank = p.table("benchmark").select(F.col("item_id").alias("query_id"), F.lit(" ").alias("text"))
    found = {"no query": retrieval.vector_top_k(vectors, asked.where(F.lit(False)), 5), "no scope": retrieval.vector_top_k(closed, asked, 5), "nothing asked": retrieval.keyword_scores(texts, blank)}
    parts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n") for what, rows in found.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("links", "SELECT contract_id, string_agg(project_id::VARCHAR, ',' ORDER BY project_id) AS projects FROM (SELECT DISTINCT contract_id, project_id FROM links) GROUP BY 1")
def contract_projects(p):
    """All projects of each contract, in order."""
    return details.projects_of(p.links).select("contract_id", F.array_join("projects", ",").alias("projects"))


@query("projects", "SELECT id, name FROM projects WHERE parent_id = 1000003")
def project_children(p):
    return p.projects.where(lists.under(1_000_003)).select("id", "name")
