"""Names and attachments beside rows that carry only ids, small counters, templates and run ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States of a task, and those that only its stages have.
TASK_STATES = ("QUEUED", "RUNNING", "DONE", "PARTIAL", "FAILED", "CANCELLED", "DEAD")
STAGE_ONLY_STATES = ("PENDING", "SKIPPED")
RUN_PREFIX = "run-"
EMBED_BATCH, MOST_TASKS = 32, 200


def unmatched_apart(rows: DataFrame, key: str) -> Column:
    """0, but for rows of a null key a number by their values: as a second key of a left join it deals out rows that match
    nothing anyway, which a join by the key alone sends to one task."""
    return F.when(rows[key].isNotNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*[rows[c] for c in rows.columns]))


def matched_apart(key: str) -> Column:
    """0, the other side's second key. A plain 0 would be folded into the condition, and be no key of the join."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(1).cast("long"))


def _named(rows: DataFrame, key: str, names: DataFrame, id_col: str, name_col: str, as_col: str) -> DataFrame:
    """``rows`` with the name that belongs to ``key``, null where there is none."""
    known = names.select(F.col(id_col).alias(key), matched_apart(id_col).alias("_apart"), F.col(name_col).alias(as_col))
    return rows.withColumn("_apart", unmatched_apart(rows, key)).join(known, [key, "_apart"], "left").drop("_apart")


def with_manager(projects: DataFrame, users: DataFrame) -> DataFrame:
    """project_id, manager_name (null for an unknown or missing manager). users: user_id, user_name."""
    rows = projects.select(F.col("id").alias("project_id"), "manager_user_id")
    return _named(rows, "manager_user_id", users, "user_id", "user_name", "manager_name").select("project_id", "manager_name")


def with_names(payments: DataFrame, projects: DataFrame, contracts: DataFrame) -> DataFrame:
    """Payments with project_name and contract_name; an id that is null or of no live row has no name."""
    rows = _named(payments, "project_id", projects, "id", "name", "project_name")
    return _named(rows, "contract_id", contracts, "id", "name", "contract_name")


def live_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Index hits whose chunk is still there; others are stale."""
    return hits.join(chunks.select("chunk_key").distinct(), "chunk_key", "left_semi")


def cited_attachments(citations: DataFrame, attachments: DataFrame) -> DataFrame:
    """citations (answer, position from 1, number, doc_id) with number (the position where it is null) and the attachment
    of their document, of the least id; null for a document that is gone."""
    first = attachments.where("ai_doc_id is not null").groupBy(F.col("ai_doc_id").alias("doc_id")).agg(F.min("id").alias("attachment_id"))
    return citations.withColumn("number", F.coalesce("number", "position")).join(first, "doc_id", "left").select("answer", "number", "doc_id", "attachment_id")


def named_tasks(tasks: DataFrame, phases: DataFrame, contracts: DataFrame) -> DataFrame:
    """Upload tasks (id, biz_type, biz_id, ...) with phase_name for those of phases and contract_name for those of contracts."""
    rows = tasks.withColumns({"_phase": F.when(F.col("biz_type") == "PROJECT_PHASE", F.col("biz_id")), "_contract": F.when(F.col("biz_type") == "CONTRACT", F.col("biz_id"))})
    rows = _named(_named(rows, "_phase", phases, "id", "phase_name", "phase_name"), "_contract", contracts, "id", "name", "contract_name")
    return rows.drop("_phase", "_contract")


def recent_tasks(tasks: DataFrame, project_id: int, limit: int | None = None) -> DataFrame:
    """The latest upload tasks of a project: 30 unless another positive limit is given, 200 at most."""
    n = 30 if limit is None or limit <= 0 else min(limit, MOST_TASKS)
    return tasks.where(F.col("project_id") == project_id).orderBy(F.desc("create_time"), F.desc("id")).limit(n)


def pending(tasks: DataFrame) -> DataFrame:
    """One row: how many tasks are queued or running."""
    return tasks.where(F.col("status").isin("QUEUED", "RUNNING")).agg(F.count(F.lit(1)).alias("n"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """doc_id, n: indexed chunks of each document."""
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def status_counts(rows: DataFrame, missing: str) -> DataFrame:
    """status, n; a null status counts as ``missing``."""
    return rows.groupBy(F.coalesce("status", F.lit(missing)).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def stage_totals(stages: DataFrame) -> DataFrame:
    """status, n, failed: stages by status (null: UNKNOWN); failed and dead ones count as failed."""
    return status_counts(stages, "UNKNOWN").withColumn("failed", F.when(F.col("status").isin("FAILED", "DEAD"), F.col("n")).otherwise(F.lit(0)))


def parse_counters(pages: DataFrame) -> DataFrame:
    """doc_id, pages, text_chars (pages joined by a line end), empty_pages, failed_pages of pages (doc_id, page_no, text, error)."""
    text = F.coalesce("text", F.lit(""))
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"),
        (F.sum(F.char_length(text)) + F.count(F.lit(1)) - 1).alias("text_chars"),
        F.count_if(~text.rlike(r"\S")).alias("empty_pages"),
        F.count_if(F.col("error").isNotNull()).alias("failed_pages"),
    )


def embed_counters(chunks: DataFrame, cached: DataFrame, indexed: DataFrame) -> DataFrame:
    """doc_id, chunks, embedded, reused, skipped_existing, batches: chunks that are indexed already are skipped; of the
    others those with a cached vector are reused and the rest embedded, 32 at a time. All by chunk_key."""
    there = lambda rows, name: rows.select("chunk_key", F.lit(True).alias(name)).distinct()
    rows = chunks.join(there(indexed, "_indexed"), "chunk_key", "left").join(there(cached, "_cached"), "chunk_key", "left")
    skipped, held = F.col("_indexed").isNotNull(), F.col("_cached").isNotNull()
    sums = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(~skipped & ~held).alias("embedded"), F.count_if(~skipped & held).alias("reused"), F.count_if(skipped).alias("skipped_existing"))
    return sums.withColumn("batches", F.ceil(F.col("embedded") / EMBED_BATCH).cast("long"))


def missing_of_payments(payments: DataFrame, attachments: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """payment_id, missing: the required attachment types that a payment, once paid in part, has no voucher of. Rows of one id
    are one payment."""
    held = attachments.where("biz_type = 'PAYMENT'").groupBy(F.col("biz_id").alias("id")).agg(F.collect_set("attach_type").alias("held"))
    rows = payments.where("status <> 'UNPAID'").select("id").distinct().join(held, "id", "left")
    lacking = F.array_except(F.lit(list(required)), F.coalesce("held", F.array().cast("array<string>")))
    return rows.select(F.col("id").alias("payment_id"), F.array_join(lacking, ",").alias("missing")).where("missing <> ''")


def keyword_payments(payments: DataFrame, contracts: DataFrame, columns: list[str], contract_columns: list[str], keyword: str) -> DataFrame:
    """Payments that hold a keyword, whatever its case, in one of their columns or of their contract's."""
    word = keyword.strip().lower()
    if not word:
        return payments
    hit = lambda names: F.exists(F.array(*[F.lower(F.col(c).cast("string")) for c in names]), lambda x: F.coalesce(x.contains(word), F.lit(False)))
    found = contracts.where(hit(contract_columns)).select(F.col("id").alias("contract_id"), matched_apart("id").alias("_apart"), F.lit(True).alias("_named"))
    rows = payments.withColumn("_apart", unmatched_apart(payments, "contract_id"))
    return rows.join(found, ["contract_id", "_apart"], "left").where(hit(columns) | F.col("_named").isNotNull()).drop("_named", "_apart")


def next_sort_no(templates: DataFrame) -> DataFrame:
    """One row: the greatest sort_no and one, 1 where there is none."""
    return templates.agg((F.coalesce(F.max("sort_no"), F.lit(0)) + 1).cast("long").alias("sort_no"))


def default_templates(templates: DataFrame) -> DataFrame:
    """project_type, template_id: the enabled default of the least sort_no, else the enabled one of the least id."""
    preferred = F.col("is_default") == 1
    order = F.struct((~F.coalesce(preferred, F.lit(False))).alias("other"), F.when(preferred, F.col("sort_no")).alias("sort_no"), F.col("id"))
    return templates.where("enabled = 1").groupBy("project_type").agg(F.min(order)["id"].alias("template_id"))


def newest_documents(documents: DataFrame) -> DataFrame:
    """Documents with their place in the list: by uploaded_at descending, those without one last, ties by id."""
    return documents.orderBy(F.desc_nulls_last("uploaded_at"), "doc_id")


def run_id(task_id: Column) -> Column:
    """run-<id>; null for a null id."""
    return F.concat(F.lit(RUN_PREFIX), task_id.cast("string"))


def task_of(run: Column) -> Column:
    """The id in run-<digits> (18 at most), white space around it aside; null for any other shape."""
    return F.nullif(F.regexp_extract(F.trim(run), f"^{RUN_PREFIX}([0-9]{{1,18}})$", 1), F.lit("")).cast("long")


def json_or_text(content: Column) -> Column:
    """struct(is_json, content): a text that is no JSON stays a text; null stays null.

    The parser ends with the first value and ignores what follows it, so a text is tried inside a list and inside an object:
    only a single whole value fits both.
    """
    fits = lambda before, behind: F.try_parse_json(F.concat(F.lit(before), content, F.lit(behind))).isNotNull()
    valid = (F.trim(content) != "") & fits("[", "]") & fits('{"v":', "}")
    return F.when(content.isNotNull(), F.struct(F.coalesce(valid, F.lit(False)).alias("is_json"), content.alias("content")))


def artifact_content(content: Column, note: Column, most: int) -> Column:
    """A JSON content, wrapped with its note where there is one, and cut to ``most`` characters."""
    note = F.nullif(F.trim(note), F.lit(""))
    wrapper = F.concat(F.lit('{"_note":'), F.to_json(F.array(note)).substr(F.lit(2), F.char_length(F.to_json(F.array(note))) - 2))
    wrapped = F.concat(wrapper, F.when(content.isNull(), F.lit("")).otherwise(F.concat(F.lit(',"_content":'), content)), F.lit("}"))
    return F.substring(F.when(note.isNull(), content).otherwise(wrapped), 1, most)


def parse_statuses(text: str | None) -> list[str]:
    """Distinct task states of a comma-separated list, in their order; ValueError for any other, or for none at all."""
    if text is None or not text.strip():
        return []
    parts = list(dict.fromkeys(p.strip().upper() for p in text.split(",") if p.strip()))
    for state in parts:
        if state in STAGE_ONLY_STATES:
            raise ValueError(f"{state} is a state of stages; for tasks under way ask for QUEUED,RUNNING")
        if state not in TASK_STATES:
            raise ValueError(f"{state} is no state of tasks: {', '.join(TASK_STATES)}")
    if not parts:
        raise ValueError("no state is given")
    return parts


def of_statuses(tasks: DataFrame, text: str | None) -> DataFrame:
    states = parse_statuses(text)
    return tasks.where(F.col("status").isin(*states)) if states else tasks


def projects_of(links: DataFrame) -> DataFrame:
    """contract_id, projects: the ids of all projects of a contract, each once and in ascending order."""
    return links.groupBy("contract_id").agg(F.array_sort(F.collect_set("project_id")).alias("projects"))
