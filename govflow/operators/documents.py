"""Lists of documents and attachments, their tasks, and what a chat may use of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govflow.functions import text as T

from .hierarchy import latest
from .tasks import STAGES

KIND_RANK = {"PROJECT_PHASE": 0, "CONTRACT": 1, "PROJECT": 2, "PARENT": 3, "PAYMENT": 4}


def document_list(documents: DataFrame, attachments: DataFrame, owners: DataFrame, tasks: DataFrame, project_id: int | None = None) -> DataFrame:
    """doc_id, attachment_id, project_id, status: each document with its attachment (of the least id), the owning project
    and its latest task. Documents without an attachment stay, unless a project is asked for."""
    first = attachments.groupBy(F.col("ai_doc_id").alias("doc_id")).agg(F.min("id").alias("attachment_id"))
    state = latest(tasks, "attachment_id", "id").select("attachment_id", "status")
    rows = documents.join(first, "doc_id", "left").join(owners, "attachment_id", "left").join(state, "attachment_id", "left")
    rows = rows.select("doc_id", "attachment_id", "project_id", "status")
    return rows if project_id is None else rows.where(F.col("project_id") == project_id)


def named(keyword: str) -> Column:
    """A case-insensitive part of the file name or the document id; blank is no condition."""
    word = keyword.strip().lower()
    return (F.lower("file_name").contains(word) | F.lower("doc_id").contains(word)) if word else F.lit(True)


def eligible(attachments: DataFrame, asked: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Attachments that a chat may use (ready, with a document), and those asked for by id that it may not, which are an
    error; others that aren't ready are left out silently."""
    ready = (F.col("ai_index_status") == "READY") & (F.coalesce(F.col("ai_doc_id"), F.lit("")) != "")
    ready = F.coalesce(ready, F.lit(False))
    if asked is None:
        return attachments.where(ready), attachments.where(F.lit(False))
    mine = attachments.where(F.col("id").isin(*asked) if asked else F.lit(False))
    return mine.where(ready), mine.where(~ready)


def grouped(attachments: DataFrame, phases: DataFrame) -> DataFrame:
    """biz_type, biz_id, n, first_id, position: attachments by owner, phases in their order first, then by kind."""
    rank = F.lit(len(KIND_RANK))
    for kind, place in KIND_RANK.items():
        rank = F.when(F.col("biz_type") == kind, place).otherwise(rank)
    held = attachments.groupBy("biz_type", "biz_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    order = phases.select(F.col("id").alias("biz_id"), F.lit("PROJECT_PHASE").alias("biz_type"), "sort_no")
    rows = held.join(order, ["biz_type", "biz_id"], "left")
    return rows.select("biz_type", "biz_id", "n", "first_id", rank.cast("long").alias("kind_rank"), F.coalesce("sort_no", F.lit(0)).cast("long").alias("sort_no"))


def filtered_payments(payments: DataFrame, contracts: DataFrame, nodes: list[str], statuses: list[str] | None = None, keyword: str = "") -> DataFrame:
    """Payments of a status and keyword (contract, node, status; case doesn't matter), with the place of their node in the
    dictionary (99 for others) that they are listed by."""
    place = F.coalesce(F.nullif(F.array_position(F.lit(nodes), F.col("node_code")), F.lit(0)), F.lit(99))
    rows = payments.join(contracts.select(F.col("id").alias("contract_id"), F.col("name").alias("contract_name")), "contract_id", "left")
    if statuses:
        rows = rows.where(F.col("status").isin(*statuses))
    word = keyword.strip().lower()
    if word:
        hit = F.lit(False)
        for column in ("contract_name", "node_code", "status"):
            hit = hit | F.coalesce(F.lower(column).contains(word), F.lit(False))
        rows = rows.where(hit)
    return rows.withColumn("node_place", place.cast("long"))


def availability(asked: list[int], records: DataFrame, objects: DataFrame) -> DataFrame:
    """id, position, state of 1 to 50 distinct positive ids in the order asked: missing_record, missing_object (also for a record
    without a key) or ok. ValueError for any other ids."""
    ids = list(dict.fromkeys(asked))
    if not 1 <= len(ids) <= 50 or min(ids) <= 0:
        raise ValueError("1 to 50 positive ids have to be asked for")
    frame = records.sparkSession.createDataFrame(list(enumerate(ids)), "position int, id long")
    rows = F.broadcast(frame).join(records.select("id", "object_key", F.lit(True).alias("_known")), "id", "left").join(objects.select("object_key", F.lit(True).alias("_there")), "object_key", "left")
    state = F.when(F.col("_known").isNull(), "missing_record").when(F.col("_there").isNull(), "missing_object").otherwise("ok")
    return rows.select("id", "position", state.alias("state"))


def run_detail(runs: DataFrame, stages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """run, stages (in pipeline order), artifacts (latest revision of each type), failed, elapsed_s of every run."""
    place = F.array_position(F.lit(list(STAGES)), F.col("stage"))
    by_run = stages.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "stage", "status"))).alias("x"), F.sum(F.coalesce("failed", F.lit(0))).cast("long").alias("failed"), F.sum(F.coalesce("elapsed_s", F.lit(0))).cast("long").alias("elapsed_s"))
    newest = artifacts.groupBy("run", "type").agg(F.max("revision").alias("revision"))
    held = newest.groupBy("run").agg(F.array_sort(F.collect_list(F.concat_ws("@", "type", F.col("revision").cast("string")))).alias("artifacts"))
    rows = runs.join(by_run, "run", "left").join(held, "run", "left")
    shown = F.array_join(F.transform("x", lambda s: F.concat_ws(":", s["stage"], s["status"])), " ")
    return rows.select("run", F.coalesce(shown, F.lit("")).alias("stages"), F.coalesce(F.array_join("artifacts", " "), F.lit("")).alias("artifacts"), F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("elapsed_s", F.lit(0)).alias("elapsed_s"))


def quality_board(artifacts: DataFrame) -> DataFrame:
    """One row over the latest artifact of each run and type: empty-page, removed and embedded ratios and the mean chunk
    length from their JSON contents; null where nothing tells."""
    rows = latest(artifacts.withColumn("_key", F.concat_ws("/", F.col("run").cast("string"), "type")), "_key", "revision")
    number = lambda name: F.get_json_object("content", f"$.{name}").try_cast("double")
    total = lambda name: F.sum(number(name))
    return rows.agg(
        F.round(F.try_divide(total("empty_pages"), total("pages")), 4).alias("empty_ratio"),
        F.round(F.try_divide(total("removed_chars"), total("chars")), 4).alias("removed_ratio"),
        F.round(F.try_divide(total("chunk_chars"), total("chunks")), 4).alias("chunk_chars"),
        F.round(F.try_divide(total("embedded"), total("to_embed")), 4).alias("embed_rate"),
    )


def reconciled(pending: DataFrame, remote: DataFrame) -> DataFrame:
    """id, status of pending tasks after a look at the remote list: its final states win, a task that it lacks is LOST."""
    rows = pending.join(remote.select("id", F.col("status").alias("_remote")), "id", "left")
    status = F.when(F.col("_remote").isNull(), "LOST").when(F.col("_remote").isin("DONE", "PARTIAL", "FAILED"), F.col("_remote")).otherwise(F.col("status"))
    return rows.select("id", status.alias("status"))


def estimated_chunks(pages: Column, chars: Column, size: int = 500) -> Column:
    """Pages times chunks of a mean page, at least one each; a document of no pages is one page, of no chunk if empty."""
    paged = pages * F.greatest(F.lit(1), F.ceil(F.ceil(F.try_divide(chars, pages)) / size))
    return F.when(pages > 0, paged).otherwise(F.ceil(F.greatest(chars, F.lit(0)) / size)).cast("long")


def next_codes(projects: DataFrame, prefix: str, year: int) -> DataFrame:
    """code: the first unused prefix-year-number behind the count of such codes, deleted projects included."""
    start = f"{prefix}-{year}-"
    code = lambda number: F.format_string("%s%03d", F.lit(start), number)
    used = projects.where(F.col("code").startswith(start))
    n = used.agg(F.count(F.lit(1)).alias("n"))
    number = F.substring("code", len(start) + 1, 20).try_cast("long")
    # Free numbers follow the count or a number in use, so the first one is there.
    taken = used.select("code", number.alias("i")).where("i is not null").where(F.col("code") == code(F.col("i"))).select("i").distinct()
    behind = taken.join(F.broadcast(n), F.col("i") > F.col("n")).select("i")
    tries = n.select(F.col("n").alias("i")).union(behind).select((F.col("i") + 1).alias("i"))
    return tries.join(taken, "i", "left_anti").agg(F.min("i").alias("i")).select(code(F.col("i")).alias("code"))


def answer_rates(answers: DataFrame) -> DataFrame:
    """kind, n, number_rate, cited_rate of judged answers (kind, expected, answer, cited): the expected number stands in
    the answer, commas, spaces and units aside, not inside another number; null rates without rows."""
    plain = F.regexp_replace(F.col("answer"), r"[,，\s]", "")
    hit = F.regexp_instr(plain, F.concat(F.lit(r"(?<![0-9.])"), F.regexp_replace(F.col("expected"), r"([\\\[\](){}.*+?^$|])", r"\\$1"), F.lit(r"(?![0-9]|\.[0-9])"))) > 0
    rows = answers.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.try_divide(F.count_if("_hit"), F.count(F.lit(1))), 4).alias("number_rate"), F.round(F.try_divide(F.count_if(F.col("cited") > 0), F.count(F.lit(1))), 4).alias("cited_rate"))


def within_budget(pages: DataFrame, most: int) -> DataFrame:
    """Pages of each document in order while their characters stay within ``most``; the first page always."""
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = pages.withColumn("_sum", F.sum(F.char_length(F.coalesce("text", F.lit("")))).over(before)).withColumn("_first", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no")))
    return rows.where((F.col("_sum") <= most) | (F.col("_first") == 1)).drop("_sum", "_first")


def tool_counts(note: Column) -> Column:
    """The number of hits that a tool's note tells; null without one."""
    return F.nullif(F.regexp_extract(note, r"(?:命中|找到)\s*(\d+)\s*(?:段|条)", 1), F.lit("")).try_cast("int")


def iso_time(raw: Column) -> Column:
    """A time as yyyy-MM-dd HH:mm:ss; what is none as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(raw), "yyyy-MM-dd HH:mm:ss"), raw)


def read_page(pages: DataFrame, doc_id: str, page_no: int, most: int = 4000) -> DataFrame:
    return pages.where((F.col("doc_id").cast("string") == doc_id) & (F.col("page_no") == page_no)).select("doc_id", "page_no", T.clip(F.col("text"), most).alias("text"))
