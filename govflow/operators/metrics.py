"""Metrics of single projects, contracts and payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hierarchy import ancestors, rolled_up, seen_sums
from .stats import RESULT, money


def half_up(x: Column) -> Column:
    """floor(x + 0.5): halves go up, also below zero."""
    return F.floor(x + F.lit(0.5)).cast("long")


def overall_progress(phases: DataFrame) -> DataFrame:
    """project_id, progress: weighted percent over phases that are not skipped; DONE counts full, IN_PROGRESS its
    share rounded to whole points of weight x percent; 0 without weight. Null weights and percents are 0."""
    w, p = F.coalesce("weight", F.lit(0)).cast("long"), F.coalesce("percent", F.lit(0)).cast("long")
    counted = F.col("status") != "SKIPPED"
    points = F.when(F.col("status") == "DONE", w * 100).when(F.col("status") == "IN_PROGRESS", w * p).otherwise(0)
    sums = phases.groupBy("project_id").agg(F.sum(F.when(counted, points).otherwise(0)).alias("points"), F.sum(F.when(counted, w).otherwise(0)).alias("weight"))
    return sums.select("project_id", F.when(F.col("weight") == 0, F.lit(0).cast("long")).otherwise(half_up(F.col("points") / F.col("weight"))).alias("progress"))


def _rolled_up(projects: DataFrame, own: DataFrame, name: str) -> DataFrame:
    """id, amount: containers have the sum of all leaves below them (their own amount doesn't count), others their own."""
    rows = projects.select("id", "parent_id").join(own, "id", "left")
    return rolled_up(rows, name).select("id", F.col(name).cast(RESULT).alias(name))


def contract_amounts(projects: DataFrame, contracts: DataFrame, with_changes: bool = True) -> DataFrame:
    """id, contract_amount: of the primary contract, with its change or without, else of the project's own columns;
    containers sum the leaves below them, over any number of levels, and a project on a cycle has null."""
    amount = F.coalesce("contract_amount", F.lit(0)) + (F.coalesce("change_amount", F.lit(0)) if with_changes else F.lit(0))
    primary = contracts.select(F.col("id").alias("contract_id"), amount.alias("of_contract"))
    rows = projects.select("id", "contract_id", amount.alias("of_project")).join(primary, "contract_id", "left")
    return _rolled_up(projects, rows.select("id", F.coalesce("of_contract", "of_project").alias("contract_amount")), "contract_amount")


def paid_amounts(projects: DataFrame, payments: DataFrame) -> DataFrame:
    """id, paid_amount: of a leaf's own payments; containers sum the leaves below them and ignore their own."""
    own = payments.where("project_id is not null").groupBy(F.col("project_id").alias("id")).agg(money("paid_amount").alias("paid_amount"))
    return _rolled_up(projects, own, "paid_amount")


def phase_lists(projects: DataFrame, phases: DataFrame) -> DataFrame:
    """id, phases of every project: its phases in order (sort_no, then id), each with its id, name, status and percent; an empty
    list where there are none."""
    held = phases.groupBy(F.col("project_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("sort_no", F.col("id").alias("phase_id"), "phase_name", "status", "percent"))).alias("phases"))
    none = F.array().cast(dict(held.dtypes)["phases"])
    return projects.select("id").join(held, "id", "left").select("id", F.coalesce("phases", none).alias("phases"))


def phase_attachments(phases: DataFrame, attachments: DataFrame) -> DataFrame:
    """phase_id, project_id, n: attachments of each phase, 0 where there are none."""
    held = attachments.where("biz_type = 'PROJECT_PHASE'").groupBy(F.col("biz_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return phases.join(held, "id", "left").select(F.col("id").alias("phase_id"), "project_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def contract_counts(projects: DataFrame, links: DataFrame) -> DataFrame:
    """id, contracts: how many contracts each project sees."""
    return projects.select("id").join(seen_sums(projects, links), "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("contracts"))


def fund_summary(projects: DataFrame, contracts: DataFrame, links: DataFrame, payments: DataFrame) -> DataFrame:
    """id, contract_total, paid_total, outstanding over visible contracts and their, or the project's, payments.

    A payment counts once for a project, by its own key or through a contract that the project sees: what both would count
    is taken off by looking up the payments' own pairs, so no project's contracts are spread out.
    """
    zero = F.lit(0).cast(RESULT)
    amount = F.coalesce("contract_amount", F.lit(0)) + F.coalesce("change_amount", F.lit(0))
    live = contracts.groupBy(F.col("id").alias("contract_id")).agg(F.sum(amount).alias("amount"), F.count(F.lit(1)).alias("rows"))
    sums = lambda rows, *keys: rows.groupBy(*keys).agg(money("paid_amount").alias("paid"))
    by_contract = sums(payments.where("contract_id is not null"), "contract_id")
    amounts = live.join(by_contract, "contract_id", "left").select("contract_id", F.col("amount").cast(RESULT).alias("amount"), (F.coalesce("paid", zero) * F.col("rows")).cast(RESULT).alias("paid"))
    seen = seen_sums(projects, links, amounts).select("id", F.col("amount").alias("contract_total"), F.col("paid").alias("_through"))
    direct = sums(payments.where("project_id is not null"), F.col("project_id").alias("id")).withColumnRenamed("paid", "_direct")
    pairs = sums(payments.where("project_id is not null and contract_id is not null"), F.col("project_id").alias("id"), "contract_id").join(live.select("contract_id", "rows"), "contract_id")
    held = links.select(F.col("project_id").alias("ancestor_id"), "contract_id").distinct()
    both = pairs.join(ancestors(projects), "id").join(held, ["ancestor_id", "contract_id"], "left_semi").dropDuplicates(["id", "contract_id"])
    both = both.groupBy("id").agg(F.sum(F.col("paid") * F.col("rows")).alias("_both"))
    rows = projects.select("id").join(seen, "id", "left").join(direct, "id", "left").join(both, "id", "left")
    paid = F.coalesce("_direct", zero) + F.coalesce("_through", zero) - F.coalesce("_both", zero)
    rows = rows.select("id", F.coalesce("contract_total", zero).cast(RESULT).alias("contract_total"), paid.cast(RESULT).alias("paid_total"))
    return rows.withColumn("outstanding", F.greatest(F.col("contract_total") - F.col("paid_total"), zero).cast(RESULT))


def contract_progress(contracts: DataFrame, payments: DataFrame) -> DataFrame:
    """id, paid, n_paid, percent (at most 100, 0 without amount), unpaid; the base is the amount without changes."""
    started = (F.col("status") == "PAID") | (F.col("paid_amount") > 0)
    sums = payments.where("contract_id is not null").groupBy(F.col("contract_id").alias("id")).agg(money("paid_amount").alias("paid"), F.count_if(started).alias("n_paid"))
    rows = contracts.select("id", F.coalesce("contract_amount", F.lit(0)).alias("amount")).join(sums, "id", "left").select("id", "amount", F.coalesce("paid", F.lit(0).cast(RESULT)).alias("paid"), F.coalesce("n_paid", F.lit(0)).cast("long").alias("n_paid"))
    percent = F.when(F.col("amount") == 0, F.lit(0)).otherwise(F.least(F.lit(100), F.round(F.col("paid") * 100 / F.col("amount"), 0)))
    return rows.select("id", "paid", "n_paid", percent.cast("long").alias("percent"), F.greatest(F.col("amount") - F.col("paid"), F.lit(0)).cast(RESULT).alias("unpaid"))


def missing_vouchers(contracts: DataFrame, payments: DataFrame, attachments: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """contract_id, missing: required attachment types (comma-joined) that a contract with started payments lacks."""
    due = payments.where("contract_id is not null and status <> 'UNPAID'").select("contract_id").distinct().join(contracts.select(F.col("id").alias("contract_id")), "contract_id", "left_semi")
    held = attachments.where("biz_type = 'CONTRACT'").groupBy(F.col("biz_id").alias("contract_id")).agg(F.collect_set("attach_type").alias("held"))
    rows = due.join(held, "contract_id", "left")
    lacking = F.array_except(F.lit(list(required)), F.coalesce("held", F.array().cast("array<string>")))
    return rows.select("contract_id", F.array_join(F.array_sort(lacking), ",").alias("missing")).where("missing <> ''")


def payment_against_plan(payments: DataFrame) -> DataFrame:
    """node_code, status, sign of paid - plan: how many payments, and the mean percent paid (plans of 0 left out)."""
    sign = F.when(F.col("paid_amount") > F.col("plan_amount"), 1).when(F.col("paid_amount") < F.col("plan_amount"), -1).otherwise(0)
    percent = F.when(F.col("plan_amount") > 0, F.round(F.col("paid_amount") * 100 / F.col("plan_amount"), 0).cast("long"))
    rows = payments.select("node_code", "status", sign.cast("long").alias("sign"), percent.alias("percent"))
    return rows.groupBy("node_code", "status", "sign").agg(F.count(F.lit(1)).alias("n"), F.sum("percent").cast("long").alias("percent_sum"))
