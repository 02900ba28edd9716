"""Portfolio statistics. ``as_of`` stands for today, so results are reproducible."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hierarchy import leaves

RESULT = "decimal(18,2)"
STATUS_ORDER = ("RUN", "DONE", "PAUSE", "STOP")
OPEN = ("IN_PROGRESS", "NOT_STARTED")
ALL_CLOSED = "All closed"


def money(name: str):
    """The sum of an amount; null amounts and no rows count 0."""
    return F.coalesce(F.sum(F.coalesce(F.col(name), F.lit(0))), F.lit(0)).cast(RESULT)


def summary(projects: DataFrame, phases: DataFrame, contracts: DataFrame, links: DataFrame, payments: DataFrame, as_of: str, scoped_contracts: bool = False) -> DataFrame:
    """One row: leaf counts by status, new in the year, overdue, budget, contract and paid totals, execution rate.

    Contract money is that of all live contracts whatever narrows the projects; ``scoped_contracts`` counts only those
    of the given leaves. A payment counts once when its project is a leaf or its contract is linked to one.
    """
    leaf = leaves(projects)
    day = F.lit(as_of).cast("date")
    counts = leaf.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUS_ORDER],
        F.count_if(F.year(F.coalesce("approve_date", F.to_date("create_time"))) == F.year(day)).alias("new_this_year"),
        money("budget_amount").alias("budget_total"),
    )
    late = phases.where(F.col("status").isin(*OPEN) & (F.col("plan_finish_date") < day)).select(F.col("project_id").alias("id"))
    overdue = leaf.join(late, "id", "left_semi").agg(F.count(F.lit(1)).alias("overdue"))
    linked = links.join(leaf.select(F.col("id").alias("project_id")), "project_id", "left_semi").select("contract_id").distinct()
    counted = contracts.join(linked.withColumnRenamed("contract_id", "id"), "id", "left_semi") if scoped_contracts else contracts
    total = counted.agg((money("contract_amount") + money("change_amount")).cast(RESULT).alias("contract_total"))
    mine = leaf.select(F.col("id").alias("_leaf")).distinct()
    theirs = linked.select(F.col("contract_id").alias("_contract"))
    paid = payments.join(mine, F.col("project_id") == F.col("_leaf"), "left").join(theirs, F.col("contract_id") == F.col("_contract"), "left")
    paid = paid.where("_leaf is not null or _contract is not null").agg(money("paid_amount").alias("paid_total"))
    # Four one-row frames.
    row = counts.crossJoin(overdue).crossJoin(total).crossJoin(paid)
    rate = F.when(F.col("contract_total") == 0, F.lit(0)).otherwise(F.round(F.col("paid_total") * 100 / F.col("contract_total"), 1))
    return row.withColumn("execution_rate", rate.cast("decimal(10,1)"))


def distribution(projects: DataFrame, column: str) -> DataFrame:
    """Leaves by status or type; absent values have no row, null is a value."""
    return leaves(projects).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def current_phase(phases: DataFrame) -> DataFrame:
    """project_id, current_phase: the first open phase by sort_no; a fixed word when all are closed."""
    opened = F.when(F.col("status").isin(*OPEN), F.struct("sort_no", "phase_name"))
    return phases.groupBy("project_id").agg(F.coalesce(F.min(opened)["phase_name"], F.lit(ALL_CLOSED)).alias("current_phase"))


def phase_funnel(projects: DataFrame, phases: DataFrame) -> DataFrame:
    """Leaves by current phase; leaves without phases count as closed."""
    rows = leaves(projects).select(F.col("id").alias("project_id")).join(current_phase(phases), "project_id", "left")
    return rows.groupBy(F.coalesce("current_phase", F.lit(ALL_CLOSED)).alias("phase")).agg(F.count(F.lit(1)).alias("n"))


def year_money(projects: DataFrame, contracts: DataFrame, links: DataFrame, payments: DataFrame, as_of: str, only_linked: bool = False) -> DataFrame:
    """year, budget, contract, paid.

    Budgets go to the leaf's approval year (else the current one). A contract's amount with changes and its payments go
    to the least approval year of the leaves that it covers, else to its creation year, else to the current one; with
    ``only_linked`` contracts that cover no leaf are left out. Payments without a contract belong to no year.
    """
    leaf = leaves(projects).select("id", F.year("approve_date").cast("long").alias("y"), "budget_amount")
    now = F.year(F.lit(as_of).cast("date")).cast("long")
    zero = F.lit(0).cast(RESULT)
    covered = links.join(leaf.select(F.col("id").alias("project_id"), "y"), "project_id").groupBy("contract_id").agg(F.min("y").alias("y"))
    dated = contracts.join(covered.withColumn("covers", F.lit(True)), contracts["id"] == covered["contract_id"], "inner" if only_linked else "left")
    dated = dated.select("id", F.coalesce("y", "create_year", now).alias("year"), (F.coalesce("contract_amount", F.lit(0)) + F.coalesce("change_amount", F.lit(0))).cast(RESULT).alias("contract"))
    by_contract = payments.where("contract_id is not null").groupBy("contract_id").agg(money("paid_amount").alias("paid"))
    paid = dated.join(by_contract, dated["id"] == by_contract["contract_id"], "left").select("year", zero.alias("budget"), "contract", F.coalesce("paid", zero).alias("paid"))
    budget = leaf.select(F.coalesce("y", now).alias("year"), F.coalesce("budget_amount", F.lit(0)).cast(RESULT).alias("budget"), zero.alias("contract"), zero.alias("paid"))
    return budget.unionByName(paid).groupBy("year").agg(*[F.sum(c).cast(RESULT).alias(c) for c in ("budget", "contract", "paid")])
