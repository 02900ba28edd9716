"""Dashboards, lists and pages. Every limited result has a total order, ties broken by id."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .durable import new_path
from .hierarchy import ancestors, leaves
from .stats import OPEN

DEFAULT_LIMIT, MOST = 20, 100


def under(parent: int | None) -> Column:
    """The children of a project; without one, the projects at the top."""
    return F.col("parent_id").isNull() if parent is None else F.col("parent_id") == parent


def limit_of(n: int | None, most: int = MOST) -> int:
    """Absent or not positive: the default; at most ``most``."""
    return min(n, most) if n and n > 0 else DEFAULT_LIMIT


def overdue(projects: DataFrame, phases: DataFrame, as_of: str, n: int = 8) -> DataFrame:
    """The phases of leaves that are longest past their planned end."""
    day = F.lit(as_of).cast("date")
    late = phases.where(F.col("status").isin(*OPEN) & (F.col("plan_finish_date") < day))
    rows = late.join(leaves(projects).select(F.col("id").alias("project_id")), "project_id", "left_semi")
    rows = rows.select("project_id", F.col("id").alias("phase_id"), "phase_name", F.date_diff(day, "plan_finish_date").cast("long").alias("days"))
    return rows.orderBy(F.desc("days"), "phase_id").limit(n)


def upcoming_acceptance(projects: DataFrame, phases: DataFrame, as_of: str, words: tuple[str, ...], days: int = 60, n: int = 8) -> DataFrame:
    """Open acceptance phases (the name contains one of ``words``) planned within ``days``, soonest first."""
    day = F.lit(as_of).cast("date")
    named = F.lit(False)
    for word in words:
        named = named | F.col("phase_name").contains(word)
    due = phases.where(F.col("status").isin(*OPEN) & named & F.col("plan_finish_date").between(day, F.date_add(day, days)))
    rows = due.join(leaves(projects).select(F.col("id").alias("project_id")), "project_id", "left_semi")
    return rows.select("project_id", F.col("id").alias("phase_id"), "phase_name", "plan_finish_date").orderBy("plan_finish_date", "phase_id").limit(n)


def todos(projects: DataFrame, phases: DataFrame, user: int) -> DataFrame:
    """Running phases of leaves that a user manages."""
    mine = phases.where((F.col("status") == "IN_PROGRESS") & (F.col("manager_user_id") == user))
    rows = mine.join(leaves(projects).select(F.col("id").alias("project_id")), "project_id", "left_semi")
    return rows.select(F.col("id").alias("phase_id"), "project_id", "plan_finish_date").orderBy("plan_finish_date", "phase_id")


def recent(projects: DataFrame, n: int = 6) -> DataFrame:
    return projects.orderBy(F.desc_nulls_last("create_time"), "id").limit(n).select("id", "name", "status", "create_time")


def in_csv(column: str, values: str) -> Column:
    """Equality with one of the comma-separated values; blanks are dropped, and no value at all means no condition."""
    wanted = sorted({v.strip() for v in values.split(",") if v.strip()})
    return F.col(column).isin(*wanted) if wanted else F.lit(True)


def years_in(column: str, values: str) -> Column:
    """The year is one of the listed ones; what is no number is dropped."""
    wanted = sorted({int(v) for v in values.split(",") if v.strip().isdigit()})
    return F.year(column).isin(*wanted) if wanted else F.lit(True)


def project_filter(keyword: str = "", statuses: str = "", years: str = "", owner_unit: str = "") -> Column:
    """The conditions of a project list; blank parameters are none. The keyword is literal text in name, code or vendor."""
    where = in_csv("status", statuses) & years_in("approve_date", years)
    if keyword.strip():
        where = where & (F.col("name").contains(keyword.strip()) | F.col("code").contains(keyword.strip()) | F.col("vendor_name").contains(keyword.strip()))
    if owner_unit.strip():
        where = where & (F.col("owner_unit") == owner_unit.strip())
    return where


class Pages:
    """The pages of ``rows`` in a total order. Rows are dealt to ranges of the order, each a folder, and counted there; a page
    reads and sorts only the range that holds it (or the few that do), and the counts tell the total."""

    def __init__(self, rows: DataFrame, order: list):
        self.spark, self.order, self.part, self.schema = rows.sparkSession, order, f"part_{uuid.uuid4().hex}", rows.schema
        self.path = new_path(self.spark, "pages")
        rows.repartitionByRange(*order).withColumn(self.part, F.spark_partition_id()).write.partitionBy(self.part).parquet(self.path)
        self.counts = sorted(map(tuple, self._read().groupBy(self.part).count().collect()))
        self.total = sum(n for _, n in self.counts)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField(self.part, IntegerType())])).parquet(self.path)

    def page(self, page: int, size: int) -> DataFrame:
        """Page ``page`` (from 1), each row with the total number of rows."""
        first, before, skipped, held = (page - 1) * size, 0, 0, []
        for part, n in self.counts:
            if before + n > first and before < first + size:
                skipped = before if not held else skipped
                held.append(part)
            before += n
        rows = self._read().where(F.col(self.part).isin(held) if held else F.lit(False)).drop(self.part)
        return rows.orderBy(*self.order).offset(first - skipped if held else 0).limit(size).withColumn("total", F.lit(self.total).cast("long"))


def page_of(rows: DataFrame, order: list, page: int = 1, size: int = DEFAULT_LIMIT, most: int = MOST) -> DataFrame:
    """One page (from 1) of ``rows`` in a total order, each row with the total number of rows."""
    return Pages(rows, order).page(max(1, page), max(1, min(size, most)))


def rows_after(rows: DataFrame, order: list[tuple[str, bool]], last: dict | None, size: int = DEFAULT_LIMIT, most: int = MOST) -> DataFrame:
    """The ``size`` rows behind the row ``last`` (its values by column; None: the first rows) in a total order of (column,
    descending), nulls last: the next page without counting or skipping the ones before."""
    behind, same = F.lit(last is None), F.lit(True)
    for column, descending in order if last is not None else []:
        value, c = last[column], F.col(column)
        if value is not None:
            behind = behind | (same & (c.isNull() | (c < F.lit(value) if descending else c > F.lit(value))))
        same = same & c.eqNullSafe(F.lit(value))
    by = [F.desc_nulls_last(c) if descending else F.asc_nulls_last(c) for c, descending in order]
    return rows.where(F.coalesce(behind, F.lit(False))).orderBy(*by).limit(max(1, min(size, most)))


def top_level(projects: DataFrame, where: Column) -> DataFrame:
    """Top-level projects under a condition, with the number of their children."""
    parent = f"parent_{uuid.uuid4().hex}"
    children = projects.where("parent_id is not null").groupBy(F.col("parent_id").alias(parent)).agg(F.count(F.lit(1)).alias("children"))
    rows = projects.where("parent_id is null").where(where).join(children, F.col("id") == F.col(parent), "left")
    return rows.select("id", "code", "name", "status", "create_time", F.coalesce("children", F.lit(0)).cast("long").alias("children"))


def project_page(projects: DataFrame, where: Column, page: int, size: int) -> DataFrame:
    """Top-level projects with the number of their children, newest first."""
    return page_of(top_level(projects, where), [F.desc_nulls_last("create_time"), "id"], page, size).drop("create_time")


def project_page_after(projects: DataFrame, where: Column, last: dict | None, size: int) -> DataFrame:
    """The projects that follow the row ``last`` (create_time, id) of a page of ``project_page``."""
    return rows_after(top_level(projects, where), [("create_time", True), ("id", False)], last, size)


def in_days(column: str, begin: str, end: str) -> Column:
    """A time within closed days."""
    return (F.col(column) >= F.lit(begin).cast("timestamp")) & (F.col(column) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))


def main_first(contracts: DataFrame) -> DataFrame:
    return contracts.orderBy(F.when(F.col("contract_type") == "MAIN", 0).otherwise(1), "id")


def shared_attachments(projects: DataFrame, attachments: DataFrame) -> DataFrame:
    """project_id, attachment_id, shared: own project attachments and those of all ancestors."""
    held = attachments.where("biz_type = 'PROJECT'").select(F.col("biz_id").alias("ancestor_id"), F.col("id").alias("attachment_id"))
    rows = ancestors(projects).join(held, "ancestor_id")
    return rows.select(F.col("id").alias("project_id"), "attachment_id", (F.col("level") > 0).alias("shared"))


def attachment_projects(attachments: DataFrame, projects: DataFrame, phases: DataFrame, links: DataFrame, payments: DataFrame) -> DataFrame:
    """attachment_id, project_id by the kind of owner; a contract's is its project of least id; null when unknown, or for a
    payment of no project."""
    kinds = [
        projects.select(F.lit("PROJECT").alias("biz_type"), F.col("id").alias("biz_id"), F.col("id").alias("project_id")),
        phases.select(F.lit("PROJECT_PHASE").alias("biz_type"), F.col("id").alias("biz_id"), "project_id"),
        links.groupBy(F.col("contract_id").alias("biz_id")).agg(F.min("project_id").alias("project_id")).select(F.lit("CONTRACT").alias("biz_type"), "biz_id", "project_id"),
        payments.groupBy(F.col("id").alias("biz_id")).agg(F.min("project_id").alias("project_id")).select(F.lit("PAYMENT").alias("biz_type"), "biz_id", "project_id"),
    ]
    owners = reduce(DataFrame.unionByName, kinds)
    return attachments.join(owners, ["biz_type", "biz_id"], "left").select(F.col("id").alias("attachment_id"), "project_id")


def orphan_contracts(contracts: DataFrame, links: DataFrame, projects: DataFrame) -> DataFrame:
    """Contracts that no live project links to."""
    linked = links.join(projects.select(F.col("id").alias("project_id")), "project_id", "left_semi").select(F.col("contract_id").alias("id"))
    return contracts.join(linked, "id", "left_anti")


def members(projects: DataFrame, users: DataFrame) -> DataFrame:
    """project_id, names: users of the comma-separated member ids, in that order; tokens that are no id are skipped."""
    ids = F.filter(F.transform(F.split("member_ids", ","), lambda x: F.trim(x).try_cast("bigint")), lambda x: x.isNotNull())
    rows = projects.select(F.col("id").alias("project_id"), F.posexplode(ids).alias("at", "user_id")).join(users, "user_id")
    return rows.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "user_name"))), lambda x: x["user_name"]), ",").alias("names"))
