"""Controlled queries: a fixed list of entities and filters, checked before anything is planned."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import details, metrics, stats
from .hierarchy import visible_contracts
from .lists import limit_of


#: Ids of a scope that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


class QueryError(ValueError):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


@dataclass(frozen=True)
class Filter:
    """kind: "text", "int" or a tuple of allowed values (compared without case, returned as listed)."""

    kind: str | tuple[str, ...] = "text"
    required: bool = False


STATUS, TYPE = ("RUN", "DONE", "PAUSE", "STOP"), ("HW", "SW")
ENTITIES: dict[str, dict[str, Filter]] = {
    "projects": {"projectId": Filter("int"), "status": Filter(STATUS), "type": Filter(TYPE), "year": Filter("int"), "keyword": Filter()},
    "contracts": {"projectId": Filter("int"), "contractType": Filter(("MAIN", "SUB")), "keyword": Filter()},
    "payments": {"projectId": Filter("int"), "status": Filter(("UNPAID", "PART", "PAID")), "nodeCode": Filter()},
    "stats": {"projectId": Filter("int"), "kind": Filter(("phase_attachment_count", "type_distribution", "year_amount"), required=True)},
}


def validate(entity: str, filters: dict | None) -> dict:
    """Canonical filters, or QueryError: 404 for an unknown entity, 400 for anything else that isn't listed."""
    allowed = ENTITIES.get(entity)
    if allowed is None:
        raise QueryError(404, f"unknown entity {entity!r}; known: {', '.join(ENTITIES)}")
    out = {}
    for name, value in (filters or {}).items():
        if name not in allowed:
            raise QueryError(400, f"unknown filter {name!r}; known: {', '.join(allowed)}")
        if isinstance(value, (dict, list, tuple, set)):
            raise QueryError(400, f"{name} has to be one value")
        if value is None or str(value).strip() == "":
            continue
        kind = allowed[name].kind
        if kind == "int":
            out[name] = _integer(name, value)
        elif kind == "text":
            out[name] = str(value).strip()
        else:
            found = [v for v in kind if v.lower() == str(value).strip().lower()]
            if not found:
                raise QueryError(400, f"{name} has to be one of {', '.join(kind)}")
            out[name] = found[0]
    for name, rule in allowed.items():
        if rule.required and name not in out:
            raise QueryError(400, f"{name} is required")
    return out


def _integer(name: str, value) -> int:
    """Whole numbers, also written as 12.0."""
    try:
        number = float(value) if not isinstance(value, int) else value
        if isinstance(value, bool) or int(number) != number:
            raise ValueError
    except (TypeError, ValueError, OverflowError):
        raise QueryError(400, f"{name} has to be an integer") from None
    return int(number)


@dataclass(frozen=True)
class Scope:
    """Projects that the caller may see; no ids at all means none."""

    project_ids: frozenset[int] = field(default_factory=frozenset)

    def narrowed(self, project_id: int | None) -> frozenset[int]:
        if project_id is None:
            return self.project_ids
        if project_id not in self.project_ids:
            raise QueryError(403, f"project {project_id} is out of scope")
        return frozenset([project_id])


def intersect(one: frozenset | None, two: frozenset | None) -> frozenset | None:
    """Of two scope dimensions, where None is no restriction. An empty set stays empty: it admits nothing."""
    if one is None or two is None:
        return one if two is None else two
    return one & two


class ControlledQuery:
    """Answers over a portfolio within a scope; every method plans lazily and returns a DataFrame."""

    def __init__(self, portfolio, scope: Scope, as_of: str):
        self.portfolio, self.scope, self.as_of = portfolio, scope, as_of

    def run(self, entity: str, filters: dict | None = None, limit: int | None = None) -> DataFrame:
        checked = validate(entity, filters)
        ids = sorted(self.scope.narrowed(checked.get("projectId")))
        scoped = self.portfolio.spark.createDataFrame([(i,) for i in ids], "id long")
        projects = self.portfolio.projects.join(F.broadcast(scoped) if len(ids) <= BROADCAST_IDS else scoped, "id", "left_semi")
        if entity == "stats":
            return getattr(self, checked["kind"])(projects, limit_of(limit))
        return getattr(self, entity)(projects, checked, limit_of(limit))

    def projects(self, projects: DataFrame, checked: dict, n: int) -> DataFrame:
        every, p = self.portfolio.projects, self.portfolio
        rows = projects
        for name, column in (("status", "status"), ("type", "type")):
            if name in checked:
                rows = rows.where(F.col(column) == checked[name])
        if "year" in checked:
            rows = rows.where(F.year("approve_date") == checked["year"])
        if "keyword" in checked:
            rows = rows.where(F.col("name").contains(checked["keyword"]))
        rows = rows.select("id", "name", "status", F.coalesce("budget_amount", F.lit(0)).cast(stats.RESULT).alias("budget"))
        for part in (
            metrics.contract_amounts(every, p.contracts),
            metrics.paid_amounts(every, p.payments),
            metrics.contract_counts(projects, p.links),
            metrics.overall_progress(p.phases).withColumnRenamed("project_id", "id"),
            stats.current_phase(p.phases).withColumnRenamed("project_id", "id"),
        ):
            rows = rows.join(part, "id", "left")
        rows = rows.withColumn("progress", F.coalesce("progress", F.lit(0)).cast("long"))
        return rows.orderBy("id").limit(n)

    def contracts(self, projects: DataFrame, checked: dict, n: int) -> DataFrame:
        seen = visible_contracts(self.portfolio.projects, self.portfolio.links, of=projects).select(F.col("contract_id").alias("id")).distinct()
        rows = self.portfolio.contracts.join(seen, "id", "left_semi")
        if "contractType" in checked:
            rows = rows.where(F.col("contract_type") == checked["contractType"])
        if "keyword" in checked:
            rows = rows.where(F.col("name").contains(checked["keyword"]))
        return rows.select("id", "name", "contract_type", "contract_amount", "change_amount").orderBy("id").limit(n)

    def payments(self, projects: DataFrame, checked: dict, n: int) -> DataFrame:
        mine = projects.select(F.col("id").alias("_project"))
        seen = visible_contracts(self.portfolio.projects, self.portfolio.links, of=projects).select(F.col("contract_id").alias("_contract")).distinct()
        rows = self.portfolio.payments.join(mine, F.col("project_id") == F.col("_project"), "left").join(seen, F.col("contract_id") == F.col("_contract"), "left").where("_project is not null or _contract is not null")
        if "status" in checked:
            rows = rows.where(F.col("status") == checked["status"])
        if "nodeCode" in checked:
            rows = rows.where(F.col("node_code") == checked["nodeCode"])
        columns = ["project_id", "contract_id", "node_code", "plan_amount", "paid_amount", "plan_date", "status"]
        order = [F.asc_nulls_first("contract_id"), "node_code", "plan_date", "plan_amount", F.asc_nulls_first("project_id"), "paid_amount"]
        # Names are looked up for the rows that stay.
        return details.with_names(rows.select(columns).orderBy(*order).limit(n), self.portfolio.projects, self.portfolio.contracts).orderBy(*order)

    def phase_attachment_count(self, projects: DataFrame, n: int) -> DataFrame:
        rows = metrics.phase_attachments(self.portfolio.phases, self.portfolio.attachments)
        return rows.join(projects.select(F.col("id").alias("project_id")), "project_id", "left_semi").select("project_id", "phase_id", "n").orderBy("project_id", "phase_id").limit(n)

    def type_distribution(self, projects: DataFrame, n: int) -> DataFrame:
        return stats.distribution(projects, "type").orderBy("type").limit(n)

    def year_amount(self, projects: DataFrame, n: int) -> DataFrame:
        p = self.portfolio
        return stats.year_money(projects, p.contracts, p.links, p.payments, self.as_of, only_linked=True).orderBy("year").limit(n)
