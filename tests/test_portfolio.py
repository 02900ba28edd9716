"""Rules of the portfolio on rows made for them."""

import pytest

from govflow.operators import hierarchy, lists, metrics, stats
from govflow.operators.query import ControlledQuery, QueryError, Scope, intersect, validate
from govflow.views import Portfolio

MONEY = "decimal(15,2)"


@pytest.fixture
def golden(spark):
    """One project with a primary contract of 550,000, two phases, two payments and two attachments."""
    projects = spark.createDataFrame([(1, None, "SW", "RUN", 1_000_000, 500_000, 50_000, None, "2023-05-01")], "id long, parent_id long, type string, status string, budget_amount int, contract_amount int, change_amount int, contract_id long, approve_date string")
    projects = projects.selectExpr("id", "parent_id", "type", "status", "'p' as name", f"cast(budget_amount as {MONEY}) budget_amount", f"cast(contract_amount as {MONEY}) contract_amount", f"cast(change_amount as {MONEY}) change_amount", "contract_id", "cast(approve_date as date) approve_date", "timestamp_ntz'2023-01-01 00:00:00' create_time")

    class Fixture(Portfolio):
        pass

    p = Fixture(spark, "")
    p.__dict__ |= {
        "projects": projects,
        "phases": spark.createDataFrame([(101, 1, "Build", 1, 40, "DONE", 100), (102, 1, "Final", 2, 60, "IN_PROGRESS", 50)], "id long, project_id long, phase_name string, sort_no long, weight int, status string, percent int"),
        "contracts": spark.createDataFrame([], f"id long, name string, contract_type string, contract_amount {MONEY}, change_amount {MONEY}, create_year long"),
        "links": spark.createDataFrame([(1, 7), (1, 8)], "project_id long, contract_id long"),
        "payments": spark.createDataFrame([(1, 7, 120_000), (1, None, 80_000)], "project_id long, contract_id long, paid int").selectExpr("project_id", "contract_id", "'N1' node_code", f"cast(paid as {MONEY}) plan_amount", f"cast(paid as {MONEY}) paid_amount", "date'2024-01-01' plan_date", "'PAID' status"),
        "attachments": spark.createDataFrame([(201, "PROJECT_PHASE", 101), (202, "PROJECT_PHASE", 101), (203, "PROJECT", 1)], "id long, biz_type string, biz_id long"),
    }
    return p


def test_golden_project(golden):
    row = ControlledQuery(golden, Scope(frozenset([1])), "2024-01-01").run("projects").collect()[0]
    assert (row.contract_amount, row.paid_amount, row.contracts, row.progress, row.current_phase) == (550_000, 200_000, 2, 70, "Final")
    held = metrics.phase_attachments(golden.phases, golden.attachments).collect()
    assert {(r.phase_id, r.n) for r in held} == {(101, 2), (102, 0)}


def test_scope_comes_before_the_query(golden):
    query = ControlledQuery(golden, Scope(frozenset([1])), "2024-01-01")
    with pytest.raises(QueryError) as e:
        query.run("projects", {"projectId": 2})
    assert e.value.status == 403
    assert query.run("projects", {"projectId": "1.0"}).count() == 1
    assert ControlledQuery(golden, Scope(), "2024-01-01").run("projects").count() == 0


@pytest.mark.parametrize(
    ("entity", "filters", "status"),
    [("projects", {"nope": 1}, 400), ("projects", {"status": "X"}, 400), ("projects", {"year": "12.7"}, 400), ("projects", {"year": True}, 400), ("projects", {"keyword": {"a": 1}}, 400), ("stats", {}, 400), ("nothing", {}, 404)],
)
def test_rejected_filters(entity, filters, status):
    with pytest.raises(QueryError) as e:
        validate(entity, filters)
    assert e.value.status == status


def test_accepted_filters():
    assert validate("projects", {"status": "run", "year": "12.0", "keyword": " a ", "type": ""}) == {"status": "RUN", "year": 12, "keyword": "a"}
    assert (lists.limit_of(None), lists.limit_of(0), lists.limit_of(5), lists.limit_of(1000)) == (20, 20, 5, 100)
    assert intersect(frozenset([1]), frozenset([2])) == frozenset() and intersect(None, frozenset([2])) == frozenset([2]) and intersect(None, None) is None


def test_leaves_depend_on_the_given_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, None)], "id long, parent_id long")
    assert {r.id for r in hierarchy.leaves(rows).collect()} == {2, 3}
    assert {r.id for r in hierarchy.leaves(rows.where("id <> 2")).collect()} == {1, 3}


def test_cycles_end(spark):
    rows = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (4, None)], "id long, parent_id long")
    assert {r.id for r in hierarchy.on_cycle(rows).collect()} == {1, 2}
    assert hierarchy.ancestors(rows).where("id = 4").count() == 1
    assert {(r.ancestor_id, r.level) for r in hierarchy.ancestors(rows).where("id = 3").collect()} == {(3, 0), (2, 1), (1, 2)}


def test_progress_rounding_and_empty_weights(spark):
    rows = spark.createDataFrame([(1, "IN_PROGRESS", 1, 1), (1, "NOT_STARTED", 1, None), (2, "DONE", None, 100), (3, "SKIPPED", 5, 100), (3, "DONE", 1, None)], "project_id long, status string, weight int, percent int")
    assert {r.project_id: r.progress for r in metrics.overall_progress(rows).collect()} == {1: 1, 2: 0, 3: 100}


def test_contract_total_ignores_the_project_filter(spark):
    p = Portfolio(spark, "/root/testdata/sf0.001")
    of = lambda projects, **k: stats.summary(projects, p.phases, p.contracts, p.links, p.payments, "1998-01-01", **k).collect()[0]
    every, some = of(p.projects), of(p.projects.where("type = 'HW'"))
    assert some.total < every.total and some.contract_total == every.contract_total
    assert of(p.projects.where("type = 'HW'"), scoped_contracts=True).contract_total < every.contract_total
    nothing = of(p.projects.where("false"), scoped_contracts=True)
    assert (nothing.total, nothing.contract_total, nothing.execution_rate) == (0, 0, 0)


def test_days_are_closed(spark):
    rows = spark.sql("SELECT explode(array(timestamp'2024-01-01 00:00:00', timestamp'2024-01-02 23:59:59.999', timestamp'2024-01-03 00:00:00')) AS t")
    assert rows.where(lists.in_days("t", "2024-01-01", "2024-01-02")).count() == 2
