"""Portfolio queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from govflow.operators import hierarchy, lists, metrics, stats
from govflow.operators.query import ControlledQuery, Scope
from govflow.views import Portfolio, oracle

AS_OF = "1998-06-01"
#: Projects that the controlled queries may see: leaves and two containers.
SCOPE = Scope(frozenset([*range(1, 400, 3), 1_000_003, 1_000_007]))
REQUIRED = ("PLAN", "REPORT", "VOUCHER")

QUERIES, ORACLE = {}, {}


def query(views: str, sql: str, more: str = ""):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Portfolio(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = oracle(views, sql, more) if views else f"WITH {more} {sql}"
        return f

    return add


LEAF = "leaf AS (SELECT * FROM projects p WHERE parent_id IS NOT NULL OR NOT EXISTS (SELECT 1 FROM projects c WHERE c.parent_id = p.id))"
LEVELS = """up AS (SELECT id, id AS anc, 0::BIGINT AS level FROM projects
    UNION ALL SELECT u.id, p.parent_id, u.level + 1 FROM up u JOIN projects p ON p.id = u.anc WHERE p.parent_id IS NOT NULL AND u.level < 8)"""
SEEN = f"{LEVELS}, seen AS (SELECT DISTINCT up.id AS project_id, contract_id FROM up JOIN links ON links.project_id = up.anc)"
SCOPED = f"scoped AS (SELECT * FROM projects WHERE id IN ({', '.join(map(str, sorted(SCOPE.project_ids)))}))"


@query("projects", "SELECT id, parent_id, type, status FROM leaf", LEAF)
def leaf_projects(p):
    return hierarchy.leaves(p.projects).select("id", "parent_id", "type", "status")


@query("projects", "SELECT id FROM leaf", "narrow AS (SELECT * FROM projects WHERE type = 'SW' AND status = 'RUN'), leaf AS (SELECT * FROM narrow p WHERE parent_id IS NOT NULL OR NOT EXISTS (SELECT 1 FROM narrow c WHERE c.parent_id = p.id))")
def leaf_of_filtered(p):
    """Containers whose children the filter drops are leaves."""
    return hierarchy.leaves(p.projects.where("type = 'SW' and status = 'RUN'")).select("id")


@query("projects", "SELECT id, anc AS ancestor_id, min(level) AS level FROM up GROUP BY 1, 2", LEVELS)
def project_ancestors(p):
    return hierarchy.ancestors(p.projects)


@query("projects links", "SELECT * FROM seen", SEEN)
def visible_contracts(p):
    return hierarchy.visible_contracts(p.projects, p.links)


@query("projects", "SELECT anc AS id, count(*) AS n FROM up GROUP BY 1", LEVELS)
def subtree_count(p):
    return hierarchy.subtree_sizes(p.projects)


@query("links contracts", "SELECT project_id, arg_min(contract_id, (CASE WHEN contract_type = 'MAIN' THEN 0 ELSE 1 END) * 1000000000 + contract_id) AS contract_id FROM links JOIN contracts ON contracts.id = contract_id GROUP BY 1")
def primary_contract(p):
    return hierarchy.primary_contract(p.links, p.contracts)


@query(
    "projects phases contracts links payments",
    f"""SELECT c.*, overdue, contract_total, paid_total,
        (CASE WHEN contract_total = 0 THEN 0 ELSE round(paid_total * 100 / contract_total, 1) END)::DECIMAL(10,1) AS execution_rate
    FROM (SELECT count(*) AS total, count(*) FILTER (status = 'RUN') AS run, count(*) FILTER (status = 'DONE') AS done, count(*) FILTER (status = 'PAUSE') AS pause, count(*) FILTER (status = 'STOP') AS stop,
                 count(*) FILTER (year(coalesce(approve_date, create_time::DATE)) = year(DATE '{AS_OF}')) AS new_this_year, coalesce(sum(budget_amount), 0)::DECIMAL(18,2) AS budget_total FROM leaf) c,
         (SELECT count(*) AS overdue FROM leaf WHERE id IN (SELECT project_id FROM phases WHERE status IN ('IN_PROGRESS', 'NOT_STARTED') AND plan_finish_date < DATE '{AS_OF}')),
         (SELECT sum(contract_amount + change_amount)::DECIMAL(18,2) AS contract_total FROM contracts),
         (SELECT sum(paid_amount)::DECIMAL(18,2) AS paid_total FROM payments WHERE project_id IN (SELECT id FROM leaf) OR contract_id IN (SELECT contract_id FROM links WHERE project_id IN (SELECT id FROM leaf)))""",
    LEAF,
)
def stats_summary(p):
    return stats.summary(p.projects, p.phases, p.contracts, p.links, p.payments, AS_OF)


@query("projects", "SELECT status, count(*) AS n FROM leaf GROUP BY 1", LEAF)
def status_distribution(p):
    return stats.distribution(p.projects, "status")


@query("projects", "SELECT type, count(*) AS n FROM leaf GROUP BY 1", LEAF)
def type_distribution(p):
    return stats.distribution(p.projects, "type")


CURRENT = "now AS (SELECT project_id, coalesce(arg_min(phase_name, sort_no) FILTER (status IN ('IN_PROGRESS', 'NOT_STARTED')), 'All closed') AS current_phase FROM phases GROUP BY 1)"


@query("phases", "SELECT * FROM now", CURRENT)
def current_phase(p):
    return stats.current_phase(p.phases)


@query("projects phases", "SELECT coalesce(current_phase, 'All closed') AS phase, count(*) AS n FROM leaf LEFT JOIN now ON project_id = id GROUP BY 1", f"{LEAF}, {CURRENT}")
def phase_funnel(p):
    return stats.phase_funnel(p.projects, p.phases)


def year_sql(leaf: str, linked: str) -> str:
    return f"""
    SELECT year, sum(budget)::DECIMAL(18,2) AS budget, sum(contract)::DECIMAL(18,2) AS contract, sum(paid)::DECIMAL(18,2) AS paid FROM (
        SELECT coalesce(year(approve_date), year(DATE '{AS_OF}'))::BIGINT AS year, coalesce(budget_amount, 0) AS budget, 0 AS contract, 0 AS paid FROM {leaf}
        UNION ALL
        SELECT coalesce(y, create_year)::BIGINT, 0, contract_amount + change_amount, coalesce((SELECT sum(paid_amount) FROM payments WHERE payments.contract_id = contracts.id), 0)
        FROM contracts {linked} JOIN (SELECT links.contract_id, min(year(approve_date)) AS y FROM links JOIN {leaf} ON links.project_id = {leaf}.id GROUP BY 1) c ON c.contract_id = contracts.id
    ) GROUP BY 1"""


@query("projects contracts links payments", year_sql("leaf", "LEFT"), LEAF)
def year_money(p):
    return stats.year_money(p.projects, p.contracts, p.links, p.payments, AS_OF)


@query("phases", "SELECT project_id, (CASE WHEN sum(w) = 0 THEN 0 ELSE floor(sum(x)::DOUBLE / sum(w) + 0.5) END)::BIGINT AS progress FROM (SELECT project_id, CASE status WHEN 'SKIPPED' THEN 0 ELSE weight END AS w, CASE status WHEN 'DONE' THEN weight * 100 WHEN 'IN_PROGRESS' THEN weight * percent ELSE 0 END AS x FROM phases) GROUP BY 1")
def overall_progress(p):
    return metrics.overall_progress(p.phases)


OWN_CONTRACT = "own AS (SELECT p.id, p.parent_id, coalesce(c.contract_amount + c.change_amount, coalesce(p.contract_amount, 0) + coalesce(p.change_amount, 0)) AS amount FROM projects p LEFT JOIN contracts c ON c.id = p.contract_id)"
OWN_PAID = "paid_own AS (SELECT p.id, p.parent_id, coalesce(x.paid, 0) AS amount FROM projects p LEFT JOIN (SELECT project_id, sum(paid_amount) AS paid FROM payments GROUP BY 1) x ON x.project_id = p.id)"


def rolled(own: str, name: str) -> str:
    return f"SELECT o.id, coalesce(c.s, o.amount)::DECIMAL(18,2) AS {name} FROM {own} o LEFT JOIN (SELECT parent_id, sum(amount) AS s FROM {own} WHERE parent_id IS NOT NULL GROUP BY 1) c ON c.parent_id = o.id"


@query("projects contracts", rolled("own", "contract_amount"), OWN_CONTRACT)
def contract_amount_rollup(p):
    return metrics.contract_amounts(p.projects, p.contracts)


@query("projects payments", rolled("paid_own", "paid_amount"), OWN_PAID)
def paid_rollup(p):
    return metrics.paid_amounts(p.projects, p.payments)


@query("projects contracts", rolled("own_base", "contract_amount"), "own_base AS (SELECT p.id, p.parent_id, coalesce(c.contract_amount, p.contract_amount, 0) AS amount FROM projects p LEFT JOIN contracts c ON c.id = p.contract_id)")
def contract_amount_base(p):
    """Without changes."""
    return metrics.contract_amounts(p.projects, p.contracts, with_changes=False)


#: Trees of some levels over the customers, a cycle of three, and its descendants.
DEEP = """tree AS (SELECT c_custkey AS id, CASE c_custkey WHEN 3 THEN 21 WHEN 21 THEN 150 WHEN 150 THEN 3 ELSE nullif(c_custkey // 5, 0) END AS parent_id, c_acctbal::DECIMAL(18,2) AS amount FROM customer),
    above AS (SELECT id, parent_id AS anc FROM tree WHERE parent_id IS NOT NULL UNION SELECT a.id, t.parent_id FROM above a JOIN tree t ON t.id = a.anc WHERE t.parent_id IS NOT NULL),
    ends AS (SELECT id, amount FROM tree WHERE id NOT IN (SELECT parent_id FROM tree WHERE parent_id IS NOT NULL))"""


@query("", """SELECT t.id, CASE WHEN EXISTS (SELECT 1 FROM above a WHERE a.id = t.id AND a.anc = t.id) THEN NULL ELSE coalesce(e.amount, s.total, 0) END::DECIMAL(18,2) AS amount
    FROM tree t LEFT JOIN ends e USING (id) LEFT JOIN (SELECT anc AS id, sum(amount) AS total FROM above JOIN ends USING (id) GROUP BY 1) s USING (id)""", f"RECURSIVE {DEEP}")
def deep_rollup(p):
    k = F.col("c_custkey")
    parent = F.when(k == 3, 21).when(k == 21, 150).when(k == 150, 3).otherwise(F.nullif(F.floor(k / 5), F.lit(0)))
    rows = p.table("customer").select(k.alias("id"), parent.cast("long").alias("parent_id"), F.col("c_acctbal").cast("decimal(18,2)").alias("amount"))
    return hierarchy.rolled_up(rows).select("id", F.col("amount").cast("decimal(18,2)").alias("amount"))


@query("projects phases", "SELECT p.id, coalesce(string_agg(f.id || ':' || f.status || ':' || f.percent, ',' ORDER BY sort_no, f.id), '') AS phases FROM projects p LEFT JOIN phases f ON f.project_id = p.id GROUP BY 1")
def project_phases(p):
    """Each project's ordered list of phases, written out."""
    told = F.transform("phases", lambda f: F.concat_ws(":", f["phase_id"].cast("string"), f["status"], f["percent"].cast("string")))
    return metrics.phase_lists(p.projects, p.phases).select("id", F.array_join(told, ",").alias("phases"))


ATTACHED = "held AS (SELECT phases.id AS phase_id, project_id, count(a.id) AS n FROM phases LEFT JOIN attachments a ON a.biz_type = 'PROJECT_PHASE' AND a.biz_id = phases.id GROUP BY 1, 2)"


@query("phases attachments", "SELECT * FROM held", ATTACHED)
def phase_attachment_count(p):
    return metrics.phase_attachments(p.phases, p.attachments)


COUNTED = "counted AS (SELECT p.id, count(seen.contract_id) AS contracts FROM projects p LEFT JOIN seen ON seen.project_id = p.id GROUP BY 1)"


@query("projects links", "SELECT * FROM counted", f"{SEEN}, {COUNTED}")
def contract_count(p):
    return metrics.contract_counts(p.projects, p.links)


@query(
    "projects contracts links payments",
    """SELECT p.id, coalesce(t, 0)::DECIMAL(18,2) AS contract_total, coalesce(y, 0)::DECIMAL(18,2) AS paid_total, greatest(coalesce(t, 0) - coalesce(y, 0), 0)::DECIMAL(18,2) AS outstanding
    FROM projects p
    LEFT JOIN (SELECT project_id, sum(contract_amount + change_amount) AS t FROM seen JOIN contracts ON contracts.id = contract_id GROUP BY 1) a ON a.project_id = p.id
    LEFT JOIN (SELECT project_id, sum(paid_amount) AS y FROM (
        SELECT project_id, paid_amount FROM payments WHERE project_id IS NOT NULL
        UNION ALL SELECT s.project_id, paid_amount FROM payments q JOIN seen s ON s.contract_id = q.contract_id JOIN contracts ON contracts.id = s.contract_id WHERE q.project_id IS DISTINCT FROM s.project_id) GROUP BY 1) b ON b.project_id = p.id""",
    SEEN,
)
def fund_summary(p):
    return metrics.fund_summary(p.projects, p.contracts, p.links, p.payments)


@query(
    "contracts payments",
    """SELECT id, coalesce(paid, 0)::DECIMAL(18,2) AS paid, coalesce(n_paid, 0) AS n_paid,
        (CASE WHEN contract_amount = 0 THEN 0 ELSE least(100, round(coalesce(paid, 0)::DECIMAL(18,2) * 100 / contract_amount, 0)) END)::BIGINT AS percent, greatest(contract_amount - coalesce(paid, 0), 0)::DECIMAL(18,2) AS unpaid
    FROM contracts LEFT JOIN (SELECT contract_id, sum(paid_amount) AS paid, count(*) FILTER (status = 'PAID' OR paid_amount > 0) AS n_paid FROM payments WHERE contract_id IS NOT NULL GROUP BY 1) ON contract_id = id""",
)
def contract_payment_progress(p):
    return metrics.contract_progress(p.contracts, p.payments)


@query(
    "contracts payments attachments",
    """SELECT contract_id, string_agg(t, ',' ORDER BY t) AS missing
    FROM (SELECT DISTINCT contract_id FROM payments WHERE status <> 'UNPAID' AND contract_id IN (SELECT id FROM contracts)), (VALUES ('PLAN'), ('REPORT'), ('VOUCHER')) r(t)
    WHERE NOT EXISTS (SELECT 1 FROM attachments a WHERE a.biz_type = 'CONTRACT' AND a.biz_id = contract_id AND a.attach_type = t) GROUP BY 1""",
)
def payment_missing_docs(p):
    return metrics.missing_vouchers(p.contracts, p.payments, p.attachments, REQUIRED)


@query("payments", "SELECT node_code, status, sign, count(*) AS n, sum(percent)::BIGINT AS percent_sum FROM (SELECT node_code, status, CASE WHEN paid_amount > plan_amount THEN 1 WHEN paid_amount < plan_amount THEN -1 ELSE 0 END::BIGINT AS sign, CASE WHEN plan_amount > 0 THEN round(paid_amount * 100 / plan_amount, 0)::BIGINT END AS percent FROM payments) GROUP BY 1, 2, 3")
def payment_against_plan(p):
    return metrics.payment_against_plan(p.payments)


@query("payments", "SELECT status, count(*) AS n, sum(paid_amount)::DECIMAL(18,2) AS paid FROM payments WHERE contract_id IS NULL GROUP BY 1")
def unbound_payments(p):
    return p.payments.where("contract_id is null").groupBy("status").agg(F.count(F.lit(1)).alias("n"), stats.money("paid_amount").alias("paid"))


@query("projects phases", f"SELECT project_id, id AS phase_id, phase_name, (DATE '{AS_OF}' - plan_finish_date)::BIGINT AS days FROM phases WHERE status IN ('IN_PROGRESS', 'NOT_STARTED') AND plan_finish_date < DATE '{AS_OF}' AND project_id IN (SELECT id FROM leaf) ORDER BY days DESC, phase_id LIMIT 8", LEAF)
def dash_overdue(p):
    return lists.overdue(p.projects, p.phases, AS_OF)


@query("projects phases", f"SELECT project_id, id AS phase_id, phase_name, plan_finish_date FROM phases WHERE status IN ('IN_PROGRESS', 'NOT_STARTED') AND phase_name LIKE '%acceptance%' AND plan_finish_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 60 AND project_id IN (SELECT id FROM leaf) ORDER BY plan_finish_date, phase_id LIMIT 8", LEAF)
def dash_upcoming(p):
    return lists.upcoming_acceptance(p.projects, p.phases, AS_OF, ("First acceptance", "Final acceptance"))


@query("projects phases", "SELECT id AS phase_id, project_id, plan_finish_date FROM phases WHERE status = 'IN_PROGRESS' AND manager_user_id = 7 AND project_id IN (SELECT id FROM leaf)", LEAF)
def dash_todos(p):
    return lists.todos(p.projects, p.phases, 7)


@query("projects", "SELECT id, name, status, create_time FROM projects ORDER BY create_time DESC NULLS LAST, id LIMIT 6")
def dash_recent(p):
    return lists.recent(p.projects)


PAGE = "cond AS (SELECT * FROM projects WHERE parent_id IS NULL AND status IN ('RUN', 'DONE') AND (name LIKE '%A%' OR code LIKE '%A%' OR vendor_name LIKE '%A%'))"


@query("projects", "SELECT id, code, name, status, (SELECT count(*) FROM projects c WHERE c.parent_id = cond.id) AS children, (SELECT count(*) FROM cond) AS total FROM cond ORDER BY create_time DESC NULLS LAST, id LIMIT 5 OFFSET 5", PAGE)
def project_page(p):
    return lists.project_page(p.projects, lists.project_filter("A", "RUN, DONE,,", "x"), 2, 5)


@query("projects", "SELECT id, code, name, status, (SELECT count(*) FROM projects c WHERE c.parent_id = p.id) AS children, (SELECT count(*) FROM projects WHERE parent_id IS NULL) AS total FROM projects p WHERE parent_id IS NULL ORDER BY create_time DESC NULLS LAST, id LIMIT 10 OFFSET 60")
def project_page_middle(p):
    """A page in the middle of all top-level projects: only the range that holds it is sorted."""
    return lists.project_page(p.projects, F.lit(True), 7, 10)


@query("projects", "SELECT id, code, name, status, create_time, (SELECT count(*) FROM projects c WHERE c.parent_id = p.id) AS children FROM projects p WHERE parent_id IS NULL ORDER BY create_time DESC NULLS LAST, id LIMIT 10 OFFSET 10")
def project_page_next(p):
    """The page behind the tenth project, found by its values."""
    first = lists.project_page_after(p.projects, F.lit(True), None, 10).collect()
    return lists.project_page_after(p.projects, F.lit(True), first[-1].asDict() if first else None, 10)


@query("projects", "SELECT id, name FROM projects WHERE year(approve_date) IN (1995, 1997) AND type = 'HW' AND owner_unit = 'BUILDING'")
def project_years(p):
    return p.projects.where(lists.project_filter(years="1995,abc,1997,", owner_unit=" BUILDING ") & lists.in_csv("type", "HW")).select("id", "name")


@query("contracts", "SELECT id, name, contract_type, (contract_amount + change_amount)::DECIMAL(18,2) AS amount FROM contracts ORDER BY CASE WHEN contract_type = 'MAIN' THEN 0 ELSE 1 END, id LIMIT 50")
def contracts_main_first(p):
    return lists.main_first(p.contracts).limit(50).select("id", "name", "contract_type", (F.col("contract_amount") + F.col("change_amount")).cast(stats.RESULT).alias("amount"))


@query("projects attachments", "SELECT up.id AS project_id, a.id AS attachment_id, min(level) > 0 AS shared FROM up JOIN attachments a ON a.biz_type = 'PROJECT' AND a.biz_id = up.anc GROUP BY 1, 2", LEVELS)
def attachments_shared(p):
    return lists.shared_attachments(p.projects, p.attachments)


@query("projects phases links payments attachments", """SELECT a.id AS attachment_id, CASE biz_type WHEN 'PROJECT' THEN (SELECT id FROM projects x WHERE x.id = biz_id) WHEN 'PROJECT_PHASE' THEN (SELECT project_id FROM phases x WHERE x.id = biz_id)
    WHEN 'CONTRACT' THEN (SELECT min(project_id) FROM links x WHERE x.contract_id = biz_id) WHEN 'PAYMENT' THEN (SELECT min(project_id) FROM payments x WHERE x.id = biz_id) END AS project_id FROM attachments a""")
def attachment_project(p):
    return lists.attachment_projects(p.attachments, p.projects, p.phases, p.links, p.payments)


@query("projects contracts links", "SELECT id, name FROM contracts WHERE id NOT IN (SELECT contract_id FROM links WHERE project_id IN (SELECT id FROM projects))")
def orphan_contracts(p):
    return lists.orphan_contracts(p.contracts, p.links, p.projects).select("id", "name")


@query("projects", "SELECT id AS project_id, 'U' || (id % 20)::VARCHAR || CASE WHEN (id + 3) % 50 < 40 THEN ',U' || ((id + 3) % 50)::VARCHAR ELSE '' END AS names FROM projects WHERE member_ids IS NOT NULL")
def project_members(p):
    users = p.spark.range(40).select(F.col("id").alias("user_id"), F.concat(F.lit("U"), F.col("id").cast("string")).alias("user_name"))
    return lists.members(p.projects, users)


def scoped(p) -> ControlledQuery:
    return ControlledQuery(p, SCOPE, AS_OF)


@query(
    "projects phases contracts links payments",
    f"""SELECT s.id, s.name, s.status, coalesce(budget_amount, 0)::DECIMAL(18,2) AS budget, c.contract_amount, y.paid_amount, n.contracts, coalesce(g.progress, 0)::BIGINT AS progress, now.current_phase
    FROM scoped s LEFT JOIN ({rolled("own", "contract_amount")}) c ON c.id = s.id LEFT JOIN ({rolled("paid_own", "paid_amount")}) y ON y.id = s.id LEFT JOIN counted n ON n.id = s.id
    LEFT JOIN (SELECT project_id, (CASE WHEN sum(w) = 0 THEN 0 ELSE floor(sum(x)::DOUBLE / sum(w) + 0.5) END)::BIGINT AS progress FROM (SELECT project_id, CASE status WHEN 'SKIPPED' THEN 0 ELSE weight END AS w, CASE status WHEN 'DONE' THEN weight * 100 WHEN 'IN_PROGRESS' THEN weight * percent ELSE 0 END AS x FROM phases) GROUP BY 1) g ON g.project_id = s.id
    LEFT JOIN now ON now.project_id = s.id WHERE s.type = 'SW' ORDER BY s.id LIMIT 20""",
    # A scoped project's ancestors count only when they are in scope too.
    f"{OWN_CONTRACT}, {OWN_PAID}, {CURRENT}, {SCOPED}, up AS (SELECT id, id AS anc, 0::BIGINT AS level FROM scoped UNION ALL SELECT u.id, q.parent_id, u.level + 1 FROM up u JOIN scoped q ON q.id = u.anc WHERE q.parent_id IS NOT NULL AND u.level < 8), seen AS (SELECT DISTINCT up.id AS project_id, contract_id FROM up JOIN links ON links.project_id = up.anc), {COUNTED}",
)
def cq_projects(p):
    return scoped(p).run("projects", {"type": "sw"})


@query("projects contracts links", "SELECT id, name, contract_type, contract_amount, change_amount FROM contracts WHERE contract_type = 'MAIN' AND id IN (SELECT contract_id FROM seen WHERE project_id IN (SELECT id FROM scoped)) ORDER BY id LIMIT 100", f"{SEEN}, {SCOPED}")
def cq_contracts(p):
    return scoped(p).run("contracts", {"contractType": "main"}, 500)


@query("projects contracts links payments", """SELECT project_id, contract_id, node_code, plan_amount, paid_amount, plan_date, status, (SELECT name FROM projects x WHERE x.id = project_id) AS project_name, (SELECT name FROM contracts x WHERE x.id = contract_id) AS contract_name FROM payments WHERE status = 'PAID' AND (project_id IN (SELECT id FROM scoped) OR contract_id IN (SELECT contract_id FROM seen WHERE project_id IN (SELECT id FROM scoped)))
    ORDER BY contract_id NULLS FIRST, node_code, plan_date, plan_amount, project_id NULLS FIRST, paid_amount LIMIT 100""", f"{SEEN}, {SCOPED}")
def cq_payments(p):
    return scoped(p).run("payments", {"status": "Paid"}, 100)


@query("projects phases attachments", "SELECT project_id, phase_id, n FROM held WHERE project_id IN (SELECT id FROM scoped) ORDER BY 1, 2 LIMIT 100", f"{ATTACHED}, {SCOPED}")
def cq_phase_attachment(p):
    return scoped(p).run("stats", {"kind": "phase_attachment_count"}, 100)


@query("projects", "SELECT type, count(*) AS n FROM sleaf GROUP BY 1", f"{SCOPED}, sleaf AS (SELECT * FROM scoped p WHERE parent_id IS NOT NULL OR NOT EXISTS (SELECT 1 FROM scoped c WHERE c.parent_id = p.id))")
def cq_type_dist(p):
    return scoped(p).run("stats", {"kind": "type_distribution"})


@query("projects contracts links payments", year_sql("sleaf", "INNER"), f"{SCOPED}, sleaf AS (SELECT * FROM scoped p WHERE parent_id IS NOT NULL OR NOT EXISTS (SELECT 1 FROM scoped c WHERE c.parent_id = p.id))")
def cq_year_amount(p):
    return scoped(p).run("stats", {"kind": "year_amount"})
