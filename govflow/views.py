"""Portfolio entities as views over the driver's star-schema tables.

Each function gives one entity with the columns of its model; deterministic rules on the keys supply statuses, missing
values and logically deleted rows. ``live`` drops the latter. Reads are pruned to the columns that a query uses.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Containers (nations) have ids above those of leaf projects (customers).
CONTAINER_BASE = 1_000_000
MONEY = "decimal(15,2)"
PHASE_NAMES = ("Initiation", "Tender", "Build", "First acceptance", "Final acceptance", "Operation")
OWNER_KINDS = ("PROJECT", "PROJECT_PHASE", "CONTRACT", "PAYMENT")


def live(df: DataFrame) -> DataFrame:
    """Rows that are not logically deleted."""
    return df.where("deleted = 0").drop("deleted")


def pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


class Portfolio:
    """The entities over the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def all_projects(self) -> DataFrame:
        """Containers and leaves, with deleted ones."""
        dates = self.table("orders").groupBy("o_custkey").agg(
            F.to_date(F.min("o_orderdate")).alias("first"), F.to_timestamp_ntz(F.max("o_orderdate").cast("string")).alias("last"), F.min("o_orderkey").alias("contract")
        )
        k = F.col("c_custkey")
        leaves = self.table("customer").join(dates, F.col("o_custkey") == k, "left").select(
            k.alias("id"),
            F.when(k % 10 != 0, F.col("c_nationkey").cast("long") + CONTAINER_BASE).alias("parent_id"),
            F.concat(F.lit("P-"), (k % 7 + 1992).cast("string"), F.lit("-"), k.cast("string")).alias("code"),
            F.col("c_name").alias("name"),
            F.when(k % 2 == 0, "HW").otherwise("SW").alias("type"),
            pick(k % 4, ("RUN", "DONE", "PAUSE", "STOP")).alias("status"),
            F.when(k % 13 != 0, F.col("c_acctbal").cast(MONEY)).alias("budget_amount"),
            F.when(k % 5 != 0, (F.col("c_acctbal").cast(MONEY) * 2).cast(MONEY)).alias("contract_amount"),
            ((k % 5 - 2) * 10).cast(MONEY).alias("change_amount"),
            F.when(k % 7 != 0, F.col("contract")).alias("contract_id"),
            F.when(k % 11 != 0, F.col("first")).alias("approve_date"),
            F.col("last").alias("create_time"),
            F.col("c_mktsegment").alias("owner_unit"),
            F.concat(F.lit("V"), F.col("c_nationkey").cast("string")).alias("vendor_name"),
            (k % 20).alias("manager_user_id"),
            F.concat_ws(",", (k % 20).cast("string"), F.lit(" x "), ((k + 3) % 50).cast("string")).alias("member_ids"),
            (k % 17 == 0).cast("int").alias("deleted"),
        )
        none = lambda kind: F.lit(None).cast(kind)
        containers = self.table("nation").select(
            (F.col("n_nationkey").cast("long") + CONTAINER_BASE).alias("id"),
            none("long").alias("parent_id"),
            F.concat(F.lit("N-"), F.col("n_nationkey").cast("string")).alias("code"),
            F.col("n_name").alias("name"),
            F.lit("SW").alias("type"),
            F.lit("RUN").alias("status"),
            none(MONEY).alias("budget_amount"),
            none(MONEY).alias("contract_amount"),
            none(MONEY).alias("change_amount"),
            none("long").alias("contract_id"),
            none("date").alias("approve_date"),
            none("timestamp_ntz").alias("create_time"),
            none("string").alias("owner_unit"),
            none("string").alias("vendor_name"),
            none("long").alias("manager_user_id"),
            none("string").alias("member_ids"),
            F.lit(0).alias("deleted"),
        )
        return leaves.unionByName(containers)

    @cached_property
    def projects(self) -> DataFrame:
        return live(self.all_projects)

    @cached_property
    def phases(self) -> DataFrame:
        k = F.col("o_orderkey")
        closed = F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "P", "IN_PROGRESS").otherwise("NOT_STARTED")
        return self.table("orders").select(
            k.alias("id"),
            F.col("o_custkey").alias("project_id"),
            pick(k % 6, PHASE_NAMES).alias("phase_name"),
            k.alias("sort_no"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("weight"),
            F.when(k % 9 == 0, "SKIPPED").otherwise(closed).alias("status"),
            (k % 101).cast("int").alias("percent"),
            F.date_add(F.to_date("o_orderdate"), 60).alias("plan_finish_date"),
            (F.col("o_custkey") % 20).alias("manager_user_id"),
        )

    @cached_property
    def contracts(self) -> DataFrame:
        k = F.col("o_orderkey")
        return live(
            self.table("orders").select(
                k.alias("id"),
                F.concat(F.lit("C"), k.cast("string")).alias("name"),
                F.when(k % 3 == 0, "MAIN").otherwise("SUB").alias("contract_type"),
                F.col("o_totalprice").cast(MONEY).alias("contract_amount"),
                ((k % 5 - 2) * 100).cast(MONEY).alias("change_amount"),
                F.to_date("o_orderdate").alias("sign_date"),
                F.year("o_orderdate").cast("long").alias("create_year"),
                (k % 19 == 0).cast("int").alias("deleted"),
            )
        )

    @cached_property
    def links(self) -> DataFrame:
        """project_id, contract_id; the bridge has no logical deletion."""
        orders = self.table("orders").select("o_custkey", "o_orderkey")
        own = orders.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("contract_id"))
        shared = orders.where("o_orderkey % 50 = 0").join(self.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        return own.union(shared.select((F.col("c_nationkey").cast("long") + CONTAINER_BASE).alias("project_id"), F.col("o_orderkey").alias("contract_id")))

    @cached_property
    def payments(self) -> DataFrame:
        share = F.when(F.col("l_returnflag") == "R", F.lit(1).cast("decimal(3,1)")).when(F.col("l_returnflag") == "A", F.lit(0.5).cast("decimal(3,1)")).otherwise(F.lit(0).cast("decimal(3,1)"))
        status = F.when(F.col("l_returnflag") == "R", "PAID").when(F.col("l_returnflag") == "A", "PART").otherwise("UNPAID")
        plan = F.col("l_extendedprice").cast(MONEY)
        lines = self.table("lineitem").join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        return lines.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"),
            F.when(F.col("l_linenumber") != 1, F.col("o_custkey")).alias("project_id"),
            F.when(F.col("l_linenumber") != 2, F.col("l_orderkey")).alias("contract_id"),
            F.concat(F.lit("N"), F.col("l_linenumber").cast("string")).alias("node_code"),
            plan.alias("plan_amount"),
            (plan * share).cast(MONEY).alias("paid_amount"),
            F.to_date("l_shipdate").alias("plan_date"),
            status.alias("status"),
        )

    @cached_property
    def attachments(self) -> DataFrame:
        k = F.col("doc_id")
        return live(
            self.table("documents").select(
                k.alias("id"),
                pick(k % 4, OWNER_KINDS).alias("biz_type"),
                (k % 100).alias("biz_id"),
                F.concat(F.lit("doc_"), k.cast("string"), F.lit(".txt")).alias("file_name"),
                pick(k % 3, ("PLAN", "VOUCHER", "REPORT")).alias("attach_type"),
                k.cast("string").alias("ai_doc_id"),
                (k % 7 == 0).cast("int").alias("deleted"),
            )
        )


#: The same entities as DuckDB common table expressions, for the checking SQL.
ORACLE_VIEWS = {
    "all_projects": """
        SELECT c_custkey AS id, CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey::BIGINT + 1000000 END AS parent_id,
               'P-' || (c_custkey % 7 + 1992)::VARCHAR || '-' || c_custkey::VARCHAR AS code, c_name AS name,
               CASE WHEN c_custkey % 2 = 0 THEN 'HW' ELSE 'SW' END AS type,
               ['RUN', 'DONE', 'PAUSE', 'STOP'][c_custkey % 4 + 1] AS status,
               CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal::DECIMAL(15,2) END AS budget_amount,
               CASE WHEN c_custkey % 5 <> 0 THEN (c_acctbal::DECIMAL(15,2) * 2)::DECIMAL(15,2) END AS contract_amount,
               ((c_custkey % 5 - 2) * 10)::DECIMAL(15,2) AS change_amount,
               CASE WHEN c_custkey % 7 <> 0 THEN contract END AS contract_id,
               CASE WHEN c_custkey % 11 <> 0 THEN first_day END AS approve_date, last_time AS create_time,
               c_mktsegment AS owner_unit, 'V' || c_nationkey::VARCHAR AS vendor_name, c_custkey % 20 AS manager_user_id,
               concat_ws(',', (c_custkey % 20)::VARCHAR, ' x ', ((c_custkey + 3) % 50)::VARCHAR) AS member_ids,
               (c_custkey % 17 = 0)::INT AS deleted
        FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate)::DATE AS first_day, max(o_orderdate) AS last_time, min(o_orderkey) AS contract FROM orders GROUP BY 1) ON o_custkey = c_custkey
        UNION ALL
        SELECT n_nationkey::BIGINT + 1000000, NULL, 'N-' || n_nationkey::VARCHAR, n_name, 'SW', 'RUN', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0 FROM nation""",
    "projects": "SELECT * FROM all_projects WHERE deleted = 0",
    "phases": """
        SELECT o_orderkey AS id, o_custkey AS project_id,
               ['Initiation', 'Tender', 'Build', 'First acceptance', 'Final acceptance', 'Operation'][o_orderkey % 6 + 1] AS phase_name,
               o_orderkey AS sort_no, substring(o_orderpriority, 1, 1)::INT AS weight,
               CASE WHEN o_orderkey % 9 = 0 THEN 'SKIPPED' WHEN o_orderstatus = 'F' THEN 'DONE' WHEN o_orderstatus = 'P' THEN 'IN_PROGRESS' ELSE 'NOT_STARTED' END AS status,
               (o_orderkey % 101)::INT AS percent, o_orderdate::DATE + 60 AS plan_finish_date, o_custkey % 20 AS manager_user_id
        FROM orders""",
    "contracts": """
        SELECT o_orderkey AS id, 'C' || o_orderkey::VARCHAR AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'MAIN' ELSE 'SUB' END AS contract_type,
               o_totalprice::DECIMAL(15,2) AS contract_amount, ((o_orderkey % 5 - 2) * 100)::DECIMAL(15,2) AS change_amount,
               o_orderdate::DATE AS sign_date, year(o_orderdate)::BIGINT AS create_year
        FROM orders WHERE o_orderkey % 19 <> 0""",
    "links": """
        SELECT o_custkey AS project_id, o_orderkey AS contract_id FROM orders
        UNION ALL SELECT c_nationkey::BIGINT + 1000000, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 50 = 0""",
    "payments": """
        SELECT (l_orderkey * 10 + l_linenumber)::BIGINT AS id, CASE WHEN l_linenumber <> 1 THEN o_custkey END AS project_id, CASE WHEN l_linenumber <> 2 THEN l_orderkey END AS contract_id,
               'N' || l_linenumber::VARCHAR AS node_code, l_extendedprice::DECIMAL(15,2) AS plan_amount,
               (l_extendedprice::DECIMAL(15,2) * CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.5 ELSE 0.0 END)::DECIMAL(15,2) AS paid_amount,
               l_shipdate::DATE AS plan_date, CASE l_returnflag WHEN 'R' THEN 'PAID' WHEN 'A' THEN 'PART' ELSE 'UNPAID' END AS status
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "attachments": """
        SELECT doc_id AS id, ['PROJECT', 'PROJECT_PHASE', 'CONTRACT', 'PAYMENT'][doc_id % 4 + 1] AS biz_type, doc_id % 100 AS biz_id,
               'doc_' || doc_id::VARCHAR || '.txt' AS file_name, ['PLAN', 'VOUCHER', 'REPORT'][doc_id % 3 + 1] AS attach_type, doc_id::VARCHAR AS ai_doc_id
        FROM documents WHERE doc_id % 7 <> 0""",
}


def oracle(names: str, body: str, more: str = "") -> str:
    """``body`` behind the named views (and those that they need), and further CTEs in ``more``."""
    wanted = names.split()
    if "projects" in wanted and "all_projects" not in wanted:
        wanted.insert(0, "all_projects")
    ctes = [f"{n} AS ({ORACLE_VIEWS[n]})" for n in wanted] + ([more] if more else [])
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body
