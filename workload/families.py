"""Table families: customers of each region stand for one monthly regional table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill import Filter, FunctionColumn, Pivot, QuerySpec, Sort
from tablemill.operators.distincts import count_summary, distinct_summary, unite_distinct
from tablemill.operators.families import (
    REGION_CODES, TABLE_PLACEHOLDER, Family, family_distinct, family_of_partitions, family_page, family_total, union_family, union_family_sql,
)
from tablemill.session import materialize, scratch_path
from workload import Case, table_reader
from workload.reports import cents

CASES: dict[str, Case] = {}
FAMILY = Family("jan_2026", REGION_CODES, schema_name=None)
# The same split in SQL: five members in family order.
MEMBERS = """WITH member AS (SELECT customer.*, ['DVVNL', 'PVVNL', 'PUVNL', 'MVVNL', 'KESCO'][n_regionkey + 1] AS region
             FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def members(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with the family region that their own region stands for."""
    read = table_reader(spark, folder)
    codes = F.array(*[F.lit(code) for code in REGION_CODES])
    return (
        read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment",
                F.get(codes, F.col("n_regionkey")).alias("region"))
    )


def register(name: str, sql: str, spec: QuerySpec, family: Family = FAMILY) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return cents(union_family(spec, family, family_of_partitions(members(spark, folder), family, "region")))

    CASES[name] = Case(run, f"{MEMBERS} {sql}")


SHOWN = ("c_custkey", "c_name", "region")
register(
    "family_union", "SELECT c_custkey, c_name, region FROM member WHERE c_acctbal > 1000",
    QuerySpec(table=FAMILY.table("DVVNL"), select=SHOWN, filters=(Filter("c_acctbal", ">", 1000),), limit_rows=0),
)
register(
    "family_branch_limit",
    """SELECT c_custkey, c_name, region FROM member
       QUALIFY ROW_NUMBER() OVER (PARTITION BY region ORDER BY c_acctbal DESC, c_custkey) <= 20""",
    QuerySpec(table=TABLE_PLACEHOLDER, select=SHOWN, sort=(Sort("c_acctbal", "DESC"), Sort("c_custkey")), limit_rows=20),
)
register(
    "family_sorted", "SELECT c_custkey, c_name, region FROM member ORDER BY c_acctbal DESC, c_custkey",
    QuerySpec(table=TABLE_PLACEHOLDER, select=SHOWN, sort=(Sort("c_acctbal", "DESC"), Sort("c_custkey")), limit_rows=0),
)
register(
    "family_grouped",
    "SELECT region, c_mktsegment, COUNT(*) AS n, ROUND(SUM(c_acctbal), 2) AS balance FROM member GROUP BY region, c_mktsegment",
    QuerySpec(table=TABLE_PLACEHOLDER, select=("region", "c_mktsegment"), limit_rows=0, function_columns=(
        FunctionColumn("COUNT", "*", "n"), FunctionColumn("SUM", "c_acctbal", "balance"))),
)
register(
    "family_single", "SELECT c_custkey, c_name, region FROM member WHERE region = 'PUVNL'",
    QuerySpec(table=TABLE_PLACEHOLDER, select=SHOWN, limit_rows=0),
    Family("jan_2026", REGION_CODES, base_region="PUVNL", enabled=False),
)
register(
    "family_report",
    """, r AS (SELECT region, COUNT(c_custkey) FILTER (c_mktsegment = 'AUTOMOBILE') AS a, COUNT(c_custkey) FILTER (c_mktsegment = 'BUILDING') AS b,
              COUNT(c_custkey) FILTER (c_mktsegment = 'FURNITURE') AS f, COUNT(c_custkey) FILTER (c_mktsegment = 'HOUSEHOLD') AS h,
              COUNT(c_custkey) FILTER (c_mktsegment = 'MACHINERY') AS m FROM member GROUP BY region)
       SELECT region, a AS "AUTOMOBILE", b AS "BUILDING", f AS "FURNITURE", h AS "HOUSEHOLD", m AS "MACHINERY" FROM r
       UNION ALL SELECT 'GRAND TOTAL', SUM(a)::BIGINT, SUM(b)::BIGINT, SUM(f)::BIGINT, SUM(h)::BIGINT, SUM(m)::BIGINT FROM r""",
    QuerySpec(table=TABLE_PLACEHOLDER, mode="REPORT", pivot=Pivot("c_custkey", "COUNT", ("region",), ("c_mktsegment",)),
              add_grand_total=True),
)


def _total(spark: SparkSession, folder: str) -> DataFrame:
    spec = QuerySpec(table=TABLE_PLACEHOLDER, filters=(Filter("c_mktsegment", "=", "BUILDING"),), limit_rows=10)
    return family_total(spec, FAMILY, family_of_partitions(members(spark, folder), FAMILY, "region"))


CASES["family_total"] = Case(_total, f"{MEMBERS} SELECT COUNT(*) AS total FROM member WHERE c_mktsegment = 'BUILDING'")


def _distinct(name: str):
    """A column's distinct values over members that are tables of their own, in which the same values recur."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        orders = table_reader(spark, folder)("orders")
        tables = {FAMILY.table(region): orders.filter(F.col("o_orderkey") % len(REGION_CODES) == i) for i, region in enumerate(REGION_CODES)}
        spec = QuerySpec(table=FAMILY.table("KESCO"), select=("o_orderstatus",), limit_rows=0, function_columns=(FunctionColumn("COUNT_DISTINCT", name, "n"),))
        return family_distinct(spec, FAMILY, tables)

    return Case(run, f"SELECT o_orderstatus, COUNT(DISTINCT {name}) AS n FROM orders GROUP BY o_orderstatus")


CASES["family_distinct"] = _distinct("o_custkey")
CASES["family_distinct_text"] = _distinct("o_orderpriority")


def _rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct orders by flag, from stored sets by flag and line state."""
    lines = table_reader(spark, folder)("lineitem")
    stored = materialize(distinct_summary(lines, ["l_returnflag", "l_linestatus"], "l_orderkey"), "sets")
    return count_summary(unite_distinct([stored], ["l_returnflag"]), ["l_returnflag"], "n_orders")


CASES["distinct_rollup"] = Case(_rollup, "SELECT l_returnflag, COUNT(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY l_returnflag")


def _page(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of a page over all members: 20 rows of each, behind its first 5."""
    spec = QuerySpec(table=TABLE_PLACEHOLDER, filters=(Filter("c_mktsegment", "=", "BUILDING"),), sort=(Sort("c_custkey"),), limit_rows=20, offset=5)
    return family_page(spec, FAMILY, family_of_partitions(members(spark, folder), FAMILY, "region")).counts


CASES["family_page"] = Case(_page, f"""{MEMBERS}, sizes AS (SELECT COUNT(*) FILTER (c_mktsegment = 'BUILDING') AS n FROM member GROUP BY region)
    SELECT SUM(n)::BIGINT AS total, SUM(LEAST(20, GREATEST(n - 5, 0)))::BIGINT AS page_rows, MAX(n - 5 >= 20) AS truncated FROM sizes""")


def _payload(spark: SparkSession, folder: str) -> DataFrame:
    """SQL text over the family by specification, with a sort and a total of all members."""
    find = family_of_partitions(members(spark, folder), FAMILY, "region")
    for region in FAMILY.members:
        find(FAMILY.table(region)).createOrReplaceTempView(FAMILY.table(region))
    spec = QuerySpec.from_dict({
        "execution_mode": "sql", "mode": "REPORT", "add_grand_total": True, "limit_rows": 0,
        "sql": "SELECT '{{DISCOM}}' AS discom, c_mktsegment, COUNT(*) AS n FROM {{MASTER_TABLE}} GROUP BY c_mktsegment",
        "sort": [{"column": "discom", "direction": "ASC"}, {"column": "c_mktsegment", "direction": "ASC"}],
    })
    return union_family(spec, FAMILY, spark)


CASES["family_sql_payload"] = Case(_payload, f"""{MEMBERS}, r AS (SELECT region AS discom, c_mktsegment, COUNT(*) AS n FROM member GROUP BY ALL)
    SELECT * FROM r UNION ALL SELECT 'GRAND TOTAL', '', SUM(n)::BIGINT FROM r""")


def _template(spark: SparkSession, folder: str) -> DataFrame:
    find = family_of_partitions(members(spark, folder), FAMILY, "region")
    for region in FAMILY.members:
        find(FAMILY.table(region)).createOrReplaceTempView(FAMILY.table(region))
    text = """SELECT '{{DISCOM}}' AS discom, c_mktsegment, COUNT(*) AS n, ROUND(SUM(c_acctbal), 2) AS balance
              FROM {{MASTER_TABLE}} GROUP BY c_mktsegment;"""
    return union_family_sql(spark, text, FAMILY, order_by=("discom", "c_mktsegment"))


CASES["family_sql_template"] = Case(
    _template,
    f"{MEMBERS} SELECT region AS discom, c_mktsegment, COUNT(*) AS n, ROUND(SUM(c_acctbal), 2) AS balance FROM member GROUP BY ALL",
)


def _named(spark: SparkSession, folder: str) -> DataFrame:
    """The name of a member table within a literal is no table."""
    find = family_of_partitions(members(spark, folder), FAMILY, "region")
    for region in FAMILY.members:
        find(FAMILY.table(region)).createOrReplaceTempView(FAMILY.table(region))
    text = """SELECT 'CM_master_data_feb_2020_KESCO' AS label, '{{DISCOM}}' AS discom, COUNT(*) AS n -- of CM_master_data_feb_2020_KESCO
              FROM CM_master_data_feb_2020_KESCO"""
    return union_family_sql(spark, text, FAMILY)


CASES["family_sql_literal"] = Case(
    _named, f"{MEMBERS} SELECT 'CM_master_data_feb_2020_KESCO' AS label, region AS discom, COUNT(*) AS n FROM member GROUP BY region"
)


def _partitioned(spark: SparkSession, folder: str) -> DataFrame:
    """The family stored as one dataset; each member reads its own partition only."""
    path = scratch_path(spark, "family")
    monthly = members(spark, folder).withColumn("month", F.lit("jan_2026"))
    monthly.write.partitionBy("month", "region").parquet(path)
    family = Family("jan_2026", ("KESCO", "MVVNL"))
    spec = QuerySpec(table=family.table("KESCO"), select=SHOWN, limit_rows=0)
    return union_family(spec, family, family_of_partitions(spark.read.parquet(path), family, "region", "month"))


CASES["family_partitioned"] = Case(
    _partitioned, f"{MEMBERS} SELECT c_custkey, c_name, region FROM member WHERE region IN ('KESCO', 'MVVNL')"
)
