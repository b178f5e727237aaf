"""Reports: grouped aggregates, pivots and grand totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tablemill import Filter, Join, JoinKey, Pivot, QuerySpec, build
from tablemill.operators.totals import with_grand_total
from workload import Case, table_reader

CASES: dict[str, Case] = {}


def register(name: str, sql: str, derive=None, **parts) -> None:
    spec = QuerySpec(mode="REPORT", **parts)

    def run(spark: SparkSession, folder: str) -> DataFrame:
        read = table_reader(spark, folder)
        extra = derive(read) if derive else {}
        return cents(build(spec, lambda table: extra[table] if table in extra else read(table)))

    CASES[name] = Case(run, sql)


def cents(df: DataFrame) -> DataFrame:
    """Doubles to two digits, so that summation order does not show."""
    return df.select([
        F.round(f"`{f.name}`", 2).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


TO_CUSTOMER = Join("customer", (JoinKey("o_custkey", "c_custkey"),))
TO_NATION = Join("nation", (JoinKey("customer.c_nationkey", "n_nationkey"),))

register(
    "report_rows_only",
    'SELECT o_orderpriority, ROUND(SUM(o_totalprice), 2) AS "SUM(o_totalprice)" FROM orders GROUP BY o_orderpriority',
    table="orders", pivot=Pivot("o_totalprice", "SUM", ("o_orderpriority",)),
)
register(
    "report_single_value", 'SELECT MAX(o_totalprice) AS "MAX(o_totalprice)" FROM orders',
    table="orders", pivot=Pivot("o_totalprice", "MAX"),
)
register(
    "report_pivot",
    """SELECT o_orderpriority, ROUND(SUM(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS "F",
              ROUND(SUM(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS "O",
              ROUND(SUM(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS "P" FROM orders GROUP BY o_orderpriority""",
    table="orders", pivot=Pivot("o_totalprice", "SUM", ("o_orderpriority",), ("o_orderstatus",)),
)
register(
    "report_pivot_multi",
    """SELECT l_linenumber,
              COUNT(l_orderkey) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS "l_returnflag=A | l_linestatus=F",
              COUNT(l_orderkey) FILTER (l_returnflag = 'A' AND l_linestatus = 'O') AS "l_returnflag=A | l_linestatus=O",
              COUNT(l_orderkey) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS "l_returnflag=N | l_linestatus=F",
              COUNT(l_orderkey) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS "l_returnflag=N | l_linestatus=O",
              COUNT(l_orderkey) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS "l_returnflag=R | l_linestatus=F",
              COUNT(l_orderkey) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS "l_returnflag=R | l_linestatus=O"
       FROM lineitem GROUP BY l_linenumber""",
    table="lineitem", pivot=Pivot("l_orderkey", "COUNT", ("l_linenumber",), ("l_returnflag", "l_linestatus")),
)
register(
    "report_pivot_null",
    """WITH marked AS (SELECT o_orderpriority, o_totalprice, NULLIF(o_orderstatus, 'O') AS status FROM orders)
       SELECT o_orderpriority, MAX(o_totalprice) FILTER (status = 'F') AS "F", MAX(o_totalprice) FILTER (status = 'P') AS "P",
              MAX(o_totalprice) FILTER (status IS NULL) AS "(null)" FROM marked GROUP BY o_orderpriority""",
    derive=lambda read: {"marked": read("orders").withColumn("status", F.nullif("o_orderstatus", F.lit("O")))},
    table="marked", pivot=Pivot("o_totalprice", "MAX", ("o_orderpriority",), ("status",)),
)
register(
    "report_join",
    """SELECT n_name AS "nation.n_name",
              ROUND(AVG(o_totalprice) FILTER (c_mktsegment = 'AUTOMOBILE'), 2) AS "AUTOMOBILE",
              ROUND(AVG(o_totalprice) FILTER (c_mktsegment = 'BUILDING'), 2) AS "BUILDING",
              ROUND(AVG(o_totalprice) FILTER (c_mktsegment = 'FURNITURE'), 2) AS "FURNITURE",
              ROUND(AVG(o_totalprice) FILTER (c_mktsegment = 'HOUSEHOLD'), 2) AS "HOUSEHOLD",
              ROUND(AVG(o_totalprice) FILTER (c_mktsegment = 'MACHINERY'), 2) AS "MACHINERY"
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       WHERE CAST(o_orderdate AS DATE) >= DATE '1995-01-01' GROUP BY n_name""",
    table="orders", joins=(TO_CUSTOMER, TO_NATION), filters=(Filter("o_orderdate", ">=", "1995-01-01"),),
    pivot=Pivot("o_totalprice", "AVG", ("nation.n_name",), ("customer.c_mktsegment",)),
)
register(
    "report_min_text",
    """SELECT p_brand, MIN(p_name) FILTER (p_size <= 25) AS "small", MIN(p_name) FILTER (p_size > 25) AS "large"
       FROM part GROUP BY p_brand""",
    derive=lambda read: {"sized": read("part").withColumn("band", F.when(F.col("p_size") <= 25, "small").otherwise("large"))},
    table="sized", pivot=Pivot("p_name", "MIN", ("p_brand",), ("band",)),
)
register(
    "report_grand_total",
    """WITH r AS (SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS v FROM lineitem GROUP BY ALL)
       SELECT l_returnflag, l_linestatus, ROUND(v, 2) AS "SUM(l_quantity)" FROM r
       UNION ALL SELECT 'GRAND TOTAL', CASE WHEN COUNT(DISTINCT l_linestatus) = 1 THEN MIN(l_linestatus) ELSE '' END, ROUND(SUM(v), 2) FROM r""",
    table="lineitem", pivot=Pivot("l_quantity", "SUM", ("l_returnflag", "l_linestatus")), add_grand_total=True,
)
register(
    "report_pivot_total",
    """WITH r AS (SELECT o_orderpriority, AVG(o_totalprice) FILTER (o_orderstatus = 'F') AS f,
                         AVG(o_totalprice) FILTER (o_orderstatus = 'O') AS o, AVG(o_totalprice) FILTER (o_orderstatus = 'P') AS p
                  FROM orders GROUP BY o_orderpriority)
       SELECT o_orderpriority, ROUND(f, 2) AS "F", ROUND(o, 2) AS "O", ROUND(p, 2) AS "P" FROM r
       UNION ALL SELECT 'GRAND TOTAL', ROUND(SUM(f), 2), ROUND(SUM(o), 2), ROUND(SUM(p), 2) FROM r""",
    table="orders", pivot=Pivot("o_totalprice", "AVG", ("o_orderpriority",), ("o_orderstatus",)), add_grand_total=True,
)


def _labelled_total(spark: SparkSession, folder: str) -> DataFrame:
    """A total whose label column is found by name and whose other text column is constant."""
    people = table_reader(spark, folder)("customer")
    rows = people.groupBy(F.lit("all").alias("scope"), F.col("c_mktsegment").alias("DISCOM"), "c_nationkey").agg(
        F.count(F.lit(1)).alias("n")
    )
    return with_grand_total(rows)


CASES["grand_total_label"] = Case(
    _labelled_total,
    """WITH r AS (SELECT 'all' AS scope, c_mktsegment AS "DISCOM", c_nationkey, COUNT(*) AS n FROM customer GROUP BY ALL)
       SELECT scope, "DISCOM", CAST(c_nationkey AS BIGINT) AS c_nationkey, n FROM r
       UNION ALL SELECT 'all', 'GRAND TOTAL', CAST(SUM(c_nationkey) AS BIGINT), CAST(SUM(n) AS BIGINT) FROM r""",
)


def _sql_total(spark: SparkSession, folder: str) -> DataFrame:
    """A grand total below an ordered SQL text over every line item."""
    table_reader(spark, folder)("lineitem").createOrReplaceTempView("report_lines")
    text = "SELECT CONCAT('L', l_orderkey) AS line, l_linenumber AS number, l_partkey FROM report_lines ORDER BY l_partkey, l_orderkey, l_linenumber"
    return build(QuerySpec.from_dict({"execution_mode": "sql", "mode": "REPORT", "add_grand_total": True, "sql": text}), spark)


CASES["sql_report_total"] = Case(_sql_total, """SELECT 'L' || l_orderkey AS line, l_linenumber::BIGINT AS number, l_partkey::BIGINT AS l_partkey FROM lineitem
    UNION ALL SELECT 'GRAND TOTAL', SUM(l_linenumber)::BIGINT, SUM(l_partkey)::BIGINT FROM lineitem""")
