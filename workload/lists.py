"""List queries: projections, filters, joins, aggregates, sorting and paging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill import (
    Aggregate, Branch, CaseColumn, Filter, FunctionColumn, Join, JoinKey, QuerySpec, Sort,
    build, fetch_page, run_sql,
)
from tablemill.operators.joins import equi_join
from tablemill.operators.shadows import with_shadows
from tablemill.session import materialize
from workload import Case, table_reader

CASES: dict[str, Case] = {}
Derive = Callable[[Callable[[str], DataFrame]], dict[str, DataFrame]]


def plain(df: DataFrame) -> DataFrame:
    """Qualified names without their table."""
    return df.toDF(*[c.rsplit(".", 1)[-1] for c in df.columns])


def rounded(df: DataFrame, *names: str, digits: int = 2) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])


def register(
    name: str, sql: str, spec: QuerySpec, derive: Derive | None = None, short: bool = True,
    money: tuple[str, ...] = (),
) -> None:
    """Register a specification; ``derive`` adds tables made from the given ones."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        read = table_reader(spark, folder)
        extra = derive(read) if derive else {}
        df = build(spec, lambda table: extra[table] if table in extra else read(table))
        df = plain(df) if short else df
        return rounded(df, *money) if money else df

    CASES[name] = Case(run, sql)


def everything(table: str, **parts) -> QuerySpec:
    """A specification without a row limit."""
    return QuerySpec(table=table, limit_rows=0, **parts)


def key(left: str, right: str) -> tuple[JoinKey, ...]:
    return (JoinKey(left, right),)


TO_CUSTOMER = Join("customer", key("o_custkey", "c_custkey"))

# Projections -------------------------------------------------------------------------

register(
    "list_select",
    """SELECT c_custkey, c_name, c_mktsegment,
              CASE WHEN c_acctbal < 0 THEN 'debit' ELSE 'credit' END AS side,
              COALESCE(c_name, c_mktsegment) AS shown
       FROM customer""",
    everything(
        "customer", select=("c_custkey", "c_name", "c_mktsegment"),
        case_expressions=(CaseColumn("side", (Branch("c_acctbal", "<", 0, "debit"),), "credit"),),
        function_columns=(FunctionColumn("COALESCE", "c_name", "shown", "c_mktsegment"),),
    ),
)
register("list_star", "SELECT * FROM part", everything("part"))
register(
    "join_star", "SELECT customer.*, nation.* FROM customer JOIN nation ON c_nationkey = n_nationkey",
    everything("customer", joins=(Join("nation", key("c_nationkey", "n_nationkey")),)),
)
register(
    "join_qualified_names",
    """SELECT o_orderkey AS "orders.o_orderkey", c_name AS "customer.c_name"
       FROM orders JOIN customer ON o_custkey = c_custkey""",
    everything("orders", select=("orders.o_orderkey", "customer.c_name"), joins=(TO_CUSTOMER,)),
    short=False,
)
register(
    "case_row",
    """SELECT o_orderkey,
              CASE WHEN o_orderpriority LIKE '1%' THEN 'first' WHEN o_orderstatus IN ('F', 'O') THEN o_orderpriority
                   WHEN o_totalprice BETWEEN 1000 AND 50000 THEN 'middle' ELSE o_orderstatus END AS grade,
              CASE WHEN CAST(o_orderdate AS DATE) >= DATE '1996-01-01' THEN o_totalprice ELSE o_custkey END AS amount
       FROM orders""",
    everything(
        "orders", select=("o_orderkey",),
        case_expressions=(
            CaseColumn("grade", (
                Branch("o_orderpriority", "LIKE", "1%", "first"),
                Branch("o_orderstatus", "IN", "F, O", "o_orderpriority", "column"),
                Branch("o_totalprice", "BETWEEN", "1000, 50000", "middle"),
                Branch("", "=", "", "ignored"),
            ), "o_orderstatus", "column"),
            CaseColumn("amount", (Branch("o_orderdate", ">=", "1996-01-01", "o_totalprice", "column"),), "o_custkey", "column"),
            CaseColumn("", (Branch("o_orderkey", "=", 1, "ignored"),)),
        ),
    ),
)
register(
    "coalesce_cols",
    """SELECT c_custkey, COALESCE(s_name, c_mktsegment) AS label, COALESCE(s_suppkey, NULL) AS single
       FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""",
    everything(
        "customer", select=("c_custkey",), joins=(Join("supplier", key("c_custkey", "s_suppkey"), "LEFT"),),
        function_columns=(
            FunctionColumn("COALESCE", "supplier.s_name", "label", "customer.c_mktsegment"),
            FunctionColumn("COALESCE", "supplier.s_suppkey", "single"),
        ),
    ),
)

# Filters -----------------------------------------------------------------------------

register(
    "filter_eq_ne", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey != 5",
    everything("customer", filters=(Filter("c_mktsegment", "=", "BUILDING"), Filter("c_nationkey", "!=", "5"))),
)
register(
    "filter_compare",
    """SELECT * FROM part WHERE TRY_CAST(p_size AS DOUBLE) > 10.5 AND TRY_CAST(p_size AS DOUBLE) <= 40
       AND TRY_CAST(p_retailprice AS DOUBLE) >= 905.25 AND TRY_CAST(p_retailprice AS DOUBLE) < 1500 AND p_brand > 'Brand#2'""",
    everything("part", filters=(
        Filter("p_size", ">", "10.5"), Filter("p_size", "<=", 40), Filter("p_retailprice", ">=", "905.25"),
        Filter("p_retailprice", "<", 1500), Filter("p_brand", ">", "Brand#2"),
    )),
)
register(
    "filter_like", "SELECT * FROM part WHERE p_type LIKE '%A%_E%' AND p_name NOT LIKE '%e'",
    everything("part", filters=(Filter("p_type", "LIKE", "%A%_E%"), Filter("p_name", "NOT LIKE", "%e"))),
)
register(
    "filter_in",
    """SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
       AND c_nationkey NOT IN (1, 2, 3) AND c_custkey NOT IN (10, 11)""",
    everything("customer", filters=(
        Filter("c_mktsegment", "IN", "BUILDING, MACHINERY,"), Filter("c_nationkey", "NOT IN", [1, 2, None, 3]),
        Filter("c_custkey", "NOT IN", "10,11"),
    )),
)
register(
    "filter_between",
    """SELECT * FROM part WHERE p_size BETWEEN 5 AND 30 AND p_retailprice NOT BETWEEN 950.5 AND 1000
       AND p_brand BETWEEN 'Brand#1' AND 'Brand#4'""",
    everything("part", filters=(
        Filter("p_size", "BETWEEN", "5,30"), Filter("p_retailprice", "NOT BETWEEN", (950.5, 1000)),
        Filter("p_brand", "BETWEEN", "Brand#1, Brand#4"),
    )),
)
register(
    "filter_null",
    """SELECT s_suppkey, s_name FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey
       WHERE c_name IS NULL AND s_name IS NOT NULL""",
    everything(
        "supplier", select=("s_suppkey", "s_name"),
        joins=(Join("customer", (JoinKey("s_suppkey", "c_custkey"), JoinKey("s_nationkey", "c_nationkey")), "LEFT"),),
        filters=(Filter("customer.c_name", "IS NULL"), Filter("s_name", "IS NOT NULL", "ignored")),
    ),
)
register(
    "filter_text",
    """SELECT * FROM part WHERE contains(p_type, 'A') AND NOT contains(p_name, '_%') AND starts_with(p_brand, 'Brand#')
       AND NOT contains(p_brand, '3') AND ends_with(p_brand, '2')""",
    everything("part", filters=(
        Filter("p_type", "CONTAINS", "A"), Filter("p_name", "NOT CONTAINS", "_%"), Filter("p_brand", "STARTS WITH", "Brand#"),
        Filter("p_brand", "NOT CONTAINS", "3"), Filter("p_brand", "ENDS WITH", "2"),
    )),
)
register(
    "filter_numeric_text",
    """WITH priced AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN '' WHEN 2 THEN ' ' || CAST(p_size AS VARCHAR) || ' '
                              ELSE CAST(p_size AS VARCHAR) || '.5' END AS price FROM part)
       SELECT * FROM priced WHERE TRY_CAST(price AS DOUBLE) > 12 AND TRY_CAST(price AS DOUBLE) BETWEEN 13 AND 45.5""",
    everything("priced", filters=(Filter("price", ">", "12"), Filter("price", "BETWEEN", "13, 45.5"))),
    lambda read: {"priced": read("part").select(
        "p_partkey",
        F.when(F.col("p_size") % 4 == 0, "n/a").when(F.col("p_size") % 4 == 1, "")
        .when(F.col("p_size") % 4 == 2, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")))
        .otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5"))).alias("price"),
    )},
)
register(
    "filter_numeric_shadow",
    """WITH priced AS (SELECT p_partkey, p_name, CASE p_size % 4 WHEN 0 THEN 'n/a' ELSE CAST(p_retailprice AS VARCHAR) END AS price FROM part)
       SELECT p_partkey, p_name, price FROM priced WHERE TRY_CAST(price AS DOUBLE) >= 910 AND TRY_CAST(price AS DOUBLE) NOT BETWEEN 920 AND 950""",
    everything("priced", filters=(Filter("price", ">=", "910"), Filter("price", "NOT BETWEEN", "920, 950"))),
    lambda read: {"priced": materialize(with_shadows(read("part").select(
        "p_partkey", "p_name", F.when(F.col("p_size") % 4 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string")).alias("price")), ["price"]), "priced")},
)
register(
    "filter_date_native",
    """SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1995-03-01'
       AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND CAST(o_orderdate AS DATE) != DATE '1995-06-17'
       AND CAST(o_orderdate AS DATE) NOT IN (DATE '1995-07-01', DATE '1996-07-01') AND CAST(o_orderdate AS DATE) < DATE '1996-12-30'""",
    everything("orders", select=("o_orderkey", "o_custkey"), filters=(
        Filter("o_orderdate", ">=", "1995-03-01"), Filter("o_orderdate", "BETWEEN", "1995-01-01,1996-12-31"),
        Filter("o_orderdate", "!=", "1995-06-17"), Filter("o_orderdate", "NOT IN", "1995-07-01, 1996-07-01"),
        Filter("o_orderdate", "<", "1996-12-30"),
    )),
)
DATE_TEXTS = ("dd-MMM-yyyy", "d-MMMM-yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")
register(
    "filter_date_text",
    """WITH dated AS (SELECT o_orderkey, CASE o_orderkey % 6
            WHEN 0 THEN upper(strftime(o_orderdate, '%d-%b-%Y')) WHEN 1 THEN strftime(o_orderdate, '%-d-%B-%Y')
            WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d')
            WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE 'unknown' END AS bill_date FROM orders),
       parsed AS (SELECT *, COALESCE(TRY_CAST(bill_date AS DATE),
            CAST(TRY_STRPTIME(bill_date, '%d-%b-%Y') AS DATE), CAST(TRY_STRPTIME(bill_date, '%d-%B-%Y') AS DATE),
            CAST(TRY_STRPTIME(bill_date, '%d-%m-%Y') AS DATE), CAST(TRY_STRPTIME(bill_date, '%Y-%m-%d') AS DATE)) AS d FROM dated)
       SELECT o_orderkey, bill_date FROM parsed WHERE d >= DATE '1994-05-10' AND d NOT BETWEEN DATE '1996-02-01' AND DATE '1996-05-31'
       AND d != DATE '1995-01-01' AND bill_date IS NOT NULL""",
    everything("dated", filters=(
        Filter("bill_date", ">=", "1994-05-10"), Filter("bill_date", "NOT BETWEEN", ("1996-02-01", "1996-05-31")),
        Filter("bill_date", "!=", "1995-01-01"), Filter("bill_date", "IS NOT NULL"),
    )),
    lambda read: {"dated": materialize(with_shadows(read("orders").select("o_orderkey", _date_text().alias("bill_date"))), "dated")},
)
register(
    "filter_date_parsed",
    """WITH dated AS (SELECT o_orderkey, CASE o_orderkey % 6
            WHEN 0 THEN upper(strftime(o_orderdate, '%d-%b-%Y')) WHEN 1 THEN strftime(o_orderdate, '%-d-%B-%Y')
            WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d')
            WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE 'unknown' END AS bill_date FROM orders),
       parsed AS (SELECT *, COALESCE(TRY_CAST(bill_date AS DATE),
            CAST(TRY_STRPTIME(bill_date, '%d-%b-%Y') AS DATE), CAST(TRY_STRPTIME(bill_date, '%d-%B-%Y') AS DATE),
            CAST(TRY_STRPTIME(bill_date, '%d-%m-%Y') AS DATE), CAST(TRY_STRPTIME(bill_date, '%Y-%m-%d') AS DATE)) AS d FROM dated)
       SELECT o_orderkey, bill_date FROM parsed WHERE d >= DATE '1994-05-10' AND d NOT BETWEEN DATE '1996-02-01' AND DATE '1996-05-31'
       AND d != DATE '1995-01-01' AND bill_date IS NOT NULL""",
    everything("dated", filters=(
        Filter("bill_date", ">=", "1994-05-10"), Filter("bill_date", "NOT BETWEEN", ("1996-02-01", "1996-05-31")),
        Filter("bill_date", "!=", "1995-01-01"), Filter("bill_date", "IS NOT NULL"),
    )),
    lambda read: {"dated": read("orders").select("o_orderkey", _date_text().alias("bill_date"))},
)


def _date_text():
    texts = [F.date_format("o_orderdate", layout) for layout in DATE_TEXTS]
    texts[0] = F.upper(texts[0])
    chain = F.when(F.col("o_orderkey") % 6 == 0, texts[0])
    for i, text in enumerate(texts[1:], start=1):
        chain = chain.when(F.col("o_orderkey") % 6 == i, text)
    return chain.otherwise("unknown")


register(
    "filter_other_types",
    """WITH typed AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(12, 2)) AS price, l_tax > 0.04 AS taxed,
                             CAST(l_shipdate AS DATE) AS shipdate FROM lineitem)
       SELECT l_orderkey, l_linenumber FROM typed WHERE price >= 20000.5 AND price NOT BETWEEN 30000 AND 40000 AND taxed = TRUE
       AND shipdate > DATE '1995-01-01' AND shipdate IS NOT NULL""",
    everything("typed", select=("l_orderkey", "l_linenumber"), filters=(
        Filter("price", ">=", "20000.5"), Filter("price", "NOT BETWEEN", "30000, 40000"), Filter("taxed", "=", "true"),
        Filter("shipdate", ">", "1995-01-01"), Filter("shipdate", "IS NOT NULL"),
    )),
    lambda read: {"typed": read("lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
        (F.col("l_tax") > 0.04).alias("taxed"), F.col("l_shipdate").cast("date").alias("shipdate"))},
)

# Joins -------------------------------------------------------------------------------

register(
    "join_inner",
    "SELECT o_orderkey, o_orderstatus, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
    everything("orders", select=("o_orderkey", "o_orderstatus", "customer.c_name", "customer.c_mktsegment"), joins=(TO_CUSTOMER,)),
)
register(
    "join_left",
    "SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    everything("customer", select=("c_custkey", "c_name", "orders.o_orderkey"),
               joins=(Join("orders", key("c_custkey", "o_custkey"), "LEFT"),)),
)
register(
    "join_left_unmatched",
    "SELECT p_partkey, p_name, s_name FROM part LEFT JOIN supplier ON p_partkey = s_suppkey",
    everything("part", select=("p_partkey", "p_name", "supplier.s_name"), joins=(Join("supplier", key("p_partkey", "s_suppkey"), "LEFT"),)),
)
register(
    "join_right",
    "SELECT o_orderkey, c_custkey, c_name FROM orders RIGHT JOIN customer ON o_custkey = c_custkey",
    everything("orders", select=("o_orderkey", "customer.c_custkey", "customer.c_name"),
               joins=(Join("customer", key("o_custkey", "c_custkey"), "RIGHT"),)),
)
register(
    "join_multi_key",
    """SELECT l_orderkey, l_linenumber, c_custkey, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey""",
    everything(
        "lineitem", select=("l_orderkey", "l_linenumber", "customer.c_custkey", "supplier.s_name"),
        joins=(
            Join("orders", key("l_orderkey", "o_orderkey")), Join("customer", key("orders.o_custkey", "c_custkey")),
            Join("supplier", (JoinKey("l_suppkey", "s_suppkey"), JoinKey("customer.c_nationkey", "supplier.s_nationkey")), "LEFT"),
        ),
    ),
)
register(
    "join_chain",
    """SELECT n_name, r_name, ROUND(SUM(l_extendedprice), 2) AS revenue, COUNT(*) AS lines
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""",
    everything(
        "lineitem", select=("nation.n_name", "region.r_name"),
        joins=(
            Join("orders", key("l_orderkey", "o_orderkey")), Join("customer", key("orders.o_custkey", "c_custkey")),
            Join("nation", key("customer.c_nationkey", "n_nationkey")),
            Join("region", key("nation.n_regionkey", "r_regionkey"), "LEFT"),
        ),
        function_columns=(FunctionColumn("SUM", "l_extendedprice", "revenue"), FunctionColumn("COUNT", "*", "lines")),
    ),
    money=("revenue",),
)
register(
    "join_self_alias",
    """SELECT s_suppkey, a.n_name AS home, b.n_name AS same_region FROM supplier JOIN nation a ON s_nationkey = a.n_nationkey
       JOIN nation b ON a.n_regionkey = b.n_regionkey""",
    everything(
        "supplier", select=("s_suppkey",),
        joins=(Join("nation", key("s_nationkey", "home.n_nationkey"), alias="home"),
               Join("nation", key("home.n_regionkey", "n_regionkey"), alias="peer")),
        function_columns=(FunctionColumn("COALESCE", "home.n_name", "home"), FunctionColumn("COALESCE", "peer.n_name", "same_region")),
    ),
)


def _split_join(how: str):
    """The balanced form of an outer join whose optional side is the large one."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        read = table_reader(spark, folder)
        parts = read("part").select("p_partkey", "p_name")
        lines = read("lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
        if how == "left":
            return equi_join(parts, lines, [("p_partkey", "l_partkey")], "left", split=True)
        return equi_join(lines, parts, [("l_partkey", "p_partkey")], "right", split=True)

    return run


LARGE = "(SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem)"
CASES["join_left_split"] = Case(
    _split_join("left"), f"SELECT p_partkey, p_name, l.* FROM part LEFT JOIN {LARGE} l ON p_partkey = l_partkey"
)
CASES["join_right_split"] = Case(
    _split_join("right"), f"SELECT l.*, p_partkey, p_name FROM {LARGE} l RIGHT JOIN part ON p_partkey = l_partkey"
)

# Aggregates --------------------------------------------------------------------------

register(
    "agg_functions",
    """SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, COUNT(l_tax) AS n_tax, COUNT(*) AS n,
              ROUND(AVG(l_extendedprice), 2) AS avg_price, MIN(l_discount) AS low, MAX(l_extendedprice) AS high
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    everything("lineitem", select=("l_returnflag", "l_linestatus"), function_columns=(
        FunctionColumn("SUM", "l_quantity", "sum_qty"), FunctionColumn("COUNT", "l_tax", "n_tax"),
        FunctionColumn("COUNT", "*", "n"), FunctionColumn("AVG", "l_extendedprice", "avg_price"),
        FunctionColumn("MIN", "l_discount", "low"), FunctionColumn("MAX", "l_extendedprice", "high"),
    )),
    money=("sum_qty", "avg_price"),
)
register(
    "agg_count_distinct",
    """SELECT l_returnflag, COUNT(DISTINCT l_orderkey) AS n_orders, COUNT(DISTINCT l_partkey) AS n_parts
       FROM lineitem GROUP BY l_returnflag""",
    everything("lineitem", select=("l_returnflag",), function_columns=(
        FunctionColumn("COUNT_DISTINCT", "l_orderkey", "n_orders"), FunctionColumn("COUNT_DISTINCT", "l_partkey", "n_parts"),
    )),
)
register(
    "agg_case",
    """SELECT l_linestatus,
              ROUND(SUM(CASE WHEN l_returnflag = 'R' THEN TRY_CAST(l_extendedprice AS DOUBLE) ELSE TRY_CAST('0' AS DOUBLE) END), 2) AS returned,
              COUNT(CASE WHEN l_quantity > 30 THEN TRY_CAST('1' AS DOUBLE) ELSE TRY_CAST('' AS DOUBLE) END) AS large,
              ROUND(AVG(CASE WHEN l_discount >= 0.05 THEN TRY_CAST(l_quantity AS DOUBLE) ELSE TRY_CAST('x' AS DOUBLE) END), 2) AS avg_qty,
              MIN(CASE WHEN l_tax < 0.03 THEN TRY_CAST(l_linenumber AS DOUBLE) ELSE TRY_CAST(l_quantity AS DOUBLE) END) AS low,
              MAX(CASE WHEN CAST(l_shipdate AS DATE) < DATE '1995-01-01' THEN TRY_CAST('9' AS DOUBLE) ELSE TRY_CAST('-1.5' AS DOUBLE) END) AS high
       FROM lineitem GROUP BY l_linestatus""",
    everything("lineitem", select=("l_linestatus",), case_expressions=(
        CaseColumn("returned", (Branch("l_returnflag", "=", "R", "l_extendedprice", "column"),), "0", "literal", "SUM"),
        CaseColumn("large", (Branch("l_quantity", ">", "30", "1"),), "", "literal", "COUNT"),
        CaseColumn("avg_qty", (Branch("l_discount", ">=", "0.05", "l_quantity", "column"),), "x", "literal", "AVG"),
        CaseColumn("low", (Branch("l_tax", "<", 0.03, "l_linenumber", "column"),), "l_quantity", "column", "MIN"),
        CaseColumn("high", (Branch("l_shipdate", "<", "1995-01-01", "9"),), "-1.5", "literal", "MAX"),
    )),
    money=("returned", "avg_qty"),
)
register(
    "agg_global", "SELECT ROUND(SUM(l_extendedprice), 2) AS total, COUNT(*) AS n, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem",
    everything("lineitem", function_columns=(
        FunctionColumn("SUM", "l_extendedprice", "total"), FunctionColumn("COUNT", "*", "n"),
        FunctionColumn("COUNT_DISTINCT", "l_suppkey", "suppliers"),
    )),
    money=("total",),
)
register(
    "agg_explicit",
    """SELECT l_linenumber, ROUND(SUM(l_quantity), 2) AS qty, ROUND(AVG(l_discount), 2) AS avg_discount,
              COUNT(l_orderkey) AS n FROM lineitem GROUP BY l_linenumber""",
    everything("lineitem", group_by=("l_linenumber",), aggregates=(
        Aggregate("l_quantity", "SUM", "qty"), Aggregate("l_discount", "AVG", "avg_discount"), Aggregate("l_orderkey", "COUNT", "n"),
    )),
    money=("qty", "avg_discount"),
)
register(
    "agg_with_coalesce",
    """SELECT o_orderstatus, COALESCE(c_mktsegment, o_orderpriority) AS segment, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    everything(
        "orders", select=("o_orderstatus",), joins=(Join("customer", key("o_custkey", "c_custkey"), "LEFT"),),
        function_columns=(
            FunctionColumn("COALESCE", "customer.c_mktsegment", "segment", "orders.o_orderpriority"),
            FunctionColumn("COUNT", "*", "n"), FunctionColumn("SUM", "o_totalprice", "total"),
        ),
    ),
    money=("total",),
)
register(
    "agg_text_numbers",
    """WITH priced AS (SELECT p_brand, CASE WHEN p_size % 5 = 0 THEN 'none' ELSE CAST(p_size AS VARCHAR) END AS size_text FROM part)
       SELECT p_brand, SUM(TRY_CAST(size_text AS DOUBLE)) AS total, ROUND(AVG(TRY_CAST(size_text AS DOUBLE)), 2) AS mean,
              MIN(size_text) AS low, MAX(size_text) AS high, COUNT(size_text) AS n FROM priced GROUP BY p_brand""",
    everything("priced", select=("p_brand",), function_columns=(
        FunctionColumn("SUM", "size_text", "total"), FunctionColumn("AVG", "size_text", "mean"),
        FunctionColumn("MIN", "size_text", "low"), FunctionColumn("MAX", "size_text", "high"), FunctionColumn("COUNT", "size_text", "n"),
    )),
    lambda read: {"priced": read("part").select(
        "p_brand", F.when(F.col("p_size") % 5 == 0, "none").otherwise(F.col("p_size").cast("string")).alias("size_text"))},
    money=("mean",),
)

CASES["agg_repeated_alias"] = Case(
    lambda spark, folder: build(
        everything("lineitem", select=("l_returnflag",), function_columns=(
            FunctionColumn("SUM", "l_linenumber", "x"), FunctionColumn("MAX", "l_linenumber", "x"))),
        table_reader(spark, folder),
    ).toDF("l_returnflag", "total", "most"),
    "SELECT l_returnflag, SUM(l_linenumber)::BIGINT AS total, MAX(l_linenumber) AS most FROM lineitem GROUP BY l_returnflag",
)

# Sorting and paging ------------------------------------------------------------------

register(
    "sort_limit",
    "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000",
    QuerySpec(table="orders", select=("o_orderkey", "o_totalprice", "o_orderstatus"),
              sort=(Sort("o_totalprice", "DESC"), Sort("o_orderkey"))),
)
register(
    "sort_all",
    "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem ORDER BY l_returnflag, l_orderkey",
    everything("lineitem", select=("l_orderkey", "l_linenumber", "l_returnflag"), sort=(Sort("l_returnflag"), Sort("l_orderkey"))),
)
register(
    "sort_offset",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 500 OFFSET 250",
    QuerySpec(table="orders", select=("o_orderkey", "o_totalprice"), sort=(Sort("o_totalprice"), Sort("o_orderkey")),
              limit_rows=500, offset=250),
)
register(
    "sort_offset_rest",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey OFFSET 1250",
    everything("orders", select=("o_orderkey", "o_totalprice"), sort=(Sort("o_totalprice"), Sort("o_orderkey")), offset=1250),
)
register(
    "sort_deep_page",
    """SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey FROM lineitem
       ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey LIMIT 300 OFFSET 50500""",
    QuerySpec(table="lineitem", select=("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"), limit_rows=300, offset=50500,
              sort=(Sort("l_shipdate", "DESC"), Sort("l_orderkey"), Sort("l_linenumber"), Sort("l_partkey"))),
)
register(
    "sort_nulls_last",
    """SELECT p_partkey, s_suppkey FROM part LEFT JOIN supplier ON p_partkey = s_suppkey
       ORDER BY s_suppkey DESC NULLS LAST, p_partkey LIMIT 200 OFFSET 10""",
    QuerySpec(table="part", select=("p_partkey", "supplier.s_suppkey"),
              joins=(Join("supplier", key("p_partkey", "s_suppkey"), "LEFT"),),
              sort=(Sort("supplier.s_suppkey", "DESC"), Sort("p_partkey")), limit_rows=200, offset=10),
)
register(
    "top_groups",
    """SELECT l_partkey, ROUND(SUM(l_quantity), 2) AS qty FROM lineitem GROUP BY l_partkey ORDER BY qty DESC, l_partkey LIMIT 100""",
    QuerySpec(table="lineitem", select=("l_partkey",), function_columns=(FunctionColumn("SUM", "l_quantity", "qty"),),
              sort=(Sort("qty", "DESC"), Sort("l_partkey")), limit_rows=100),
    money=("qty",),
)
CASES["page_total"] = Case(
    lambda spark, folder: fetch_page(
        QuerySpec(table="orders", select=("o_orderkey",), filters=(Filter("o_orderstatus", "=", "F"),), limit_rows=200),
        table_reader(spark, folder),
    ).counts,
    """SELECT COUNT(*) AS total, LEAST(COUNT(*), 200) AS page_rows, COUNT(*) >= 200 AS truncated
       FROM orders WHERE o_orderstatus = 'F'""",
)

# SQL text ----------------------------------------------------------------------------

CASES["sql_adhoc"] = Case(
    lambda spark, folder: run_sql(
        spark,
        """/* AI_CONTEXT
        engine: any */ SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM {orders}
        WHERE o_orderstatus <> ‘P’ GROUP BY o_custkey HAVING COUNT(*) > 2;""",
        read_only=True, orders=table_reader(spark, folder)("orders"),
    ),
    """SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders
       WHERE o_orderstatus <> 'P' GROUP BY o_custkey HAVING COUNT(*) > 2""",
)
