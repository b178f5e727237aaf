"""Enrichment, lookups and cleaning steps."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.functions.months import label_before, month_code, month_label, previous_month_label
from tablemill.functions.units import load_kilowatts
from tablemill.operators.enrichment import enrich, enrich_stats
from tablemill.operators.masters import Master, enrich_stored, lookup_stored, open_master, store_master
from tablemill.session import scratch_path
from tablemill.sources.parquet import csv_to_parquet
from tablemill.operators.lookups import digits_only, enrich_monthly, first_rows, lookup_enrich, lookup_join
from workload import Case, table_reader

CASES: dict[str, Case] = {}
KEYS = [("cust_text", "c_custkey")]


def _uploaded(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as an uploaded sheet: keys are text, and some do not exist in the master."""
    orders = table_reader(spark, folder)("orders")
    known = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("X"), F.col("o_custkey"))).otherwise(F.col("o_custkey").cast("string"))
    return orders.select("o_orderkey", known.alias("cust_text"), "o_totalprice")


UPLOADED = """WITH uploaded AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END
              AS cust_text, o_totalprice FROM orders)"""

CASES["enrich_join"] = Case(
    lambda spark, folder: enrich(
        _uploaded(spark, folder), table_reader(spark, folder)("customer"), KEYS, ["c_name", "c_mktsegment"]).rows,
    f"""{UPLOADED} SELECT uploaded.*, c_name, c_mktsegment FROM uploaded
        LEFT JOIN customer ON cust_text = CAST(c_custkey AS VARCHAR)""",
)
CASES["enrich_repeated_keys"] = Case(
    lambda spark, folder: enrich(
        table_reader(spark, folder)("customer").select("c_custkey", "c_name"), table_reader(spark, folder)("orders"),
        [("c_custkey", "o_custkey")], ["o_orderkey"]).rows,
    """SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders
       ON CAST(c_custkey AS VARCHAR) = CAST(o_custkey AS VARCHAR)""",
)
CASES["enrich_stats"] = Case(
    lambda spark, folder: enrich_stats(_uploaded(spark, folder), table_reader(spark, folder)("customer"), KEYS),
    f"""{UPLOADED}, met AS (SELECT c_custkey FROM uploaded LEFT JOIN customer ON cust_text = CAST(c_custkey AS VARCHAR))
        SELECT COUNT(c_custkey) AS matched_rows, COUNT(*) - COUNT(c_custkey) AS unmatched_rows, COUNT(*) AS total_rows FROM met""",
)


def _stored(spark: SparkSession, folder: str, source: str, key: str) -> Master:
    """A table stored as a master, in a new table of the catalog."""
    name = f"stored_{source}_{uuid.uuid4().hex}"
    store_master(spark, name, table_reader(spark, folder)(source), [key])
    return open_master(spark, name)


CASES["enrich_stored_master"] = Case(
    lambda spark, folder: enrich_stored(_uploaded(spark, folder), _stored(spark, folder, "customer", "c_custkey"), KEYS, ["c_name", "c_mktsegment"]).rows,
    CASES["enrich_join"].sql,
)
CASES["enrich_stored_hot"] = Case(
    lambda spark, folder: enrich_stored(
        table_reader(spark, folder)("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 3 != 0, F.col("l_suppkey")).otherwise(1).alias("supplier")),
        _stored(spark, folder, "supplier", "s_suppkey"), [("supplier", "s_suppkey")], ["s_name"]).rows,
    """SELECT l_orderkey, l_linenumber, supplier, s_name FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 <> 0 THEN l_suppkey ELSE 1 END AS supplier
       FROM lineitem) LEFT JOIN supplier ON supplier = s_suppkey""",
)
CASES["lookup_stored"] = Case(
    lambda spark, folder: lookup_stored(
        table_reader(spark, folder)("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("c_name")),
        _stored(spark, folder, "customer", "c_custkey")).select("o_orderkey", "c_custkey", "c_name_x", "c_name_y", "c_mktsegment"),
    """SELECT o_orderkey, o_custkey AS c_custkey, o_orderstatus AS c_name_x, c_name AS c_name_y, c_mktsegment FROM orders
       LEFT JOIN customer ON o_custkey = customer.c_custkey""",
)

CASES["lookup_first_rows"] = Case(
    lambda spark, folder: first_rows(
        table_reader(spark, folder)("orders"), "o_custkey", ["o_orderkey", "o_orderstatus"],
        [F.col("o_orderdate"), F.col("o_orderkey")]),
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
       QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
)
CASES["lookup_suffixes"] = Case(
    lambda spark, folder: lookup_join(
        table_reader(spark, folder)("customer").select("c_custkey", F.col("c_nationkey").alias("code"), F.col("c_name").alias("name")),
        table_reader(spark, folder)("nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name")), "code"),
    """SELECT c_custkey, c_nationkey AS code, c_name AS name_x, n_name AS name_y FROM customer LEFT JOIN nation
       ON CAST(c_nationkey AS VARCHAR) = CAST(n_nationkey AS VARCHAR)""",
)


def _hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as the division and sub-division lookup; division codes repeat."""
    read = table_reader(spark, folder)
    nation, region = read("nation"), read("region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    suppliers = read("supplier")
    return suppliers.join(places, suppliers.s_nationkey == places.n_nationkey).select(
        F.concat(F.lit("D"), F.col("n_nationkey")).alias("DIV_CODE"), F.col("r_name").alias("DISCOM"),
        F.col("n_regionkey").alias("CIR_SP_ID"), F.col("r_regionkey").alias("ZON_SP_ID"), F.col("s_name").alias("DIV_NAME"),
        F.col("n_name").alias("CIRCLE_NAME"), F.col("r_name").alias("ZONE_NAME"),
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("SDO_SP_ID"), F.col("s_name").alias("SDO_NAME"),
        F.col("s_suppkey").alias("place"),
    )


def _monthly(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as monthly source rows, some with account ids that are not all digits."""
    lines = table_reader(spark, folder)("lineitem")
    units = F.array(*[F.lit(u) for u in ("KW", " kva ", "HP", "bhp", "LAMP")])
    return lines.select(
        F.when(F.col("l_linenumber") == 7, F.concat("l_orderkey", F.lit(".0"))).otherwise(F.col("l_orderkey").cast("string")).alias("ACCT_ID"),
        "l_linenumber", F.concat(F.lit("D"), F.col("l_suppkey") % 30).alias("DIV_CODE"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("SDO_CODE"),
        F.when(F.col("l_linenumber") == 6, "bad").otherwise((F.col("l_quantity") / 4).cast("string")).alias("LOAD"),
        F.get(units, (F.col("l_partkey") % 5).cast("int")).alias("LOAD_UNIT"),
        F.concat("l_returnflag", "l_linestatus").alias("SUPPLY_TYPE"), F.col("l_extendedprice").cast("string").alias("BILLED_AMOUNT"),
    )


def _supply(spark: SparkSession, folder: str) -> DataFrame:
    """Return flags and line states as the supply-type lookup; every type repeats, and one has another name there."""
    return table_reader(spark, folder)("lineitem").select(
        F.replace(F.concat("l_returnflag", "l_linestatus"), F.lit("NO"), F.lit("NONE")).alias("SUPPLY_TYPE"),
        F.col("l_returnflag").alias("CATEGORY"), F.col("l_orderkey").alias("place"),
    )


HIERARCHY = """hierarchy AS (SELECT 'D' || n_nationkey AS DIV_CODE, r_name AS DISCOM, n_regionkey AS CIR_SP_ID, r_regionkey AS ZON_SP_ID,
    s_name AS DIV_NAME, n_name AS CIRCLE_NAME, r_name AS ZONE_NAME, 'S' || s_suppkey AS SDO_SP_ID, s_name AS SDO_NAME, s_suppkey AS place
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  division AS (SELECT * FROM hierarchy QUALIFY ROW_NUMBER() OVER (PARTITION BY DIV_CODE ORDER BY place) = 1),
  supply AS (SELECT DISTINCT replace(l_returnflag || l_linestatus, 'NO', 'NONE') AS SUPPLY_TYPE, l_returnflag AS CATEGORY
             FROM lineitem)"""
MONTHLY = """monthly AS (SELECT CASE WHEN l_linenumber = 7 THEN l_orderkey || '.0' ELSE CAST(l_orderkey AS VARCHAR) END AS ACCT_ID, l_linenumber,
    'D' || (l_suppkey % 30) AS DIV_CODE, 'S' || l_suppkey AS SDO_CODE,
    CASE WHEN l_linenumber = 6 THEN 'bad' ELSE CAST(l_quantity / 4 AS VARCHAR) END AS LOAD,
    ['KW', ' kva ', 'HP', 'bhp', 'LAMP'][l_partkey % 5 + 1] AS LOAD_UNIT, l_returnflag || l_linestatus AS SUPPLY_TYPE,
    l_extendedprice FROM lineitem)"""
KILOWATTS = """ROUND(COALESCE(ROUND_EVEN(TRY_CAST(LOAD AS DOUBLE), 0), 0) * CASE upper(trim(LOAD_UNIT)) WHEN 'KW' THEN 1 WHEN 'KVA' THEN 0.9
    WHEN 'HP' THEN 0.746 WHEN 'BHP' THEN 0.746 END, 3)"""


def _lookup_enrich(spark: SparkSession, folder: str) -> DataFrame:
    rows = _monthly(spark, folder).withColumnRenamed("SDO_CODE", "SUB_DIV_CODE")
    supply = _supply(spark, folder)
    out = lookup_enrich(rows, _hierarchy(spark, folder), supply, [F.col("place")])
    return out.select("ACCT_ID", "l_linenumber", "DIV_CODE", "SUB_DIV_CODE", "SUPPLY_TYPE", "DISCOM", "CIR_SP_ID", "ZON_SP_ID",
                      "DIV_NAME", "CIRCLE_NAME", "ZONE_NAME", "SDO_NAME", "CATEGORY")


CASES["lookup_enrich"] = Case(
    _lookup_enrich,
    f"""WITH {HIERARCHY}, {MONTHLY} SELECT ACCT_ID, l_linenumber, m.DIV_CODE, m.SDO_CODE AS SUB_DIV_CODE, m.SUPPLY_TYPE, d.DISCOM, d.CIR_SP_ID,
        d.ZON_SP_ID, d.DIV_NAME, d.CIRCLE_NAME, d.ZONE_NAME, h.SDO_NAME, s.CATEGORY FROM monthly m LEFT JOIN division d ON m.DIV_CODE = d.DIV_CODE
        LEFT JOIN hierarchy h ON m.SDO_CODE = h.SDO_SP_ID LEFT JOIN supply s ON m.SUPPLY_TYPE = s.SUPPLY_TYPE""",
)


def _enrich_monthly(spark: SparkSession, folder: str) -> DataFrame:
    out = enrich_monthly(
        _monthly(spark, folder), _hierarchy(spark, folder), _supply(spark, folder), dt.date(2026, 3, 15), [F.col("place")]
    )
    return out.select("ACCT_ID", "l_linenumber", "TOTAL_AMT", "SUB_DIV_CODE", "DISCOM", "SDO_NAME", "CATEGORY",
                      F.round("LOAD_KW", 3).alias("LOAD_KW"), "MONTH")


CASES["enrich_monthly"] = Case(
    _enrich_monthly,
    f"""WITH {HIERARCHY}, {MONTHLY} SELECT ACCT_ID, l_linenumber, l_extendedprice AS TOTAL_AMT, m.SDO_CODE AS SUB_DIV_CODE, d.DISCOM, h.SDO_NAME,
        s.CATEGORY, {KILOWATTS} AS LOAD_KW, 'FEB_2026' AS MONTH FROM monthly m LEFT JOIN division d ON m.DIV_CODE = d.DIV_CODE
        LEFT JOIN hierarchy h ON m.SDO_CODE = h.SDO_SP_ID LEFT JOIN supply s ON m.SUPPLY_TYPE = s.SUPPLY_TYPE
        WHERE regexp_full_match(ACCT_ID, '[0-9]+')""",
)


def _convert_monthly(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly CSV files to Parquet with the lookups joined, in one job over all files."""
    source, target = scratch_path(spark, "months"), scratch_path(spark, "converted")
    _monthly(spark, folder).write.option("header", True).csv(source)
    hierarchy, supply = _hierarchy(spark, folder), _supply(spark, folder)
    csv_to_parquet(
        spark, f"{source}/*.csv", target, transform=lambda rows: enrich_monthly(rows, hierarchy, supply, dt.date(2026, 3, 15), [F.col("place")])
    )
    return spark.read.parquet(target).select(
        "ACCT_ID", F.col("l_linenumber").cast("int").alias("l_linenumber"), "TOTAL_AMT", "SUB_DIV_CODE", "DISCOM", "SDO_NAME", "CATEGORY",
        F.round("LOAD_KW", 3).alias("LOAD_KW"), "MONTH")


CASES["convert_monthly"] = Case(_convert_monthly, CASES["enrich_monthly"].sql)


def _load_units(spark: SparkSession, folder: str) -> DataFrame:
    parts = table_reader(spark, folder)("part")
    unit = F.get(F.array(*[F.lit(u) for u in ("KW", " kva ", "HP", "bhp", "LAMP")]), (F.col("p_partkey") % 5).cast("int"))
    load = F.when(F.col("p_size") != 13, F.col("p_size") / 2)
    return parts.select("p_partkey", F.round(load_kilowatts(load, unit), 3).alias("load_kw"))


CASES["load_units"] = Case(
    _load_units,
    """SELECT p_partkey, ROUND(COALESCE(ROUND_EVEN(CASE WHEN p_size <> 13 THEN p_size / 2.0 END, 0), 0)
              * [1, 0.9, 0.746, 0.746, NULL][p_partkey % 5 + 1], 3)::DOUBLE AS load_kw FROM part""",
)
CASES["digits_only"] = Case(
    lambda spark, folder: digits_only(_uploaded(spark, folder), "cust_text"),
    f"{UPLOADED} SELECT * FROM uploaded WHERE regexp_full_match(cust_text, '[0-9]+')",
)


def _month_labels(spark: SparkSession, folder: str) -> DataFrame:
    events = table_reader(spark, folder)("events")
    label = month_label(F.col("ts"))
    return events.select(
        "event_id", label.alias("label"), previous_month_label(F.col("ts")).alias("previous"),
        label_before(label).alias("before_label"), month_code(label).alias("code"),
    )


CASES["month_label"] = Case(
    _month_labels,
    """SELECT event_id, upper(strftime(ts, '%b_%Y')) AS label, upper(strftime(ts - INTERVAL 1 MONTH, '%b_%Y')) AS previous,
              upper(strftime(ts - INTERVAL 1 MONTH, '%b_%Y')) AS before_label, strftime(ts, '%m%y') AS code FROM events""",
)
