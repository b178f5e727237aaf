import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablemill import SpecError
from tablemill.functions.months import (
    label_before, label_of_previous, month_code, month_start, monthly_name, parse_month, previous_month_label,
)
from tablemill.functions.units import load_kilowatts
from tablemill.operators import lookups
from tablemill.operators.enrichment import enrich, enrich_stats
from tablemill.operators.lookups import digits_only, enrich_monthly, first_rows, lookup_enrich, lookup_join, with_fallbacks


@pytest.fixture(scope="module")
def sheet(spark):
    return spark.createDataFrame([("1", "a"), ("2", "b")], "ACCT_ID string, NAME string")


@pytest.fixture(scope="module")
def master(spark):
    return spark.createDataFrame([(1, "x", "N1"), (1, "y", "N2"), (7, "z", "N3"), (None, "w", "N4")], "ACCT_ID int, CODE string, NAME string")


def test_enrichment_repeats_rows_for_repeated_master_keys(sheet, master, rows):
    out = enrich(sheet, master, [("ACCT_ID", "ACCT_ID")], ["CODE", "NAME"])
    assert out.rows.columns == ["ACCT_ID", "NAME", "CODE", "NAME_1"]
    assert rows(out.rows) == [("1", "a", "x", "N1"), ("1", "a", "y", "N2"), ("2", "b", None, None)]
    assert out.stats() == {"matched_rows": 2, "unmatched_rows": 1, "total_rows": 3}


def test_statistics_without_rows(sheet, master):
    assert enrich_stats(sheet, master, [("ACCT_ID", "ACCT_ID")]).collect() == [(2, 1, 3)]
    assert enrich_stats(sheet.limit(0), master, [("ACCT_ID", "ACCT_ID")]).collect() == [(0, 0, 0)]


def test_null_keys_do_not_match(spark, master, rows):
    sheet = spark.createDataFrame([(None, "q")], "ACCT_ID string, NAME string")
    assert rows(enrich(sheet, master, [("ACCT_ID", "ACCT_ID")], ["CODE"]).rows) == [(None, "q", None)]
    assert enrich_stats(sheet, master, [("ACCT_ID", "ACCT_ID")]).collect() == [(0, 1, 1)]


@pytest.mark.parametrize("keys, fetch", [([], ["CODE"]), ([("NOPE", "ACCT_ID")], ["CODE"]), ([("ACCT_ID", "NOPE")], []), ([("ACCT_ID", "ACCT_ID")], ["NOPE"])])
def test_enrichment_checks_its_columns(sheet, master, keys, fetch):
    with pytest.raises(SpecError):
        enrich(sheet, master, keys, fetch)


def test_first_row_per_key_wins(spark, rows):
    df = spark.createDataFrame([("k", None, 3), ("k", "late", 2), ("j", "only", 9)], "key string, v string, place int")
    assert rows(first_rows(df, "key", ["v"], [F.col("place")])) == [("j", "only"), ("k", "late")]
    assert rows(first_rows(df.coalesce(1), "key", ["v"])) == [("j", "only"), ("k", None)]


@pytest.mark.parametrize("limit", [lookups.BROADCAST_BYTES, 0])
def test_lookup_join_suffixes(spark, rows, monkeypatch, limit):
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", limit)
    left = spark.createDataFrame([(1, "l", "p"), (3, "m", "q")], "code int, name string, other string")
    right = spark.createDataFrame([("1", "r", True)], "code string, NAME string, flag boolean")
    df = lookup_join(left, right, "code")
    assert df.columns == ["code", "name_x", "other", "NAME_y", "flag"]
    assert rows(df) == [(1, "l", "p", "r", True), (3, "m", "q", None, None)]


HIERARCHY = "DIV_CODE string, DISCOM string, CIR_SP_ID string, ZON_SP_ID string, DIV_NAME string, CIRCLE_NAME string, ZONE_NAME string, SDO_SP_ID string, SDO_NAME string"


@pytest.fixture(scope="module")
def hierarchy(spark):
    return spark.createDataFrame([
        ("D1", "PVVNL", "c", "z", "first", "cn", "zn", "S1", "sub one"), ("D1", "PVVNL", "c", "z", "second", "cn", "zn", "S2", "sub two"),
    ], HIERARCHY).coalesce(1)


@pytest.fixture(scope="module")
def supply(spark):
    return spark.createDataFrame([("10", "domestic"), ("10", "again")], "SUPPLY_TYPE string, CATEGORY string").coalesce(1)


def test_lookups_apply_where_their_key_exists(spark, hierarchy, supply, rows):
    df = spark.createDataFrame([("D1", "x"), ("D9", "y")], "DIV_CODE string, v string")
    out = lookup_enrich(df, hierarchy, supply)
    assert "SDO_NAME" not in out.columns and "CATEGORY" not in out.columns
    assert rows(out.select("v", "DIV_NAME")) == [("x", "first"), ("y", None)]


def test_rows_are_not_shuffled_by_the_few_keys_of_a_lookup(spark, rows, monkeypatch):
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 4096)  # more than the lookup without its duplicates, less than with them
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        supply = spark.createDataFrame([(str(k % 2), f"type {k % 2}") for k in range(1000)], "SUPPLY_TYPE string, CATEGORY string")
        df = spark.createDataFrame([("0", 1), ("1", 2), ("7", 3), (None, 4)], "SUPPLY_TYPE string, v int")
        out = lookup_enrich(df, spark.createDataFrame([], HIERARCHY), supply)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        assert rows(out.select("v", "CATEGORY")) == [(1, "type 0"), (2, "type 1"), (3, None), (4, None)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_monthly_cleaning(spark, hierarchy, supply):
    df = spark.createDataFrame([
        ("123", "2.5", "kw ", "D1", "S2", "10", "5.5"), ("12a", "1", "KW", "D1", "S1", "10", "1"),
        ("123.0", "1", "KW", "D1", "S1", "10", "1"), ("", "1", "KW", "D1", "S1", "10", "1"),
        ("9", "3.5", "BHP", "D2", "S9", None, "bad"), ("8", "bad", "HP", None, None, "11", None), ("7", "1", "X", "D1", "S1", "10", "1"),
    ], "ACCT_ID string, LOAD string, LOAD_UNIT string, DIV_CODE string, SDO_CODE string, SUPPLY_TYPE string, BILLED_AMOUNT string")
    out = enrich_monthly(df, hierarchy, supply, dt.date(2026, 1, 31)).select(
        "ACCT_ID", "TOTAL_AMT", "SUB_DIV_CODE", "DISCOM", "SDO_NAME", "CATEGORY", F.round("LOAD_KW", 3), "MONTH")
    assert sorted(map(tuple, out.collect())) == [
        ("123", 5.5, "S2", "PVVNL", "sub two", "domestic", 2.0, "DEC_2025"),
        ("7", 1.0, "S1", "PVVNL", "sub one", "domestic", None, "DEC_2025"),
        ("8", None, None, None, None, None, 0.0, "DEC_2025"),
        ("9", None, "S9", None, None, None, 2.984, "DEC_2025"),
    ]
    with pytest.raises(SpecError):
        enrich_monthly(df.drop("LOAD"), hierarchy, supply, dt.date(2026, 1, 1))


def test_fallbacks_do_not_replace_existing_columns(spark):
    df = spark.createDataFrame([("1", "2", "3", "4")], "BILLED_AMOUNT string, TOTAL_AMT string, SDO_CODE string, SUB_DIV_CODE string")
    assert with_fallbacks(df).collect() == df.collect()


def test_load_units(spark):
    cases = [(2.5, "KW", 2.0), (2.5, " kva", 1.8), (3.5, "BHP", 2.984), (None, "HP", 0.0), (1.0, "X", None), (1.0, None, None), (1.5, "kw", 2.0)]
    df = spark.createDataFrame([(v, u) for v, u, _ in cases], "v double, u string")
    got = [r[0] for r in df.select(F.round(load_kilowatts(F.col("v"), F.col("u")), 3)).collect()]
    assert got == [e for *_, e in cases]


def test_account_ids(spark, rows):
    df = spark.createDataFrame([("123",), ("12a",), ("123.0",), ("",), (None,)], "a string")
    assert rows(digits_only(df, "a")) == [("123",)]


def test_month_columns(spark):
    df = spark.createDataFrame([(dt.date(2026, 3, 31), "MAR_2026"), (dt.date(2026, 1, 1), "jan_2026"), (None, "bad")], "d date, m string")
    got = df.select(previous_month_label(F.col("d")), month_start(F.col("m")), month_code(F.col("m")), label_before(F.col("m"))).collect()
    assert [tuple(r) for r in got] == [
        ("FEB_2026", dt.date(2026, 3, 1), "0326", "FEB_2026"), ("DEC_2025", dt.date(2026, 1, 1), "0126", "DEC_2025"), (None, None, None, None)]


def test_month_names():
    assert monthly_name("master", "MAR_2026") == "Master_0326" and monthly_name(" MASTER_x ", "0326") == "Master_0326"
    assert monthly_name("masters", None) == "masters" and monthly_name("billing", "") == "billing"
    assert label_of_previous(dt.date(2026, 1, 15)) == "DEC_2025" and parse_month("nope") is None
    with pytest.raises(SpecError):
        monthly_name("master", "March")
