import datetime as dt

import pytest

from tablemill import Filter, Pivot, QuerySpec, SpecError, build
from tablemill.operators.reports import long_report
from tablemill.operators.totals import with_grand_total


def report(df, pivot, **parts):
    return build(QuerySpec(table="t", mode="REPORT", pivot=pivot, **parts), {"t": df})


def shown(df):
    return df.columns, [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def usage(spark):
    return spark.createDataFrame([("DIV1", "PVVNL", 10), ("DIV1", "DVVNL", 20), ("DIV2", "PVVNL", 30)], "DIV_CODE string, DISCOM string, v int")


def test_pivot_golden(spark):
    # Headings appear in the order of the key-sorted rows: DVVNL before PVVNL within DIV1.
    df = spark.createDataFrame([("DIV1", "PVVNL", 4), ("DIV1", "PVVNL", 6), ("DIV1", "DVVNL", 20), ("DIV2", "PVVNL", 30)], "DIV_CODE string, DISCOM string, v int")
    assert shown(report(df, Pivot("v", "SUM", ("DIV_CODE",), ("DISCOM",)))) == (
        ["DIV_CODE", "DVVNL", "PVVNL"], [("DIV1", 20, 10), ("DIV2", None, 30)])


def test_heading_order_is_first_appearance(spark):
    df = spark.createDataFrame([("a", "z", 1), ("b", "m", 2), ("b", "a", 3), (None, "c", 4)], "k string, h string, v int")
    assert report(df, Pivot("v", "SUM", ("k",), ("h",))).columns == ["k", "z", "a", "m", "c"]


def test_null_heading_and_null_row_key(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("b", "y", 3), (None, "x", 4)], "k string, h string, v int")
    assert shown(report(df, Pivot("v", "SUM", ("k",), ("h",)))) == (
        ["k", "x", "(null)", "y"], [("a", 1, 2, None), ("b", None, None, 3), (None, 4, None, None)])


def test_heading_of_several_fields(usage):
    df = report(usage, Pivot("v", "MAX", (), ("DIV_CODE", "DISCOM")))
    assert shown(df) == (["DIV_CODE=DIV1 | DISCOM=DVVNL", "DIV_CODE=DIV1 | DISCOM=PVVNL", "DIV_CODE=DIV2 | DISCOM=PVVNL"], [(20, 10, 30)])


def test_clashing_headings_are_refused(spark):
    df = spark.createDataFrame([("a", "(null)", 1), ("a", None, 2)], "k string, h string, v int")
    with pytest.raises(SpecError):
        report(df, Pivot("v", "SUM", ("k",), ("h",)))


def test_too_many_headings_point_to_the_long_form(spark, usage):
    spark.conf.set("spark.sql.pivotMaxValues", "1")
    try:
        with pytest.raises(SpecError, match="long_report"):
            report(usage, Pivot("v", "SUM", ("DIV_CODE",), ("DISCOM",)))
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")
    spec = QuerySpec(table="t", mode="REPORT", pivot=Pivot("v", "SUM", ("DIV_CODE",), ("DISCOM",)))
    assert long_report(spec, {"t": usage}).count() == 3


def test_no_rows(usage):
    empty = (Filter("v", ">", 1000),)
    assert shown(report(usage, Pivot("v", "SUM", ("DIV_CODE",), ("DISCOM",)), filters=empty)) == (["DIV_CODE", "SUM(v)"], [])
    assert shown(report(usage, Pivot("v", "SUM", ("DIV_CODE",)), filters=empty)) == (["DIV_CODE", "SUM(v)"], [])


def test_text_values(spark):
    df = spark.createDataFrame([("a", "10"), ("a", "x"), ("a", "9")], "k string, v string")
    assert shown(report(df, Pivot("v", "SUM", ("k",)))) == (["k", "SUM(v)"], [("a", 19.0)])
    assert shown(report(df, Pivot("v", "MIN", ("k",)))) == (["k", "MIN(v)"], [("a", "10")])


def test_report_total_comes_last(usage):
    df = report(usage, Pivot("v", "SUM", ("DIV_CODE",), ("DISCOM",)), add_grand_total=True)
    assert shown(df)[1] == [("DIV1", 20, 10), ("DIV2", None, 30), ("GRAND TOTAL", 20, 40)]
    plain = report(usage, Pivot("v", "AVG", ("DISCOM", "DIV_CODE")), add_grand_total=True)
    assert [tuple(r) for r in plain.collect()][-1] == ("GRAND TOTAL", "", 60.0)


def test_same_heading_as_a_row_field(spark):
    df = spark.createDataFrame([("a", "k", 1)], "k string, h string, v int")
    assert shown(report(df, Pivot("v", "SUM", ("k",), ("h",)), add_grand_total=True)) == (["k", "k"], [("a", 1), ("GRAND TOTAL", 1)])


def total(df, **options):
    return [tuple(r) for r in with_grand_total(df, **options).collect()][-1]


def test_grand_total_cells(spark):
    df = spark.createDataFrame(
        [("x", "D1", "same", 1, 1.5, dt.date(2024, 1, 1)), ("y", "D2", "", 2, None, dt.date(2024, 1, 1)), ("z", None, "same", 3, 2.5, None)],
        "a string, discom string, b string, n int, d double, day date")
    assert total(df) == ("", "GRAND TOTAL", "same", 6, 4.0, dt.date(2024, 1, 1))
    assert total(df.drop("discom")) == ("GRAND TOTAL", "same", 6, 4.0, dt.date(2024, 1, 1))
    assert total(df, label_column="b") == ("", "", "GRAND TOTAL", 6, 4.0, dt.date(2024, 1, 1))


def test_grand_total_special_frames(spark):
    numeric_label = spark.createDataFrame([(1, "a"), (2, "b")], "DISCOM int, t string")
    assert total(numeric_label) == (3, "")
    text_only = spark.createDataFrame([("a",)], "t string")
    assert with_grand_total(text_only).collect() == [("a",)]
    assert with_grand_total(numeric_label.limit(0)).count() == 0
    dated = spark.createDataFrame([(dt.date(2024, 1, 1), 1)], "day date, n int")
    assert total(dated) == ("GRAND TOTAL", 1)


def test_source_is_scanned_once_for_a_pivot(spark, tmp_path, usage):
    path = str(tmp_path / "t")
    usage.write.parquet(path)
    df = report(spark.read.parquet(path), Pivot("v", "SUM", ("DIV_CODE",), ("DISCOM",)), add_grand_total=True)
    assert path not in df._jdf.queryExecution().executedPlan().toString()
