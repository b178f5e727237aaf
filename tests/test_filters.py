import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablemill import Filter, QuerySpec, SpecError, build
from tablemill.functions.casts import to_date, to_double
from tablemill.operators.filters import column_family, operators_for
from tablemill.plans.compile import check_operators


def kept(df, column, operator, value=None):
    spec = QuerySpec(table="t", limit_rows=0, filters=(Filter(column, operator, value),))
    return sorted((r["id"] for r in build(spec, {"t": df}).select("id").collect()))


@pytest.fixture(scope="module")
def texts(spark):
    values = ["50%", "a_b", "a\\b", "abc", None, "ABC"]
    return spark.createDataFrame(list(enumerate(values)), "id int, v string").cache()


@pytest.mark.parametrize("operator, value, ids", [
    ("=", "abc", [3]), ("!=", "abc", [0, 1, 2, 5]),
    ("CONTAINS", "%", [0]), ("CONTAINS", "_", [1]), ("CONTAINS", "\\", [2]), ("NOT CONTAINS", "b", [0, 5]),
    ("STARTS WITH", "a", [1, 2, 3]), ("ENDS WITH", "b", [1, 2]),
    ("LIKE", "a_b", [1, 2]), ("LIKE", "a\\%", [2]), ("LIKE", "", []), ("NOT LIKE", "a%", [0, 5]),
    ("IN", "abc, 50%,", [0, 3]), ("NOT IN", ["abc", None, ""], [0, 1, 2, 5]),
    ("IS NULL", "ignored", [4]), ("IS NOT NULL", None, [0, 1, 2, 3, 5]),
    ("=", None, []), ("!=", None, []), (">", None, []), ("LIKE", None, []),
    (">", "abb", [3]), ("BETWEEN", "a,abc", [1, 2, 3]),
])
def test_text_operators(texts, operator, value, ids):
    assert kept(texts, "v", operator, value) == ids


def test_number_text_is_compared_as_numbers(spark):
    values = ["12", " 12 ", "1e3", "NaN", "", "x", None, "12d", "-5", "inf"]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    assert kept(df, "v", ">", "11.5") == [0, 1, 2, 3, 9]
    assert kept(df, "v", "<=", 12) == [0, 1, 8]
    assert kept(df, "v", "BETWEEN", "12, 1000") == [0, 1, 2]
    assert kept(df, "v", "NOT BETWEEN", (0, 100)) == [2, 3, 8, 9]
    assert kept(df, "v", "=", 12) == [0]


def test_whole_number_columns_take_fractional_bounds(spark):
    df = spark.createDataFrame([(i, i) for i in range(-3, 4)], "id int, v long")
    for op, compare in ((">", float.__gt__), ("<", float.__lt__), (">=", float.__ge__), ("<=", float.__le__)):
        for bound in (-2.0, -1.5, 0.0, 1.5, 1e300, -1e300, float("inf"), float("-inf")):
            assert kept(df, "v", op, bound) == [i for i in range(-3, 4) if compare(float(i), bound)], (op, bound)
    assert kept(df, "v", "=", "2") == [2] and kept(df, "v", "=", 1.5) == []
    with pytest.raises(SpecError):
        kept(df, "v", "=", "two")


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=8), st.floats(-60, 60), st.floats(-60, 60))
def test_number_filters_agree_with_python(spark, values, low, high):
    df = spark.createDataFrame(list(enumerate(values)), "id int, v int")
    given_values = [(i, v) for i, v in enumerate(values) if v is not None]
    assert kept(df, "v", ">", low) == [i for i, v in given_values if v > low]
    assert kept(df, "v", "<=", str(low)) == [i for i, v in given_values if v <= low]
    assert kept(df, "v", "BETWEEN", (low, high)) == [i for i, v in given_values if low <= v <= high]
    assert kept(df, "v", "NOT BETWEEN", (low, high)) == [i for i, v in given_values if not low <= v <= high]


DATES = [
    ("14-OCT-2024", dt.date(2024, 10, 14)), ("4-Oct-2024", dt.date(2024, 10, 4)), ("14-October-2024", dt.date(2024, 10, 14)),
    ("14-10-2024", dt.date(2024, 10, 14)), ("2024-10-14", dt.date(2024, 10, 14)), ("2024-10-14 10:00:00", dt.date(2024, 10, 14)),
    ("2024/10/14", dt.date(2024, 10, 14)), ("2024", None), ("bad", None), (None, None), ("31-FEB-2024", None), ("5-Foo-2024", None),
    ("2024-10-14 x", None), ("14-May-2024", dt.date(2024, 5, 14)), ("", None),
]


def test_date_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DATES)], "id int, bill_date string")
    assert [r[0] for r in df.orderBy("id").select(to_date(F.col("bill_date"))).collect()] == [d for _, d in DATES]
    assert kept(df, "bill_date", "=", "2024-10-14") == [0, 2, 3, 4, 5, 6]
    assert kept(df, "bill_date", "!=", dt.date(2024, 10, 14)) == [1, 13]
    assert kept(df, "bill_date", "IN", "2024-10-04, 2024-05-14") == [1, 13]
    assert kept(df, "bill_date", "BETWEEN", "2024-05-14,2024-10-04") == [1, 13]
    assert kept(df, "bill_date", "LIKE", "2024-10-04") == [1]
    assert kept(df, "bill_date", "CONTAINS", "OCT") == [0]
    assert kept(df, "bill_date", "IS NULL") == [9]
    with pytest.raises(SpecError):
        kept(df, "bill_date", ">", "14-OCT-2024")


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_native_dates_compare_by_day(spark, kind):
    moments = ["2024-03-01 00:00:00", "2024-03-01 23:59:59", "2024-03-02 00:00:00", None]
    df = spark.createDataFrame(list(enumerate(moments)), "id int, m string").select("id", F.col("m").cast(kind).alias("bill_date"))
    expected = {"=": [0, 1], "!=": [2], ">": [2], ">=": [0, 1, 2], "<": [], "<=": [0, 1]}
    for op, ids in expected.items():
        assert kept(df, "bill_date", op, "2024-03-01") == ids, op
    assert kept(df, "bill_date", "NOT IN", ["2024-03-02"]) == [0, 1]
    assert kept(df, "bill_date", "BETWEEN", ("2024-03-01", "2024-03-01")) == [0, 1]
    assert kept(df, "bill_date", "NOT LIKE", "2024-03-01") == [2]


def test_other_types(spark):
    df = spark.createDataFrame([(1, True, 1.5), (2, False, None), (3, None, 2.0)], "id int, flag boolean, d double")
    df = df.withColumn("money", F.col("d").cast("decimal(10,2)")).withColumn("moment", F.lit("2024-01-01 10:00:00").cast("timestamp_ntz"))
    assert kept(df, "flag", "=", "true") == [1] and kept(df, "flag", "IN", [False]) == [2]
    assert kept(df, "money", ">=", "1.75") == [3] and kept(df, "money", "=", 1.5) == [1]
    assert kept(df, "d", "LIKE", "1%") == [1]
    for column, value in (("flag", "maybe"), ("d", "x"), ("money", "x")):
        with pytest.raises(SpecError):
            kept(df, column, "=", value)


@pytest.mark.parametrize("operator, value", [("IN", ""), ("IN", []), ("NOT IN", None), ("BETWEEN", "1"), ("BETWEEN", "1,"), ("BETWEEN", (1, 2, 3))])
def test_malformed_values_are_refused(texts, operator, value):
    with pytest.raises(SpecError):
        kept(texts, "v", operator, value)


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1))], "id int, name string, bill_date timestamp_ntz").write.parquet(path)
    spec = QuerySpec(table="t", select=("id",), limit_rows=0, filters=(
        Filter("id", ">", "0.5"), Filter("name", "STARTS WITH", "a"), Filter("bill_date", ">=", "2023-01-01")))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = build(spec, {"t": spark.read.parquet(path)})._jdf.queryExecution().executedPlan().toString()
    for pushed in ("GreaterThan(id,0)", "StringStartsWith(name,a)", "GreaterThanOrEqual(bill_date,"):
        assert pushed in plan


def test_operator_families(spark):
    df = spark.createDataFrame([(1, "x", True, "x")], "n int, s string, b boolean, start_date string")
    types = {f.name: f.dataType for f in df.schema}
    assert [column_family(types[c], c) for c in df.columns] == ["number", "text", "boolean", "date"]
    assert "CONTAINS" in operators_for(types["s"]) and "BETWEEN" in operators_for(types["n"])
    assert operators_for(types["b"]) == ("=", "!=", "IS NULL", "IS NOT NULL", "IN", "NOT IN")
    check_operators(QuerySpec(table="t", filters=(Filter("n", ">", 1),)), {"t": df})
    with pytest.raises(SpecError):
        check_operators(QuerySpec(table="t", filters=(Filter("n", "CONTAINS", "1"),)), {"t": df})


def test_to_double_keeps_plain_numbers_only(spark):
    df = spark.createDataFrame([("1.5",), ("+2",), (".5",), ("5.",), ("1f",), ("0x10",), ("Infinity",)], "v string")
    values = [r[0] for r in df.select(to_double(F.col("v"), df.schema["v"].dataType)).collect()]
    assert values == [1.5, 2.0, 0.5, 5.0, None, None, float("inf")]


def test_building_with_checked_operators(spark):
    from tablemill import QuerySpec, build

    tables = {"t": spark.createDataFrame([("5", 5)], "text string, number int")}
    loose = QuerySpec(table="t", filters=(Filter("text", ">", "4"),))
    assert build(loose, tables).count() == 1
    with pytest.raises(SpecError, match="not offered"):
        build(loose, tables, checked=True)
    assert build(QuerySpec(table="t", filters=(Filter("number", ">", 4),)), tables, checked=True).count() == 1
