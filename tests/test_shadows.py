"""Filters on text through stored shadows give what parsing the text gives, and prune the scan."""

import pytest

from tablemill import Branch, CaseColumn, Filter, Join, JoinKey, QuerySpec, SpecError, build
from tablemill.operators.shadows import with_shadows
from tablemill.session import materialize
from tablemill.sources.parquet import csv_to_parquet

DAYS = ["14-OCT-2024", "4-Oct-2024", "14-October-2024", "14-10-2024", "2024-10-14", "2024-10-14 10:00:00", "2024/10/15", "2024", "bad", "", None]
NUMBERS = ["12", " 12 ", "1e3", "NaN", "", "x", None, "12d", "-5.5", "7", "99"]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(k, d, n) for k, (d, n) in enumerate(zip(DAYS, NUMBERS))]
    plain = spark.createDataFrame(rows, "id int, BILL_DATE string, arrear string")
    return {"t": plain}, {"t": materialize(with_shadows(with_shadows(plain), ["arrear"]), "shadows")}


@pytest.mark.parametrize(
    ("name", "op", "value"),
    [("bill_date", op, "2024-10-14") for op in ("=", "!=", ">", "<", ">=", "<=", "LIKE", "NOT LIKE")]
    + [("BILL_DATE", "IN", "2024-10-14,2024-10-04"), ("BILL_DATE", "NOT IN", "2024-10-14"), ("BILL_DATE", "BETWEEN", "2024-10-04,2024-10-14")]
    + [("BILL_DATE", "NOT BETWEEN", "2024-10-04,2024-10-14"), ("BILL_DATE", "IS NULL", None), ("BILL_DATE", "CONTAINS", "OCT")]
    + [("arrear", op, v) for op in (">", "<", ">=", "<=", "=", "!=") for v in ("12", 7.5, " 99 ")]
    + [("arrear", "BETWEEN", "7,12"), ("arrear", "NOT BETWEEN", ("7", 12)), ("arrear", "BETWEEN", "a,y"), ("arrear", ">", "nan"), ("arrear", "IN", "12,7"), ("arrear", ">", "abc")],
)
def test_same_rows_as_by_parsing(tables, rows, name, op, value):
    spec = QuerySpec(table="t", filters=(Filter(name, op, value),), limit_rows=0)
    plain, shadowed = (build(spec, t) for t in tables)
    assert plain.columns == shadowed.columns == ["id", "BILL_DATE", "arrear"] and rows(plain) == rows(shadowed)


def test_scan_is_pruned_also_behind_a_join(tables):
    _, shadowed = tables
    joins = (Join("t", (JoinKey("id", "id"),), "INNER", alias="u"),)
    case = CaseColumn("c", (Branch("u.BILL_DATE", ">", "2024-10-14", "late"),), "early")
    spec = QuerySpec(table="t", joins=joins, case_expressions=(case,), filters=(Filter("BILL_DATE", ">=", "2024-10-14"), Filter("u.arrear", ">", 7)), limit_rows=0)
    df = build(spec, shadowed)
    assert df.columns == ["id", "BILL_DATE", "arrear", "id", "BILL_DATE", "arrear", "c"] and df.count() == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(BILL_DATE__day,2024-10-14)" in plan and "GreaterThan(arrear__number,7.0)" in plan


def test_shadows_of_a_conversion(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,due_date,amount\n1,14-OCT-2024,5\n2,junk,x\n")
    csv_to_parquet(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), shadows=["due_date", "amount"])
    df = spark.read.parquet(str(tmp_path / "out"))
    found = build(QuerySpec(table="t", filters=(Filter("due_date", "=", "2024-10-14"), Filter("amount", ">", "4"))), {"t": df})
    assert [r["id"] for r in found.collect()] == ["1"] and "amount__number" in df.columns and "amount__number" not in found.columns
    again = with_shadows(df, ["due_date"])
    assert again.columns == df.columns
    for bad in (["nope"], ["amount__number"]):
        with pytest.raises(SpecError):
            with_shadows(df, bad)
    taken = with_shadows(spark.createDataFrame([("1", "x")], "a string, a__number string"), ["a"])
    assert taken.columns == ["a", "a__number", "a__number_"]
