import pytest

from tablemill import Filter, FunctionColumn, Pivot, QuerySpec, Sort, SpecError
from tablemill.operators.families import (
    TABLE_PLACEHOLDER, Family, family_of_partitions, family_total, union_family, union_family_sql,
)



def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


FAMILY = Family("JAN_2026", ("dvvnl", "PVVNL", "DVVNL"))


@pytest.fixture(scope="module")
def tables(spark):
    def member(region, start):
        return spark.createDataFrame([(start + i, region, "A" if i % 2 else "B") for i in range(4)], "id int, DISCOM string, kind string")

    return {FAMILY.table("DVVNL"): member("DVVNL", 0), FAMILY.table("PVVNL"): member("PVVNL", 10)}


def test_configuration():
    assert FAMILY.month == "jan_2026" and FAMILY.regions == ("DVVNL", "PVVNL") and FAMILY.base_region == "DVVNL"
    assert FAMILY.table("PVVNL") == "CM_master_data_jan_2026_PVVNL"
    assert Family("jan_2026", base_region="kesco").regions == ("KESCO",)
    assert Family("jan_2026", ("PVVNL",), base_region="KESCO").base_region == "PVVNL"
    assert Family("jan_2026", ("PVVNL",), schema_name="S").table("PVVNL") == "S.CM_master_data_jan_2026_PVVNL"
    assert Family("jan_2026", ("north",), allowed=("NORTH", "SOUTH")).members == ("NORTH",)
    for bad in ({"month": "2026"}, {"month": "jan_2026", "regions": ("X",)}, {"month": "jan_2026"}, {"month": "jan_2026", "regions": ("PVVNL",), "schema_name": "a;b"}):
        with pytest.raises(SpecError):
            Family(**bad)


def test_limit_holds_per_member(tables):
    spec = QuerySpec(table=TABLE_PLACEHOLDER, select=("id",), sort=(Sort("id", "DESC"),), limit_rows=2)
    assert sorted(r[0] for r in union_family(spec, FAMILY, tables).collect()) == [2, 3, 12, 13]


def test_without_limit_the_union_is_sorted(tables):
    spec = QuerySpec(table="cm_master_data_feb_2020_kesco", select=("kind", "id"), sort=(Sort("kind"), Sort("id", "DESC")), limit_rows=0)
    found = [tuple(r) for r in union_family(spec, FAMILY, tables).collect()]
    assert found == [("A", 13), ("A", 11), ("A", 3), ("A", 1), ("B", 12), ("B", 10), ("B", 2), ("B", 0)]
    hidden = union_family(spec.with_(select=("id",)), FAMILY, tables)
    assert hidden.columns == ["id"] and [r[0] for r in hidden.collect()] == [13, 11, 3, 1, 12, 10, 2, 0]


def test_single_member_and_switched_off(tables):
    spec = QuerySpec(table=TABLE_PLACEHOLDER, select=("id",), limit_rows=0)
    off = Family("jan_2026", ("DVVNL", "PVVNL"), base_region="PVVNL", enabled=False)
    assert sorted(r[0] for r in union_family(spec, off, tables).collect()) == [10, 11, 12, 13]


def test_totals(tables):
    spec = QuerySpec(table=TABLE_PLACEHOLDER, select=("id",), filters=(Filter("kind", "=", "A"),), limit_rows=1)
    assert family_total(spec, FAMILY, tables).collect() == [(4,)]


def test_aggregates_stay_per_member(tables, rows):
    spec = QuerySpec(table=TABLE_PLACEHOLDER, select=("kind",), function_columns=(FunctionColumn("COUNT", "*", "n"),), limit_rows=0)
    assert rows(union_family(spec, FAMILY, tables)) == [("A", 2), ("A", 2), ("B", 2), ("B", 2)]


def test_reports(tables):
    spec = QuerySpec(table=TABLE_PLACEHOLDER, mode="REPORT", pivot=Pivot("id", "SUM", ("kind",), ("DISCOM",)), add_grand_total=True)
    df = union_family(spec, FAMILY, tables)
    assert df.columns == ["kind", "DVVNL", "PVVNL"]
    assert [tuple(r) for r in df.collect()] == [("A", 4, 24), ("B", 2, 22), ("GRAND TOTAL", 6, 46)]
    # Without the region among the keys both members fill the same cells: the later one shows.
    shared = spec.with_(pivot=Pivot("id", "MAX", (), ("kind",)), add_grand_total=False)
    assert [tuple(r) for r in union_family(shared, FAMILY, tables).collect()] == [(13, 12)]
    flat = spec.with_(pivot=Pivot("id", "MAX", ("kind",)), add_grand_total=False)
    assert [tuple(r) for r in union_family(flat, FAMILY, tables).collect()] == [("A", 3), ("A", 13), ("B", 2), ("B", 12)]


def test_sql_templates(spark, tables, rows):
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    text = "SELECT '{{DISCOM}}' AS d, max(id) AS m FROM {{MASTER_TABLE}}"
    assert rows(union_family_sql(spark, text, FAMILY)) == [("DVVNL", 3), ("PVVNL", 13)]
    literal = "SELECT id FROM cm_master_data_mar_2026_DVVNL m WHERE kind = 'A'"
    assert [r[0] for r in union_family_sql(spark, literal, FAMILY, order_by=("id",)).collect()] == [1, 3, 11, 13]
    assert rows(union_family_sql(spark, literal, FAMILY, limit_rows=1, order_by=("id",))) == [(1,), (11,)]


def test_partitioned_family_prunes(spark, tables, tmp_path):
    path = str(tmp_path / "family")
    for df in tables.values():
        df.selectExpr("*", "'jan_2026' AS month", "DISCOM AS region").write.mode("append").partitionBy("month", "region").parquet(path)
    find = family_of_partitions(spark.read.parquet(path), FAMILY, "region", "month")
    df = union_family(QuerySpec(table=TABLE_PLACEHOLDER, select=("id",), limit_rows=0), FAMILY, find)
    assert df.count() == 8
    assert "region#" in plan_of(df) and " IN (" in plan_of(df).split("PartitionFilters:")[1] and plan_of(df).count("FileScan") == 1
    assert "PartitionFilters:" in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(SpecError):
        find("other")


def test_one_scan_gives_what_the_branches_give(spark, rows):
    """Over one labelled dataset, members are read together; over single tables each by itself."""
    codes = ("DVVNL", "PVVNL", "KESCO")
    family = Family("jan_2026", codes)
    data = [(k, codes[k % 3] if k % 11 else "PUVNL", "AB"[k % 2], k % 7) for k in range(200)] + [(900, None, "A", 1)]
    df = spark.createDataFrame(data, "id int, DISCOM string, kind string, v int").repartition(5)
    whole = family_of_partitions(df, family, "DISCOM")
    apart = {family.table(code): df.filter(df.DISCOM == code) for code in codes}
    count = (FunctionColumn("COUNT", "*", "n"), FunctionColumn("SUM", "v", "s"))
    for spec in (
        QuerySpec(table=TABLE_PLACEHOLDER, select=("id", "kind"), limit_rows=0),
        QuerySpec(table=TABLE_PLACEHOLDER, select=("id",), sort=(Sort("v"), Sort("id", "DESC")), limit_rows=4),
        QuerySpec(table=TABLE_PLACEHOLDER, select=("id",), filters=(Filter("kind", "=", "A"),), sort=(Sort("v"), Sort("id")), limit_rows=0),
        QuerySpec(table=TABLE_PLACEHOLDER, select=("kind",), function_columns=count, limit_rows=0),
        QuerySpec(table=TABLE_PLACEHOLDER, select=("kind", "v"), function_columns=count, sort=(Sort("n", "DESC"), Sort("v"), Sort("kind")), limit_rows=3),
        QuerySpec(table=TABLE_PLACEHOLDER, function_columns=count, filters=(Filter("id", "<", 0),), limit_rows=0),
        QuerySpec(table=TABLE_PLACEHOLDER, select=("id",), sort=(Sort("id"),), limit_rows=5, offset=3),
    ):
        got, want = union_family(spec, family, whole), union_family(spec, family, apart)
        assert got.columns == want.columns and rows(got) == rows(want)
        if spec.sort and not spec.limit_rows:
            assert got.collect() == want.collect()
    assert family_total(QuerySpec(table=TABLE_PLACEHOLDER, filters=(Filter("kind", "=", "A"),)), family, whole).first()[0] == sum(
        r[1] in codes and r[2] == "A" for r in data
    )
    limited = union_family(QuerySpec(table=TABLE_PLACEHOLDER, select=("id",), sort=(Sort("id"),), limit_rows=5), family, whole)
    plan = limited._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Scan ExistingRDD") == 1


def test_names_in_literals_and_comments_stay(spark):
    family = Family("mar_2026", ("PVVNL", "DVVNL"), schema_name=None)
    text = """SELECT 'CM_master_data_jan_2025_DVVNL' AS a, "it''s CM_master_data_jan_2025_DVVNL" AS b, '{{DISCOM}}' AS c -- CM_master_data_jan_2025_DVVNL
              /* CM_master_data_jan_2025_DVVNL's */ FROM CM_master_data_jan_2025_DVVNL x JOIN `cm_master_data_feb_2020_kesco` y JOIN {{MASTER_TABLE}}"""
    found = family.in_text(text, "PVVNL")
    assert found.count("CM_master_data_jan_2025_DVVNL") == 4 and found.count("CM_master_data_mar_2026_PVVNL") == 3 and "'PVVNL' AS c" in found
