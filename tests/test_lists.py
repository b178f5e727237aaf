import pytest
from pyspark.sql import functions as F

from tablemill import (
    Aggregate, Branch, CaseColumn, Filter, FunctionColumn, Join, JoinKey, QuerySpec, Sort, SpecError, build, fetch_page,
)
from tablemill.operators import paging
from tablemill.operators.joins import equi_join


@pytest.fixture(scope="module")
def tables(spark):
    master = spark.createDataFrame(
        [(1, "a", "D1", 10.0), (2, "b", "D1", None), (3, "c", "D2", 5.0)], "ACCT_ID int, NAME string, DIV_CODE string, AMT double")
    detail = spark.createDataFrame(
        [(1, 2, "open"), (1, 3, "shut"), (2, None, "open"), (9, 1, "lost")], "ACCT_ID int, RELATED_ID int, STATUS string")
    return {"master": master, "detail": detail, "dev.area.master": master}


def run(tables, **parts):
    parts.setdefault("limit_rows", 0)
    return build(QuerySpec(**parts), tables)


DETAIL = Join("detail", (JoinKey("ACCT_ID", "ACCT_ID"),), "LEFT")


def test_names_and_order(tables):
    df = run(tables, table="master", select=("NAME", "acct_id"),
             function_columns=(FunctionColumn("COALESCE", "AMT", "f"),),
             case_expressions=(CaseColumn("c", (Branch("AMT", ">", 6, "big"),), "small"),), sort=(Sort("NAME"),))
    assert df.columns == ["NAME", "ACCT_ID", "c", "f"]
    assert [tuple(r) for r in df.collect()] == [("a", 1, "big", 10.0), ("b", 2, "small", None), ("c", 3, "small", 5.0)]


def test_joined_star_and_qualified_names(tables):
    star = run(tables, table="master", joins=(DETAIL,))
    assert star.columns == ["ACCT_ID", "NAME", "DIV_CODE", "AMT", "ACCT_ID", "RELATED_ID", "STATUS"]
    assert star.count() == 4
    named = run(tables, table="master", select=("NAME", "detail.STATUS"), joins=(DETAIL,))
    assert named.columns == ["master.NAME", "detail.STATUS"]


def test_table_names_with_dots(tables):
    df = run(tables, table="dev.area.master", select=("dev.area.master.NAME",), filters=(Filter("dev.area.master.ACCT_ID", "=", 3),))
    assert [tuple(r) for r in df.collect()] == [("c",)]


def test_chain_with_one_table_twice(tables, rows):
    df = run(tables, table="master", select=("NAME", "d.STATUS", "m2.NAME"), joins=(
        Join("detail", (JoinKey("ACCT_ID", "ACCT_ID"),), "INNER", "d"),
        Join("master", (JoinKey("d.RELATED_ID", "ACCT_ID"),), "LEFT", "m2"),
    ))
    assert rows(df) == [("a", "open", "b"), ("a", "shut", "c"), ("b", "open", None)]


@pytest.mark.parametrize("parts", [
    {"select": ("nope",)},
    {"select": ("other.NAME",)},
    {"select": ("",)},
    {"joins": (Join("detail", (JoinKey("detail.ACCT_ID", "ACCT_ID"),)),)},
    {"joins": (Join("detail", (JoinKey("ACCT_ID", "master.ACCT_ID"),)),)},
    {"select": ("DIV_CODE",), "function_columns": (FunctionColumn("SUM", "AMT", "s"),), "sort": (Sort("NAME"),)},
    {"function_columns": (FunctionColumn("SUM", "*", "s"),)},
])
def test_unresolved_references_are_refused(tables, parts):
    with pytest.raises(SpecError):
        run(tables, table="master", **parts)


def test_right_join_keeps_unmatched_rows(tables, rows):
    df = run(tables, table="master", select=("NAME", "detail.STATUS"),
             joins=(Join("detail", (JoinKey("ACCT_ID", "ACCT_ID"),), "RIGHT"),))
    assert rows(df) == [("a", "open"), ("a", "shut"), ("b", "open"), (None, "lost")]


@pytest.mark.parametrize("how", ["left", "right"])
def test_split_outer_join_equals_the_plain_one(spark, rows, how):
    hot = [(0, i) for i in range(40)] + [(i, i) for i in range(20)] + [(None, -1), (None, -2)]
    a = spark.createDataFrame(hot, "ka int, a int")
    b = spark.createDataFrame([(0, 100), (0, 101), (5, 102), (99, 103), (None, 104)], "kb int, b int")
    for left, right, pair in ((a, b, ("ka", "kb")), (b, a, ("kb", "ka"))):
        plain = equi_join(left, right, [pair], how, split=False)
        split = equi_join(left, right, [pair], how, split=True)
        assert split.columns == plain.columns and rows(split) == rows(plain)


def test_split_join_sends_one_row_per_hot_key(spark):
    big = spark.range(0, 50_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k2"), F.col("id").alias("v"))
    few = spark.createDataFrame([(7, "hot"), (-1, "absent")], "k long, name string")
    df = equi_join(few, big, [("k", "k2")], "left", split=True)
    assert df.count() == 16_667 + 1 + 1 and df.filter("v is null").count() == 1


def test_aggregates_group_by_the_selection(tables, rows):
    df = run(tables, table="master", select=("DIV_CODE",), function_columns=(
        FunctionColumn("SUM", "AMT", "s"), FunctionColumn("COUNT", "*", "n"), FunctionColumn("COUNT", "AMT", "k"),
        FunctionColumn("COUNT_DISTINCT", "NAME", "d"), FunctionColumn("AVG", "AMT", "m")))
    assert rows(df) == [("D1", 10.0, 2, 1, 2, 10.0), ("D2", 5.0, 1, 1, 1, 5.0)]


def test_aggregate_without_selection_is_global(tables):
    assert run(tables, table="master", function_columns=(FunctionColumn("MAX", "AMT", "m"),)).collect() == [(10.0,)]


def test_explicit_grouping(tables, rows):
    df = run(tables, table="master", group_by=("DIV_CODE",), aggregates=(Aggregate("AMT", "SUM"), Aggregate("NAME", "MAX", "last")))
    assert df.columns == ["DIV_CODE", "SUM(AMT)", "last"] and rows(df) == [("D1", 10.0, "b"), ("D2", 5.0, "c")]
    assert rows(run(tables, table="master", group_by=("DIV_CODE",))) == [("D1",), ("D2",)]


def test_conditional_aggregate_reads_text_as_numbers(tables, rows):
    df = run(tables, table="master", select=("DIV_CODE",), case_expressions=(
        CaseColumn("total", (Branch("NAME", "=", "a", "AMT", "column"),), "2", "literal", "SUM"),
        CaseColumn("n", (Branch("NAME", "=", "a", "1"),), "", "literal", "COUNT")))
    assert rows(df) == [("D1", 12.0, 1), ("D2", 2.0, 0)]


def test_case_mixing_columns_and_text_is_text(tables, rows):
    df = run(tables, table="master", select=("ACCT_ID",), case_expressions=(
        CaseColumn("c", (Branch("AMT", "IS NULL", None, "none"), Branch("NAME", "=", "a", "ACCT_ID", "column")), "rest"),))
    assert rows(df) == [(1, "1"), (2, "none"), (3, "rest")]


def test_nulls_sort_last_both_ways(tables):
    for direction, expected in (("ASC", [5.0, 10.0, None]), ("DESC", [10.0, 5.0, None])):
        df = run(tables, table="master", select=("AMT",), sort=(Sort("AMT", direction),))
        assert [r[0] for r in df.collect()] == expected


def test_sort_by_alias_and_by_unselected_column(tables):
    df = run(tables, table="master", select=("DIV_CODE",), function_columns=(FunctionColumn("SUM", "AMT", "s"),), sort=(Sort("s"),))
    assert [r["DIV_CODE"] for r in df.collect()] == ["D2", "D1"]
    df = run(tables, table="master", select=("NAME",), sort=(Sort("ACCT_ID", "DESC"),))
    assert [r[0] for r in df.collect()] == ["c", "b", "a"]


def test_limit_and_offset(spark):
    tables = {"n": spark.range(0, 1000, 1, 7).withColumnRenamed("id", "v")}
    sort = (Sort("v", "DESC"),)
    page = build(QuerySpec(table="n", sort=sort, limit_rows=3, offset=10), tables)
    assert [r[0] for r in page.collect()] == [989, 988, 987]
    rest = build(QuerySpec(table="n", sort=sort, limit_rows=0, offset=996), tables)
    assert [r[0] for r in rest.collect()] == [3, 2, 1, 0]
    assert build(QuerySpec(table="n", limit_rows=0, offset=1000), tables).count() == 0
    assert build(QuerySpec(table="n", limit_rows=0, offset=400), tables).count() == 600


def test_deep_offset_is_cut_in_place(spark, monkeypatch):
    monkeypatch.setattr(paging, "LEAF", 50)
    tables = {"n": spark.range(0, 500, 1, 9).withColumnRenamed("id", "v")}
    deep = build(QuerySpec(table="n", sort=(Sort("v"),), limit_rows=5, offset=321), tables)
    assert [r[0] for r in deep.collect()] == [321, 322, 323, 324, 325]
    # The page is exact whatever is done with it, not only when it is collected in order.
    assert sorted(r[0] for r in deep.repartition(3).collect()) == [321, 322, 323, 324, 325]
    wide = build(QuerySpec(table="n", sort=(Sort("v", "DESC"),), limit_rows=300, offset=51), tables)
    assert [r[0] for r in wide.collect()] == list(range(448, 148, -1))
    assert build(QuerySpec(table="n", sort=(Sort("v"),), limit_rows=300, offset=450), tables).count() == 50


def test_ties_are_ordered_alike_before_and_behind_a_deep_offset(spark, monkeypatch):
    tables = {"n": spark.range(0, 600, 1, 7).selectExpr("id % 3 AS v", "id AS w")}
    def page():
        return [tuple(r) for r in build(QuerySpec(table="n", select=("v", "w"), sort=(Sort("v"),), limit_rows=150, offset=120), tables).collect()]
    near = page()
    monkeypatch.setattr(paging, "LEAF", 50)
    assert page() == near and len(near) == 150
    first = build(QuerySpec(table="n", select=("v", "w"), sort=(Sort("v"),), limit_rows=120), tables).collect()
    assert not {tuple(r) for r in first} & set(near)


def test_page_counts(tables):
    page = fetch_page(QuerySpec(table="master", select=("NAME",), limit_rows=2), tables)
    assert page.info() == {"total": 3, "page_rows": 2, "truncated": True}
    grouped = QuerySpec(table="master", select=("DIV_CODE",), function_columns=(FunctionColumn("COUNT", "*", "n"),), limit_rows=0)
    assert fetch_page(grouped, tables).info() == {"total": 3, "page_rows": 2, "truncated": False}


def test_top_k_is_planned_as_one_operator(tables):
    plan = run(tables, table="master", select=("NAME",), sort=(Sort("AMT"),), limit_rows=2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_one_frequent_sort_value_is_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables = {"n": spark.range(0, 20_000, 1, 4).select(F.lit(1).alias("k"), F.col("id"))}
        df = build(QuerySpec(table="n", sort=(Sort("k"),), limit_rows=0), tables)
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 10_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("how", ["LEFT", "RIGHT"])
def test_large_optional_side_takes_the_split_form(tables, rows, monkeypatch, how):
    spec = QuerySpec(table="master", select=("NAME", "detail.STATUS"), limit_rows=0,
                     joins=(Join("detail", (JoinKey("ACCT_ID", "ACCT_ID"),), how),))
    plain = build(spec, tables)
    monkeypatch.setattr("tablemill.operators.joins.is_small", lambda df: False)
    split = build(spec, tables)
    assert "LeftAnti" in split._jdf.queryExecution().optimizedPlan().toString()
    assert split.columns == plain.columns and rows(split) == rows(plain)


@pytest.mark.parametrize("joins", [
    (("detail", "d", "LEFT", "ACCT_ID", "ACCT_ID"), ("master", "m2", "LEFT", "d.RELATED_ID", "ACCT_ID")),
    (("detail", "d", "RIGHT", "ACCT_ID", "ACCT_ID"), ("master", "m2", "LEFT", "master.ACCT_ID", "ACCT_ID")),
    (("detail", "d", "LEFT", "ACCT_ID", "ACCT_ID"), ("master", "m2", "RIGHT", "d.RELATED_ID", "ACCT_ID"), ("detail", "d2", "LEFT", "NAME", "STATUS")),
    (("detail", "d", "INNER", "ACCT_ID", "ACCT_ID"), ("detail", "d2", "LEFT", "d.ACCT_ID", "RELATED_ID"), ("master", "m2", "LEFT", "d2.ACCT_ID", "ACCT_ID")),
])
def test_chains_of_split_joins_equal_plain_ones(tables, rows, monkeypatch, joins):
    spec = QuerySpec(table="master", limit_rows=0, joins=tuple(
        Join(table, (JoinKey(a, b),), how, alias) for table, alias, how, a, b in joins))
    plain = build(spec, tables)
    monkeypatch.setattr("tablemill.operators.joins.is_small", lambda df: False)
    split = build(spec, tables)
    assert split.columns == plain.columns and rows(split) == rows(plain)


def test_split_join_on_two_keys_with_nulls(spark, rows):
    a = spark.createDataFrame([(1, "x", 1), (1, None, 2), (None, None, 3), (2, "y", 4), (1, "x", 5)], "a1 int, a2 string, a int")
    b = spark.createDataFrame([(1, "x", 1), (1, None, 2), (None, None, 3), (2, "z", 4)], "b1 long, b2 string, b int")
    for how in ("left", "right"):
        pairs = [("a1", "b1"), ("a2", "b2")]
        assert rows(equi_join(a, b, pairs, how, split=True)) == rows(equi_join(a, b, pairs, how, split=False))
