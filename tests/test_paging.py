"""Pages behind offsets: cut from one sequence whatever the types, ties, partitions and plans."""

import datetime as dt
import decimal
import random

import pytest
from pyspark.sql import functions as F

from tablemill import Join, JoinKey, QuerySpec, Sort, build, fetch_page
from tablemill.operators import paging
from tablemill.operators.lookups import first_rows
from tablemill.operators.paging import KeyIndex
from tablemill.operators.places import reading_order, with_address
from tablemill.plans.compile import page_index

TYPES = "n long, i int, d double, f float, s string, b boolean, day date, t timestamp, w timestamp_ntz, m decimal(20,4), raw binary, pair struct<x:int,y:string>"


@pytest.fixture
def small_leaf(monkeypatch):
    monkeypatch.setattr(paging, "LEAF", 60)
    monkeypatch.setattr(paging, "BOUNDS", 5)


@pytest.fixture(scope="module")
def typed(spark):
    draw = random.Random(1)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = []
    for k in range(400):
        moment = start + dt.timedelta(seconds=draw.randint(0, 60), microseconds=draw.randint(0, 9) * 111_111)
        own = [
            k % 7, draw.choice([0.5, -0.0, 0.0, float("nan"), float("inf"), float("-inf"), draw.random()]), draw.choice([0.1, 0.7, float("nan")]),
            draw.choice(["", "a", "Z", "é", "日", "a'b", "\\"]) + str(draw.randint(0, 20)), draw.random() < 0.3, dt.date(1900, 1, 1) + dt.timedelta(days=draw.randint(0, 90000)),
            moment, moment.replace(tzinfo=None) - dt.timedelta(days=30000), decimal.Decimal(draw.randint(-500, 500)) / 7, bytes([draw.randint(0, 255)]), (k % 3, "y"),
        ]
        rows.append((k, *[None if draw.random() < 0.1 else v for v in own]))
    return spark.createDataFrame(rows, TYPES).repartition(5)


@pytest.mark.parametrize(("name", "direction"), zip(["i", "d", "f", "s", "s", "b", "day", "t", "w", "m", "raw", "pair", "d"], ["ASC", "DESC"] * 7))
def test_every_type_of_key(typed, small_leaf, name, direction):
    tables = {"x": typed}
    sort = (Sort(name, direction), Sort("n"))
    col = F.col(name)
    whole = [r[0] for r in typed.orderBy(col.asc_nulls_last() if direction == "ASC" else col.desc_nulls_last(), "n").collect()]
    for offset, limit in ((137, 40), (380, 100)):
        got = build(QuerySpec(table="x", select=("n",), sort=sort, limit_rows=limit, offset=offset), tables)
        assert [r[0] for r in got.collect()] == whole[offset : offset + limit]
    if name in "ds":
        rest = build(QuerySpec(table="x", select=("n",), sort=sort, limit_rows=0, offset=251), tables)
        assert [r[0] for r in rest.collect()] == whole[251:]


def test_no_more_rows(typed, small_leaf):
    assert build(QuerySpec(table="x", select=("n",), sort=(Sort("i"),), limit_rows=5, offset=400), {"x": typed}).count() == 0
    assert build(QuerySpec(table="x", select=("n",), sort=(Sort("i"),), offset=4000), {"x": typed.limit(0)}).count() == 0


def stored(spark, path, rows, shape, files):
    spark.createDataFrame(rows, shape).repartition(files).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_pages_of_a_join_unite_at_any_partitioning(spark, tmp_path, small_leaf):
    """Rows alike in all that is shown but stored apart: every page plan gives each of them once."""
    left = stored(spark, tmp_path / "l", [(k % 10, k // 100) for k in range(300)], "key int, v int", 4)
    right = stored(spark, tmp_path / "r", [(k % 10, k % 2) for k in range(20)], "key int, w int", 3)
    joins = (Join("right", (JoinKey("key", "key"),), "LEFT"),)
    spec = QuerySpec(table="left", select=("key", "v", "right.w"), joins=joins, sort=(Sort("v"),), limit_rows=151)
    united, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for number, offset in enumerate(range(0, 700, 151)):
            spark.conf.set("spark.sql.shuffle.partitions", "3" if number % 2 else "11")
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if number % 3 else "10485760")
            united += [tuple(r) for r in build(spec.with_(offset=offset), {"left": left, "right": right}).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    whole = left.join(right, "key").select("key", "v", "w").collect()
    assert sorted(united) == sorted(map(tuple, whole)) and [r[1] for r in united] == sorted(r[1] for r in united)


def test_pages_without_addresses_and_of_equal_rows(spark, small_leaf):
    rows = [(k % 2, k % 5) for k in range(200)]
    spec = QuerySpec(table="x", sort=(Sort("a"),), limit_rows=30)
    united = []
    for number, offset in enumerate(range(0, 210, 30)):
        df = spark.createDataFrame(rows[number:] + rows[:number], "a int, b int").repartition(number + 1)
        united += [tuple(r) for r in build(spec.with_(offset=offset), {"x": df}).collect()]
    assert sorted(united) == sorted(rows) and [a for a, _ in united] == sorted(a for a, _ in rows)
    # Without a sort the first page is any rows, but those behind an offset are told apart.
    numbers = [spark.createDataFrame(list(enumerate(range(200))), "a int, b int").repartition(k + 1) for k in range(3)]
    behind = [r["b"] for k in (1, 2) for r in build(QuerySpec(table="x", limit_rows=70, offset=60 + 70 * (k - 1)), {"x": numbers[k]}).collect()]
    assert len(behind) == len(set(behind)) == 140


def test_a_kept_index_serves_all_pages(spark, tmp_path, small_leaf, monkeypatch):
    df = stored(spark, tmp_path / "t", [(k * 7919 % 1000, dt.datetime(2024, 1, 1, k % 24)) for k in range(1000)], "v int, at timestamp", 4)
    for name in ("v", "at"):
        spec = QuerySpec(table="t", sort=(Sort(name, "DESC"), Sort("v")), limit_rows=4)
        index = page_index(spec, {"t": df}, str(tmp_path / f"index-{name}"))
        assert sum(b.rows for b in index.buckets) == 1000
        kept = KeyIndex.load(spark, str(tmp_path / f"index-{name}"))
        whole = [r["v"] for r in df.orderBy(F.desc(name), "v").collect()]
        for offset in (3, 500, 996, 998):
            rows = fetch_page(spec.with_(offset=offset), {"t": df}, kept).rows
            assert [r["v"] for r in rows.collect()] == whole[offset : offset + 4]


def test_a_page_filters_the_scan(spark, tmp_path):
    df = stored(spark, tmp_path / "t", [(k,) for k in range(1000)], "v int", 2)
    page = build(QuerySpec(table="t", sort=(Sort("v"),), limit_rows=5, offset=700), {"t": df})
    plan = page._jdf.queryExecution().toString()
    assert "GreaterThan(v,700)" in plan and "TakeOrderedAndProject" in plan and [r[0] for r in page.collect()] == [700, 701, 702, 703, 704]


def test_first_rows_in_reading_order_behind_a_shuffle(spark, tmp_path):
    spark.range(0, 400, 1, 1).selectExpr("id % 20 AS key", "id AS v").sortWithinPartitions("v").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    for parts in (1, 5, 13):
        got = {r["key"]: r["v"] for r in first_rows(df.where("v >= 0").repartition(parts, "v"), "key", ["v"]).collect()}
        assert got == {k: k for k in range(20)}
    assert with_address(spark.range(3).toDF("v"), "f", "r") is None and len(reading_order(spark.range(3))) == 1
