import pytest
from pyspark.sql import functions as F

from tablemill import FunctionColumn, QuerySpec, Sort, SpecError
from tablemill.operators import distincts
from tablemill.operators.distincts import count_summary, distinct_summary, unite_distinct
from tablemill.operators.families import Family, family_distinct, family_of_partitions

EDGES = [0, 1, -1, 32767, 32768, 32769, -32768, -32769, 2**63 - 1, -(2**63), -(2**63) + 1]


@pytest.mark.parametrize("few", [distincts.FEW, 3, 0])
def test_whole_numbers(spark, rows, monkeypatch, few):
    monkeypatch.setattr(distincts, "FEW", few)
    dense = spark.range(5000).select(F.lit("dense").alias("g"), (F.col("id") % 4000).alias("v"))
    edges = spark.createDataFrame([("edge", v) for v in EDGES + EDGES[:4]] + [(None, 5), (None, 5), ("none", None)], "g string, v long")
    first, second = dense.filter("v < 3000"), dense.filter("v >= 2000").union(edges)
    sets = [distinct_summary(part, ["g"], "v") for part in (first, second)]
    assert rows(count_summary(sets[1], ["g"], "n")) == rows(second.groupBy("g").agg(F.count_distinct("v")))
    united = unite_distinct(sets, ["g"])
    assert rows(count_summary(united, ["g"], "n")) == [("dense", 4000), ("edge", len(EDGES)), ("none", 0), (None, 1)]
    # Sets of sets, and by no group: 0, 1, 32767 and so on are within the dense ones only in part.
    everything = {v for v in range(4000)} | set(EDGES) | {5}
    assert count_summary(unite_distinct([united, sets[0]], []), [], "n").collect() == [(len(everything),)]


def test_blocks_are_kept_in_the_shorter_form(spark):
    numbers = spark.range(1, 3001).union(spark.range(10**9, 10**9 + 5))
    forms = {r["n"]: r["bits"] for r in distinct_summary(numbers, [], "id").select(
        F.coalesce(F.size(distincts.PLACES).cast("long"), F.bitmap_count(distincts.BITS)).alias("n"), F.col(distincts.BITS).isNotNull().alias("bits")).collect()}
    assert forms == {3000: True, 5: False}


@pytest.mark.parametrize("kind", ["string", "double", "date"])
def test_other_values(spark, rows, kind):
    values = spark.range(40).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 7 != 0, F.date_add(F.lit("2020-01-01"), (F.col("id") % 9).cast("int"))).alias("day"), "id")
    values = values.select("g", F.col("day") if kind == "date" else F.unix_date("day").cast(kind).alias("day"))
    sets = [distinct_summary(values.filter(f"g = {g}"), ["g"], "day") for g in (0, 1)]
    assert rows(count_summary(unite_distinct(sets, ["g"]), ["g"], "n")) == rows(values.groupBy("g").agg(F.count_distinct("day")))
    assert count_summary(unite_distinct(sets, []), [], "n").collect() == values.agg(F.count_distinct("day")).collect()


def test_empty_and_mixed(spark):
    empty = distinct_summary(spark.range(0), [], "id")
    assert count_summary(empty, [], "n").collect() == count_summary(unite_distinct([empty, empty], []), [], "n").collect() == [(0,)]
    with pytest.raises(SpecError):
        unite_distinct([empty, distinct_summary(spark.createDataFrame([("a",)], "v string"), [], "v")], [])
    with pytest.raises(SpecError):
        unite_distinct([], [])


def test_family_is_one_set(spark, rows):
    family = Family("jan_2026", ("KESCO", "MVVNL"))
    data = spark.createDataFrame([("KESCO", "a", 1), ("KESCO", "a", 2), ("MVVNL", "a", 2), ("MVVNL", "b", 2), ("PVVNL", "b", 9)], "region string, kind string, acct int")
    spec = QuerySpec(table=family.table("KESCO"), select=("kind",), limit_rows=0, function_columns=(FunctionColumn("COUNT_DISTINCT", "acct", "accounts"),))
    apart = {family.table(r): data.filter(F.col("region") == r) for r in family.members}
    for tables in (apart, family_of_partitions(data, family, "region")):
        got = family_distinct(spec, family, tables)
        assert got.columns == ["kind", "accounts"] and rows(got) == [("a", 2), ("b", 1)]
    assert family_distinct(spec.with_(select=()), family, apart).collect() == [(2,)]
    with pytest.raises(SpecError):
        family_distinct(spec.with_(sort=(Sort("kind"),)), family, apart)
