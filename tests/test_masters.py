import re

import pytest
from pyspark.sql import functions as F

from tablemill import QuerySpec, SpecError, build
from tablemill.operators.enrichment import enrich
from tablemill.operators.lookups import lookup_join
from tablemill.operators.masters import enrich_stored, heavy_keys, lookup_stored, open_master, store_master
from tablemill.sources.catalog import drop_object

BUCKETS = 8


@pytest.fixture
def master(spark):
    """A master of 400 accounts in two columns of keys; one account has no code."""
    rows = spark.range(400).select(
        F.col("id").cast("int").alias("account"), F.when(F.col("id") != 7, F.concat(F.lit("c"), F.col("id") % 5)).alias("code"),
        F.concat(F.lit("n"), F.col("id")).alias("name"),
    )
    yield rows
    for name in ("by_account", "by_both"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@pytest.fixture
def shuffled(spark):
    """Joins by shuffle only, as between large tables."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def plan(df):
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


def test_master_is_not_shuffled(spark, master, shuffled, rows):
    store_master(spark, "by_account", master, ["account"], BUCKETS)
    stored = open_master(spark, "by_account")
    assert (stored.keys, stored.texts, stored.buckets) == (("account",), ("account__text",), BUCKETS)
    month = spark.range(900).select(F.col("id").cast("string").alias("acct"), (F.col("id") * 2).alias("v"))
    got = enrich_stored(month, stored, [("acct", "account")], ["name"])
    assert len(re.findall(r"\bExchange\b", plan(got.rows))) == 1 and f"SelectedBucketsCount: {BUCKETS}" in plan(got.rows)
    want = enrich(month, master, [("acct", "account")], ["name"])
    assert rows(got.rows) == rows(want.rows)
    assert got.stats() == want.stats() == {"matched_rows": 400, "unmatched_rows": 500, "total_rows": 900}


@pytest.mark.parametrize("hot", ["5", None, "absent"])
def test_hot_keys_are_joined_apart(spark, master, shuffled, rows, hot):
    master = master.union(spark.range(300).select(F.lit(5).cast("int"), F.lit("c0"), F.concat(F.lit("again"), F.col("id"))))
    store_master(spark, "by_account", master, ["account"], BUCKETS)
    month = spark.range(600).select(F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).otherwise(F.lit(hot)).alias("acct"), "id")
    assert heavy_keys(month, ["acct"], BUCKETS) == [(hot,)]
    got = enrich_stored(month, open_master(spark, "by_account"), [("acct", "account")], ["name"])
    assert rows(got.rows) == rows(enrich(month, master, [("acct", "account")], ["name"]).rows)
    # The month is dealt to the buckets; both sides are shuffled for its hot keys, and for those of the master alone.
    assert len(re.findall(r"\bExchange\b", plan(got.rows))) == (3 if hot == "5" else 5)


def test_hot_key_is_dealt_over_tasks(spark, master, shuffled):
    store_master(spark, "by_account", master, ["account"], BUCKETS)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = enrich_stored(spark.range(800).select(F.lit(3).alias("acct"), "id"), open_master(spark, "by_account"), [("acct", "account")], ["name"])
        parts = got.rows.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(n for _, n in parts) == 800 and max(n for _, n in parts) < 600


def test_stored_lookup(spark, master, shuffled, rows):
    month = spark.range(500).select((F.col("id") % 450).alias("account"), F.col("id").alias("name"))
    store_master(spark, "by_account", master, ["account"], BUCKETS)
    got = lookup_stored(month, open_master(spark, "by_account"))
    want = lookup_join(month, master, "account")
    assert got.columns == want.columns == ["account", "name_x", "code", "name_y"] and rows(got) == rows(want)
    assert len(re.findall(r"\bExchange\b", plan(got))) == 1


def test_two_keys_in_any_order(spark, master, rows):
    store_master(spark, "by_both", master, ["code", "account"], 3)
    month = spark.createDataFrame([("c1", 1), ("c1", 1), ("c9", 1), (None, 7), (None, None), ("c2", None), ("c3", 8)], "c string, a long")
    got = enrich_stored(month, open_master(spark, "by_both"), [("a", "account"), ("c", "code")], ["name", "code"])
    assert rows(got.rows) == rows(enrich(month, master, [("a", "account"), ("c", "code")], ["name", "code"]).rows)
    empty = enrich_stored(month.limit(0), open_master(spark, "by_both"), [("a", "account"), ("c", "code")], ["name"])
    assert empty.rows.count() == 0 and empty.rows.columns == ["c", "a", "name"]


def test_key_text_is_hidden_and_other_keys_refused(spark, master):
    info = store_master(spark, "by_account", master, ["ACCOUNT"], 2)
    assert info.row_count == 400
    shown = build(QuerySpec(table="by_account", limit_rows=0), spark)
    assert shown.columns == ["account", "code", "name"] and shown.count() == 400
    with pytest.raises(SpecError):
        enrich_stored(master, open_master(spark, "by_account"), [("code", "code")], ["name"])
    with pytest.raises(SpecError):
        store_master(spark, "by_account", master, ["nope"])
    drop_object(spark, "by_account")
    master.write.saveAsTable("by_account")
    with pytest.raises(SpecError):
        open_master(spark, "by_account")
