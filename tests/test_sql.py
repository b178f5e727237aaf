import pytest

from tablemill import QuerySpec, SpecError, build, run_sql
from tablemill.plans.sql import clean_sql, ensure_read_only


def test_cleaning():
    assert clean_sql(" /* AI_CONTEXT\nengine: x\n*/\nSELECT 1 ; ") == "SELECT 1"
    assert clean_sql("SELECT\u00a0\u2018a\u2019\u200b, \u201cb\u201d") == "SELECT 'a' , \"b\""
    assert clean_sql("/* AI_CONTEXT never closed") == "/* AI_CONTEXT never closed"
    for bad in ("", " ; ", "SELECT 1; SELECT 2", "SELECT '" + "x" * 50_000 + "'"):
        with pytest.raises(SpecError):
            clean_sql(bad)


@pytest.mark.parametrize("text", ["SELECT 1", "with a as (select 1) select * from a", "-- note\nSELECT 1", "/* a */ -- b\n select created_at from t"])
def test_reading_is_allowed(text):
    ensure_read_only(text)


@pytest.mark.parametrize("text", [
    "", "UPDATE t SET a = 1", "WITH a AS (SELECT 1) DELETE FROM t", "SELECT * FROM t FOR  UPDATE", "SELECT 'DROP'",
    "/* SELECT */ INSERT INTO t VALUES (1)", "SELECT 1 FROM t LOCK TABLE", "EXPLAIN SELECT 1",
])
def test_writing_is_refused(text):
    with pytest.raises(SpecError):
        ensure_read_only(text)


def test_run(spark):
    df = spark.range(3)
    assert run_sql(spark, "SELECT max(id) AS m FROM {n};", read_only=True, n=df).collect() == [(2,)]


def test_sql_report_gets_its_total(spark):
    spec = QuerySpec(execution_mode="sql", sql="SELECT * FROM VALUES ('a', 1), ('b', 2) AS t(k, n)", mode="REPORT", add_grand_total=True)
    assert [tuple(r) for r in build(spec, spark).collect()] == [("a", 1), ("b", 2), ("GRAND TOTAL", 3)]
    assert build(spec.with_(mode="LIST"), spark).count() == 2
