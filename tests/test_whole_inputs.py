"""No cell, column or row order gets lost between files, streams and totals."""

import pytest
from pyspark.sql import functions as F

from tablemill import FunctionColumn, QuerySpec, SpecError, build
from tablemill.operators.totals import with_grand_total
from tablemill.sources.delimited import KEEP, read_csv_set
from tablemill.sources.heads import COMMA_FIRST
from tablemill.streaming.ingest import ingest, ingest_by_name


def test_wide_records_are_refused_by_name_and_count_or_kept(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("a,b\n" + "1,2\n" * 30 + "3,4,LOST\n5,6,,\n")
    with pytest.raises(SpecError, match=r"1 files: .*b\.csv \(2\)"):
        read_csv_set(spark, f"{tmp_path}/*.csv", filename=False)
    kept = read_csv_set(spark, f"{tmp_path}/*.csv", filename=False, wide=KEEP)
    assert kept.columns == ["a", "b", "Column_3", "Column_4"] and kept.count() == 33
    assert rows(kept.filter("Column_3 IS NOT NULL")) == [("3", "4", "LOST", None)]


def test_the_delimiter_follows_from_all_records(spark, tmp_path, rows):
    (tmp_path / "x.csv").write_text("id;note\n" + "1;plain\n" * 40 + "0;a, b, c\n")
    found = read_csv_set(spark, f"{tmp_path}/x.csv", filename=False, sep=COMMA_FIRST)
    assert found.columns == ["id", "note"] and rows(found.filter("id = 0")) == [("0", "a, b, c")]


def test_marks_and_line_breaks_in_quotes_are_no_cells(spark, tmp_path, rows):
    (tmp_path / "q.csv").write_text('a,b\n"1,5","x ""y"", z"\n')
    (tmp_path / "n.csv").write_text('a,b\n"1\n,,,5",2\n')
    found = read_csv_set(spark, f"{tmp_path}/*.csv", filename=False)
    assert rows(found) == [("1,5", 'x "y", z'), ("1\n,,,5", "2")]


def test_streams_match_headers(spark, tmp_path, rows):
    landing, target = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    for number, text in enumerate(("id,name\n1,x\n", "name,id\ny,2\n", "id,more\n3,z\n", "")):
        (landing / f"{number}.csv").write_text(text)
        ingest_by_name(spark, str(landing), target, str(tmp_path / "marks"), "id int, name string")
    assert rows(spark.read.parquet(target).select("id", "name")) == [(1, "x"), (2, "y"), (3, None)]
    with pytest.raises(Exception, match="(?i)header"):
        ingest(spark, str(landing), str(tmp_path / "other"), str(tmp_path / "others"), "id int, name string")


def test_totals_keep_order_in_many_partitions(spark):
    df = spark.range(20_000).select(F.lit("one").alias("k"), (20_000 - F.col("id")).alias("n")).repartition(8).orderBy("n")
    found = with_grand_total(df)
    assert [r["n"] for r in found.collect()] == [*range(1, 20_001), 200_010_000]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        for made in (with_grand_total(df), with_grand_total(df, order_by=("k",))):
            assert max(made.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()) < 10_001
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def test_repeated_aliases_are_columns_of_their_own(spark):
    df = spark.createDataFrame([(2,), (5,)], "v int")
    spec = QuerySpec(table="t", function_columns=(FunctionColumn("SUM", "v", "x"), FunctionColumn("MAX", "v", "x")))
    assert [tuple(r) for r in build(spec, {"t": df}).collect()] == [(7, 5)]
