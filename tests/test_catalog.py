import datetime as dt
import os

import pytest

from tablemill import SpecError
from tablemill.sources.catalog import (
    archive_master, create_object, describe, drop_object, list_tables, object_kind, preview, read_source, stored_rows,
)
from tablemill.sources.delimited import read_csv_set
from tablemill.sources.exports import export_csv, first_table, representative, sample_once, slug
from tablemill.sources.imports import ColumnMap, import_csv
from tablemill.sources.relational import jdbc_options
from tablemill.streaming.ingest import expand_path, ingest


@pytest.fixture
def catalog(spark):
    """A catalog that is empty before and after the test."""

    def clear():
        for name in {t.name for t in spark.catalog.listTables()}:
            drop_object(spark, name)

    clear()
    yield spark
    clear()


def test_table_to_view_and_back(catalog):
    df = catalog.createDataFrame([(1, "Alice"), (2, "Bob")], "id int, name string")
    made = create_object(catalog, "People", df)
    assert (made.kind, made.row_count, [c.name for c in made.columns], made.columns[0].dtype) == ("TABLE", 2, ["id", "name"], "int")
    with pytest.raises(SpecError):
        create_object(catalog, "PEOPLE", df)
    assert create_object(catalog, "PEOPLE", df, "VIEW", replace=True).row_count == 0
    assert create_object(catalog, "people", df.limit(1), "TABLE", replace=True).row_count == 1
    assert [t.name for t in list_tables(catalog)] == ["people"]
    assert drop_object(catalog, "pEoPlE") == "TABLE" and object_kind(catalog, "people") is None
    for call in (lambda: drop_object(catalog, "people"), lambda: describe(catalog, "people"), lambda: create_object(catalog, "1x", df), lambda: create_object(catalog, "x", df, "INDEX")):
        with pytest.raises(SpecError):
            call()


def test_monthly_objects(catalog):
    df = catalog.range(1)
    assert create_object(catalog, "master", df, "VIEW", month="MAR_2026").name == "Master_0326"
    with pytest.raises(SpecError):
        create_object(catalog, "master", df)
    assert archive_master(catalog, "MAR_2026") is None
    df.write.saveAsTable("master")
    assert archive_master(catalog, "0326") is None
    assert archive_master(catalog, "MAR_2026") == "master_FEB_2026" and object_kind(catalog, "master") is None


def test_sources_by_ending(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,Alice\n2,\n")
    (tmp_path / "a.tsv").write_text("id\tname\n1\tAlice\n")
    assert read_source(spark, str(tmp_path / "a.tsv"), names=["k", "v"]).columns == ["k", "v"]
    df = read_source(spark, str(tmp_path / "a.csv"))
    assert preview(df, 1).count() == 1
    assert [tuple(r) for r in preview(df, as_strings=True).collect()] == [("1", "Alice"), ("2", "")]
    for n in (0, 51):
        with pytest.raises(SpecError):
            preview(df, n)
    (tmp_path / "a.xls").write_text("x")
    with pytest.raises(SpecError):
        read_source(spark, str(tmp_path / "a.xls"))


def test_import_with_a_column_map(catalog, tmp_path, rows):
    path = tmp_path / "in.csv"
    path.write_text("id,name,junk\n1,Alice,x\n2,NA,y\n")
    maps = [ColumnMap("id", "key"), ColumnMap("name", "name"), ColumnMap("junk", "", skip=True)]
    missing = import_csv(catalog, str(path), "people", maps)
    assert (missing.rows_inserted, missing.rows_skipped, missing.errors) == (0, 2, ["Target table does not exist."])
    assert import_csv(catalog, str(path), "people", maps, create=True).rows_inserted == 2
    assert import_csv(catalog, str(path), "people", maps).rows_inserted == 2
    assert catalog.table("people").columns == ["key", "name"]
    assert rows(catalog.table("people")) == [(1, "Alice"), (1, "Alice"), (2, None), (2, None)]
    with pytest.raises(SpecError):
        import_csv(catalog, str(path), "people", [])


def test_export_quotes_every_cell(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", x', None)], "id int, t string, n string").coalesce(1)
    export_csv(df, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert text == '"id","t","n"\n"1","say ""hi"", x",""\n'


def test_sampling(catalog, tmp_path):
    catalog.range(1500).write.saveAsTable("b_table")
    catalog.range(1).createOrReplaceTempView("a_view")
    assert first_table(catalog) == "b_table"
    path = str(tmp_path / "sample")
    assert sample_once(catalog.table("b_table"), path, "b_table") and not sample_once(catalog.range(1), path)
    assert read_csv_set(catalog, f"{path}/rows/*.csv", filename=False).count() == 1000
    assert '"rows_saved": 1000' in catalog.read.text(f"{path}/meta").first()[0]
    assert representative(["x", "MASTER_a", "CM_master_DVVNL", "b_master_dvvnl"]) == "CM_master_DVVNL"
    assert representative(["x", "z_master", "a_master"]) == "a_master" and representative([" x", "y"]) == "x"
    assert slug(" My file.db ") == "My_file_db" and slug("//") == "default"
    with pytest.raises(SpecError):
        representative([" "])


def test_jdbc_options():
    assert jdbc_options("jdbc:oracle:thin:@h:1/x", "S.T", {"user": "u"}) == {"url": "jdbc:oracle:thin:@h:1/x", "fetchsize": "10000", "user": "u", "dbtable": "S.T"}
    query = jdbc_options("jdbc:x:y", "SELECT a FROM t;", partition_column="a", bounds=(1, 9), partitions=4)
    assert query["dbtable"] == "(SELECT a FROM t) q" and query["numPartitions"] == "4"
    for bad in (("x", "t", {}), ("jdbc:x", " ", {}), ("jdbc:x", "DELETE FROM t", {}), ("jdbc:x", "t", {"partitions": 3})):
        with pytest.raises(SpecError):
            jdbc_options(bad[0], bad[1], **bad[2])


def test_new_files_are_taken_up_once(spark, tmp_path, rows):
    landing = tmp_path / expand_path("{PROFILE}/{MONTH}", dt.date(2026, 1, 5), "north")
    assert str(landing).endswith("north/DEC_2025") and expand_path("{DATE}", dt.date(2026, 1, 5)) == "05012026"
    with pytest.raises(SpecError):
        expand_path("{YEAR}", dt.date(2026, 1, 5))
    landing.mkdir(parents=True)
    target, marks = str(tmp_path / "out"), str(tmp_path / "marks")

    def run():
        ingest(spark, str(tmp_path / "north"), target, marks, "id string, note string", pattern="*.csv", files_per_batch=1,
               transform=lambda df: df.withColumn("size", df.id.try_cast("int")))
        return rows(spark.read.parquet(target).select("id", "note", "size"))

    (landing / "a.csv").write_text('id,note\n1,"x"\n')
    assert run() == [("1", "x", 1)]
    (landing / "b.csv").write_text("id,note\nz,y\n")
    (landing / "skip.txt").write_text("id,note\n9,9\n")
    assert run() == [("1", "x", 1), ("z", "y", None)] and run() == [("1", "x", 1), ("z", "y", None)]
    with pytest.raises(SpecError):
        ingest(spark, str(landing), target, marks, "id string", file_format="xml")


def test_a_failed_write_keeps_the_old_table(catalog, tmp_path):
    create_object(catalog, "kept", catalog.range(5))
    broken = catalog.range(100).selectExpr("assert_true(id < 50, 'no more') AS bad", "id")
    with pytest.raises(Exception, match="no more"):
        create_object(catalog, "kept", broken, replace=True)
    assert catalog.table("kept").count() == 5 and [t.name for t in list_tables(catalog)] == ["kept"]
    grown = catalog.table("kept").union(catalog.range(5, 8))  # from the table itself
    assert create_object(catalog, "KEPT", grown, replace=True).row_count == 8
    create_object(catalog, "seen", catalog.range(2), "VIEW")
    with pytest.raises(Exception, match="no more"):
        create_object(catalog, "seen", broken, replace=True)
    assert object_kind(catalog, "seen") == "VIEW" and catalog.table("seen").count() == 2


def test_what_a_dead_run_left_is_put_right(catalog):
    catalog.range(3).write.saveAsTable("t__stale_0123abcd")  # died between the renames
    catalog.range(4).write.saveAsTable("t__fresh_0123abcd")
    with pytest.raises(SpecError):
        create_object(catalog, "t", catalog.range(9))
    assert [(t.name, t.row_count) for t in list_tables(catalog)] == [("t", 3)]


def test_archiving_over_an_older_archive(catalog):
    catalog.range(1).write.saveAsTable("master_FEB_2026")
    catalog.range(2).write.saveAsTable("master")
    assert archive_master(catalog, "MAR_2026") == "master_FEB_2026" and catalog.table("master_FEB_2026").count() == 2
    assert [t.name.lower() for t in list_tables(catalog)] == ["master_feb_2026"]


def test_counts_are_kept_until_the_table_is_written(catalog):
    create_object(catalog, "counted", catalog.range(6))
    files = [f.removeprefix("file:") for f in catalog.table("counted").inputFiles()]
    for f in files:  # a count of the rows would fail
        os.rename(f, f + ".away")
    assert stored_rows(catalog, "counted") == 6 and [t.row_count for t in list_tables(catalog)] == [6]
    for f in files:
        os.rename(f + ".away", f)
    catalog.range(4).write.insertInto("counted")
    assert describe(catalog, "counted").row_count == 10 and stored_rows(catalog, "counted") == 10
