"""Tables and views in the session catalog."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

from tablemill.errors import SpecError
from tablemill.functions.months import label_of_previous, monthly_name, parse_month
from tablemill.plans.scope import column, quoted
from tablemill.plans.spec import NAME_RULE
from tablemill.sources.containers import read_xlsx
from tablemill.sources.delimited import read_csv, read_csv_set, read_tsv, with_headers
from tablemill.sources.files import resolve_inputs
from tablemill.sources.heads import DETECT
from tablemill.sources.parquet import read_parquet_set

KINDS = ("TABLE", "VIEW")
# Marks in the names of tables that are being written, or replaced.
FRESH, STALE = "__fresh_", "__stale_"
# How many rows a preview may show.
PREVIEW_ROWS = 10
MAX_PREVIEW_ROWS = 50


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    dtype: str
    nullable: bool


@dataclass(frozen=True)
class ObjectInfo:
    name: str
    kind: str
    columns: tuple[ColumnInfo, ...]
    row_count: int


def check_name(name: str) -> str:
    name = name.strip()
    if not NAME_RULE.fullmatch(name):
        raise SpecError(f"Object name {name!r} must be a letter or underscore, then letters, digits, underscores.")
    return name


def object_kind(spark: SparkSession, name: str) -> str | None:
    """TABLE, VIEW or None. Names are matched without regard to case."""
    kinds = ["VIEW" if "VIEW" in t.tableType or t.isTemporary else "TABLE"
             for t in spark.catalog.listTables() if t.name.lower() == name.strip().lower()]
    return kinds[0] if kinds else None


def create_object(
    spark: SparkSession,
    name: str,
    df: DataFrame,
    kind: str = "TABLE",
    replace: bool = False,
    month: str | None = None,
    buckets: tuple[int, list[str]] | None = None,
) -> ObjectInfo:
    """Create a table or view from a frame. Replacing may turn one kind into the other.

    A table is written and counted beside the object it replaces, which is read as before until
    the new one is complete; if the write fails, nothing has changed. The rows may come from
    the very table that is replaced. Master objects take their monthly name from ``month``.
    ``buckets``, a number and columns, stores a table in that many buckets of those columns,
    each sorted by them; see ``operators/masters.py``.
    """
    kind = kind.upper()
    if kind not in KINDS:
        raise SpecError("An object is a TABLE or a VIEW.")
    name = check_name(monthly_name(name, month))
    recover_object(spark, name)
    existing = object_kind(spark, name)
    if existing and not replace:
        raise SpecError(f"Object {name!r} already exists; ask for replace to overwrite it.")
    if kind == "VIEW":
        df.createOrReplaceTempView(name)
        if existing == "TABLE":
            spark.sql(f"DROP TABLE {_in_database(spark, name)}")
        return describe(spark, name)
    fresh = _beside(name, FRESH)
    try:
        _writer(df, buckets).saveAsTable(_in_database(spark, fresh))
        _analyse(spark, fresh)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {_in_database(spark, fresh)}")
        raise
    if existing == "VIEW":
        drop_object(spark, name)
    _swap(spark, fresh, name)
    return describe(spark, name)


def _writer(df: DataFrame, buckets: tuple[int, list[str]] | None) -> DataFrameWriter:
    if buckets is None:
        return df.write.format("parquet")
    number, names = buckets
    # Dealt as the buckets are, every bucket is one file.
    dealt = df.repartition(number, *map(column, names))
    return dealt.write.format("parquet").bucketBy(number, *names).sortBy(*names)


def _in_database(spark: SparkSession, name: str) -> str:
    """A table's name with its database, which no session view can stand for."""
    return f"{quoted(spark.catalog.currentDatabase())}.{quoted(name)}"


def _beside(name: str, mark: str) -> str:
    return f"{name}{mark}{uuid.uuid4().hex[:8]}"


def _rename(spark: SparkSession, old: str, new: str) -> None:
    spark.sql(f"ALTER TABLE {_in_database(spark, old)} RENAME TO {_in_database(spark, new)}")


def _swap(spark: SparkSession, fresh: str, name: str) -> None:
    """Give a complete table the name of another, which is dropped only after that."""
    stale = _beside(name, STALE) if object_kind(spark, name) else None
    if stale:
        _rename(spark, name, stale)
    try:
        _rename(spark, fresh, name)
    except BaseException:
        if stale:
            _rename(spark, stale, name)
        raise
    if stale:
        spark.sql(f"DROP TABLE {_in_database(spark, stale)}")


def recover_object(spark: SparkSession, name: str) -> None:
    """Put right what a run left that died while it replaced a table.

    If it died between two renames, the old table gets its name back. What else it left is dropped.
    """
    left = [t.name for t in spark.catalog.listTables() if re.fullmatch(rf"(?i){re.escape(name.strip())}({FRESH}|{STALE})[0-9a-f]{{8}}", t.name)]
    stale = [t for t in left if STALE in t]
    if stale and object_kind(spark, name) is None:
        _rename(spark, stale[0], name)
        left.remove(stale[0])
    for table in left:
        spark.sql(f"DROP TABLE {_in_database(spark, table)}")


def _analyse(spark: SparkSession, name: str) -> None:
    """Store a table's size and row count in the catalog. Spark forgets them when it writes to the table."""
    spark.sql(f"ANALYZE TABLE {_in_database(spark, name)} COMPUTE STATISTICS")


def stored_rows(spark: SparkSession, name: str) -> int | None:
    """The row count that the catalog holds for a table, or None; no rows are read."""
    told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {_in_database(spark, name)}").collect()}
    found = re.search(r"(\d+) rows", told.get("Statistics") or "")
    return int(found[1]) if found else None


def count_table(spark: SparkSession, name: str) -> int:
    """The row count of a table: the catalog's, or one that is counted and stored now."""
    rows = stored_rows(spark, name)
    if rows is None:
        _analyse(spark, name)
        rows = stored_rows(spark, name)
    return spark.table(_in_database(spark, name)).count() if rows is None else rows


def read_source(
    spark: SparkSession,
    source: str,
    header: bool = True,
    sheet: str | None = None,
    names: list[str] | None = None,
) -> DataFrame:
    """Any supported file, folder or pattern as a frame, with optional new column names."""
    files = resolve_inputs(source)
    ending = files[0].name.lower().removesuffix(".gz").rsplit(".", 1)[-1]
    if ending == "parquet":
        df = read_parquet_set(spark, files)
    elif ending == "xlsx":
        df = read_xlsx(spark, source, sheet, header)
    elif ending in ("xls", "xlsb"):
        raise SpecError("Legacy workbooks are not read; save as .xlsx or CSV.")
    elif len(files) == 1:
        df = read_tsv(spark, source, header) if ending == "tsv" else read_csv(spark, source, header)
    else:
        df = read_csv_set(spark, files, header, "\t" if ending == "tsv" else DETECT, infer=True)
    return with_headers(df, names) if names else df


def drop_object(spark: SparkSession, name: str) -> str:
    """Drop a table or view and return its kind."""
    kind = object_kind(spark, name)
    if kind is None:
        raise SpecError(f"Object {name.strip()!r} does not exist.")
    if kind == "TABLE":
        spark.sql(f"DROP TABLE {quoted(name.strip())}")
    elif not spark.catalog.dropTempView(name.strip()):
        spark.sql(f"DROP VIEW {quoted(name.strip())}")
    return kind


def describe(spark: SparkSession, name: str) -> ObjectInfo:
    """Columns of an object, and its row count if it is a table; views report 0.

    A table's rows are counted once and the count is kept in the catalog until Spark writes to it.
    """
    kind = object_kind(spark, name)
    if kind is None:
        raise SpecError(f"Object {name!r} does not exist.")
    df = spark.table(quoted(name))
    columns = tuple(ColumnInfo(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields)
    return ObjectInfo(name, kind, columns, count_table(spark, name) if kind == "TABLE" else 0)


def list_tables(spark: SparkSession) -> list[ObjectInfo]:
    """All tables and views by name."""
    names = sorted({t.name for t in spark.catalog.listTables()})
    return [describe(spark, name) for name in names]


def archive_master(spark: SparkSession, month: str) -> str | None:
    """Rename the table ``master`` to the label of the month before ``month``.

    Returns the new name, or None when there is no such table or the month is not a label.
    """
    first = parse_month(month) if "_" in month else None
    if first is None or object_kind(spark, "master") != "TABLE":
        return None
    name = f"master_{label_of_previous(first)}"
    if object_kind(spark, name) == "VIEW":
        drop_object(spark, name)
    _swap(spark, "master", name)
    return name


def preview(df: DataFrame, n: int = PREVIEW_ROWS, as_strings: bool = False) -> DataFrame:
    """The first rows of a frame, optionally as text with blanks for null."""
    if not 1 <= n <= MAX_PREVIEW_ROWS:
        raise SpecError(f"A preview shows 1 to {MAX_PREVIEW_ROWS} rows.")
    rows = df.limit(n)
    if not as_strings:
        return rows
    return rows.select([rows[quoted(c)].cast("string").alias(c) for c in rows.columns]).na.fill("")
