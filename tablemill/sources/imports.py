"""CSV import into a table through a column map."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from tablemill.errors import SpecError
from tablemill.functions.inference import infer_types
from tablemill.plans.scope import column, quoted
from tablemill.sources.catalog import check_name
from tablemill.sources.delimited import blank_missing, read_csv


@dataclass(frozen=True)
class ColumnMap:
    """One source column: its table column, or left out when ``skip`` is set."""

    csv_column: str
    db_column: str
    skip: bool = False


@dataclass(frozen=True)
class ImportResult:
    target_table: str
    rows_inserted: int
    rows_skipped: int = 0
    errors: list[str] = field(default_factory=list)


def import_csv(
    spark: SparkSession, source: str, table: str, mapping: Sequence[ColumnMap], create: bool = False
) -> ImportResult:
    """Append a CSV file to a table by position, or create the table.

    Unmapped columns keep their names. Appended values are cast to the table's types and
    a value that does not fit is an error. Rows are counted while they are written.
    """
    name = check_name(table)
    df = blank_missing(read_csv(spark, source, sep=",", infer=False))
    df = df.drop(*[m.csv_column for m in mapping if m.skip])
    df = df.withColumnsRenamed({m.csv_column: m.db_column for m in mapping if not m.skip})
    seen = Observation()
    count = F.count(F.lit(1)).alias("rows")
    if spark.catalog.tableExists(name):
        target = spark.table(name).schema.fields
        if len(target) != len(df.columns):
            raise SpecError(f"Table {name!r} has {len(target)} columns; the file brings {len(df.columns)}.")
        typed = df.select([column(c).cast(f.dataType).alias(f.name) for c, f in zip(df.columns, target)])
        typed.observe(seen, count).write.insertInto(name)
    elif create:
        infer_types(df).observe(seen, count).write.format("parquet").saveAsTable(quoted(name))
    else:
        return ImportResult(name, 0, df.count(), ["Target table does not exist."])
    return ImportResult(name, seen.get["rows"])
