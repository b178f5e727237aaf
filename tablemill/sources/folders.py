"""Folder merge and column detection over many files."""

from __future__ import annotations

import glob
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablemill.errors import SpecError
from tablemill.plans.scope import column
from tablemill.sources.containers import (
    DEFAULT_SHEET,
    SOURCE_FILE,
    SOURCE_SHEET,
    list_items,
    open_tables,
    read_items,
    supported,
)
from tablemill.sources.delimited import blank_missing, scan, scan_groups, union_by_name
from tablemill.sources.exports import write_csv
from tablemill.sources.files import InputFile, as_files, clean_path, is_folder, list_files
from tablemill.sources.heads import COMMA_FIRST, path_frame, record_batch, unique_headers

# Rows looked at and samples kept per column when columns are detected.
DETECT_ROWS = 100
DETECT_SAMPLES = 5


@dataclass
class Merged:
    """A folder's rows and what they were merged from."""

    rows: DataFrame
    total_files: int
    merged_items: int

    @property
    def total_columns(self) -> int:
        return len(self.rows.columns)


def folder_files(folder: str, recursive: bool = True) -> list[InputFile]:
    path = clean_path(folder).rstrip("/")
    if not is_folder(path):
        raise SpecError(f"Source folder not found: {path}.")
    found = [f for f in list_files(glob.escape(path) + ("/**/*" if recursive else "/*")) if supported(f.name)]
    if not found:
        raise SpecError(f"No .csv, .xlsx, .gz or .zip files in {path}.")
    return found


def merge_frame(spark: SparkSession, folder: str, recursive: bool = True) -> Merged:
    """All tables of a folder as one text frame, united by column name.

    Plain and gzipped CSV go through Spark's own reader, a scan per distinct header;
    workbooks and archives are decoded table by table. Columns keep the order in which the
    sorted files first show them.
    """
    files = folder_files(folder, recursive)
    plain = [f for f in files if f.name.lower().endswith((".csv", ".csv.gz"))]
    boxed = [f for f in files if f not in plain]
    groups = scan_groups(spark, plain, sep=COMMA_FIRST) if plain else []
    items = list_items(spark, boxed) if boxed else []
    if not groups and not items:
        raise SpecError("No readable data was found in the folder.")

    parts = []
    for group in groups:
        rows = scan(spark, group).withColumnRenamed("filename", "__path")
        name = F.element_at(F.split("__path", "/"), -1)
        inner = F.when(F.lower(name).endswith(".gz"), F.concat(name, F.lit("::"), F.substring(name, F.lit(1), F.length(name) - 3)))
        parts.append(rows.select(
            F.coalesce(inner, name).alias(SOURCE_FILE), F.lit(DEFAULT_SHEET).alias(SOURCE_SHEET),
            *[column(n) for n in group.names],
        ))
    if items:
        parts.append(read_items(spark, items))

    headers = [(path, -1, 0, group.names) for group in groups for path in group.paths]
    headers += [(i.path, i.member, i.number, unique_headers(i.header)) for i in items]
    order: dict[str, str] = {}
    for *_, names in sorted(headers, key=lambda h: h[:3]):
        for name in names:
            order.setdefault(name.lower(), name)
    merged = union_by_name(parts).select(SOURCE_FILE, SOURCE_SHEET, *[column(n).alias(n) for n in order.values()])
    return Merged(blank_missing(merged, list(order.values())), len(files), len(headers))


def merge_folder(spark: SparkSession, folder: str, output: str, recursive: bool = True) -> dict[str, object]:
    """Merge a folder into CSV; the row count is taken while the rows are written."""
    merged = merge_frame(spark, folder, recursive)
    seen = Observation()
    write_csv(merged.rows.observe(seen, F.count(F.lit(1)).alias("rows")), output)
    return {
        "output_path": output,
        "output_format": "csv",
        "total_files": merged.total_files,
        "merged_items": merged.merged_items,
        "total_rows": seen.get["rows"],
        "total_columns": merged.total_columns,
    }


def detect_columns(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """Columns of every table in the files, each with up to five sample values.

    Only the first hundred records of a table are read. Columns: name, source_file,
    source_sheet, position, sample_values.
    """

    columns = {"name": pa.string(), "source_file": pa.string(), "source_sheet": pa.string(), "position": pa.int32(),
               "sample_values": pa.list_(pa.string())}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                for _, label, sheet, start in open_tables(path):
                    rows = iter(start())
                    names = unique_headers(next(rows, []))
                    body = list(islice(rows, DETECT_ROWS))
                    for at, name in enumerate(names):
                        cells = (row[at] for row in body if at < len(row) and row[at] not in (None, ""))
                        found.append((name, label, sheet, at, list(islice(cells, DETECT_SAMPLES))))
            yield record_batch(columns, found)

    schema = "name string, source_file string, source_sheet string, position int, sample_values array<string>"
    return path_frame(spark, as_files(source)).mapInArrow(read, schema)


def conflicting_columns(detected: DataFrame) -> DataFrame:
    """Names that occur in more than one table."""
    return detected.groupBy("name").agg(F.count(F.lit(1)).alias("tables")).filter("tables > 1")
