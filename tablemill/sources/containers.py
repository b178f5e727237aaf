"""Tables inside workbooks and archives.

Two Spark jobs: the first lists every table (archive member or sheet) with its header, the
second decodes each listed table in a task of its own. One large archive is therefore
spread by member, and rows are streamed in batches, never held whole.
"""

from __future__ import annotations

import gzip
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tablemill.errors import SpecError
from tablemill.functions.inference import infer_types
from tablemill.sources.files import InputFile, as_files, file_system
from tablemill.sources.heads import path_frame, record_batch, text_rows, unique_headers
from tablemill.sources.workbooks import Workbook

# File endings with tables in them, old workbook formats, provenance columns.
SUPPORTED = (".csv", ".xlsx", ".xls", ".xlsb", ".gz", ".zip")
LEGACY = (".xls", ".xlsb")
SOURCE_FILE = "SOURCE_FILE"
SOURCE_SHEET = "SOURCE_SHEET"
DEFAULT_SHEET = "Sheet1"
BATCH_ROWS = 10_000
_IN_MEMORY = 64 * 1024 * 1024


@dataclass(frozen=True)
class Item:
    """One table found inside a file: its archive member (-1 for none) and number there."""

    path: str
    member: int
    number: int
    label: str
    sheet: str
    header: tuple[str, ...]


def supported(name: str) -> bool:
    return name.lower().endswith(SUPPORTED)


def _walk(stream, name: str, label: str) -> Iterator[tuple[str, str, object]]:
    """Tables below an open stream, as label, sheet and a function that starts the rows."""
    lower = name.lower()
    if lower.endswith(LEGACY):
        raise SpecError(f"{label}: legacy workbooks are not read; save as .xlsx or CSV.")
    if lower.endswith(".csv"):
        yield label, DEFAULT_SHEET, lambda: text_rows(stream, ",")
    elif lower.endswith(".xlsx"):
        book = Workbook(_seekable(stream))
        for sheet in book.sheets:
            yield label, sheet, lambda sheet=sheet: book.rows(sheet)
    elif lower.endswith(".gz"):
        inner = name.rsplit("/", 1)[-1][:-3]
        if supported(inner):
            yield from _walk(gzip.GzipFile(fileobj=stream), inner, f"{label}::{inner}")
    elif lower.endswith(".zip"):
        for _, label_, sheet, start in _walk_zip(stream, label):
            yield label_, sheet, start


def _walk_zip(stream, label: str, only: int | None = None) -> Iterator[tuple[int, str, str, object]]:
    """Tables of a zip archive with their member's index; ``only`` opens that member alone."""
    archive = zipfile.ZipFile(_seekable(stream))
    for index, member in enumerate(archive.infolist()):
        if member.is_dir() or not supported(member.filename) or only not in (None, index):
            continue
        with archive.open(member) as part:
            for found in _walk(part, member.filename, f"{label}::{member.filename}"):
                yield index, *found


def _seekable(stream):
    """Zip directories sit at the end of a file, so nested streams are spooled first."""
    if not isinstance(stream, (gzip.GzipFile, zipfile.ZipExtFile)):
        return stream
    spool = tempfile.SpooledTemporaryFile(max_size=_IN_MEMORY)
    shutil.copyfileobj(stream, spool)
    spool.seek(0)
    return spool


def open_tables(path: str, only: int | None = None) -> Iterator[tuple[int, str, str, object]]:
    """Tables of a file, as archive member, label, sheet and row starter.

    The streams stay open until the iteration moves on or is closed.
    """
    name = path.rsplit("/", 1)[-1]
    system, inner, _ = file_system(path)
    with system.open_input_file(inner) as stream:
        if name.lower().endswith(".zip"):
            yield from _walk_zip(stream, name, only)
        else:
            for found in _walk(stream, name, name):
                yield -1, *found


def list_items(spark: SparkSession, files: list[InputFile]) -> list[Item]:
    """Every table in the files with its header; tables without any record are left out."""

    columns = {"path": pa.string(), "member": pa.int32(), "number": pa.int32(), "label": pa.string(),
               "sheet": pa.string(), "header": pa.list_(pa.string())}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = []
                numbers: dict[int, int] = {}
                for member, label, sheet, start in open_tables(path):
                    numbers[member] = numbers.get(member, -1) + 1
                    head = next(iter(start()), None)
                    if head:
                        found.append((path, member, numbers[member], label, sheet, [c or "" for c in head]))
                yield record_batch(columns, found)

    schema = "path string, member int, number int, label string, sheet string, header array<string>"
    rows = path_frame(spark, files).mapInArrow(read, schema).toLocalIterator()
    shared: dict[tuple[str, ...], tuple[str, ...]] = {}
    items = []
    for r in rows:
        header = tuple(r.header)
        items.append(Item(r.path, r.member, r.number, r.label, r.sheet, shared.setdefault(header, header)))
    return sorted(items, key=lambda item: (item.path, item.member, item.number))


def padded(row: list[str | None], width: int, label: str) -> list[str | None]:
    """A record filled to its header's width; cells beyond it are refused, blank ones aside."""
    if any(row[width:]):
        raise SpecError(f"{label}: a record has {len(row)} cells, its header {width}.")
    return row[:width] + [None] * (width - len(row))


def read_items(spark: SparkSession, items: list[Item], header: bool = True) -> DataFrame:
    """Rows of the listed tables as text, united by column name, behind two provenance columns."""
    if not items:
        raise SpecError("No readable table was found.")

    def names_of(cells: tuple[str, ...]) -> list[str]:
        return unique_headers(cells) if header else [f"column{i}" for i in range(len(cells))]

    columns: dict[str, str] = {}
    for item in items:
        for name in names_of(item.header):
            columns.setdefault(name.lower(), name)
    order = list(columns.values())

    def batch_of(label: str, sheet: str, names: list[str], rows: list[list[str | None]]) -> pa.RecordBatch:
        """Rows of one table in the united columns; blank cells are null."""
        cells = dict(zip((columns[n.lower()] for n in names), zip(*rows)))
        known = {name: [v or None for v in cells[name]] for name in order if name in cells}
        arrays = [pa.array([text] * len(rows), pa.string()) for text in (label, sheet)]
        arrays += [pa.array(known.get(name, [None] * len(rows)), pa.string()) for name in order]
        return pa.RecordBatch.from_arrays(arrays, [SOURCE_FILE, SOURCE_SHEET, *order])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch.to_pylist():
                tables = open_tables(place["path"], None if place["member"] < 0 else place["member"])
                _, label, sheet, start = next(islice(tables, place["number"], None))
                rows = iter(start())
                first = next(rows)
                names = names_of(tuple(c or "" for c in first))
                body = (padded(row, len(names), label) for row in (rows if header else chain([first], rows)))
                while chunk := list(islice(body, BATCH_ROWS)):
                    yield batch_of(label, sheet, names, chunk)
                tables.close()

    quoted = ", ".join("`" + c.replace("`", "``") + "` string" for c in [SOURCE_FILE, SOURCE_SHEET, *order])
    parts = max(1, min(len(items), 32 * spark.sparkContext.defaultParallelism))
    listed = spark.createDataFrame(
        [(i.path, i.member, i.number) for i in items], "path string, member int, number int"
    )
    return listed.repartition(parts).mapInArrow(read, quoted)


def read_zip(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """All tables in zip archives, nested archives included, labelled ``archive::member``."""
    return read_items(spark, list_items(spark, as_files(source)))


def read_xlsx(
    spark: SparkSession,
    source: str | list[str],
    sheet: str | None = None,
    header: bool = True,
    all_sheets: bool = False,
    infer: bool = True,
) -> DataFrame:
    """One sheet of a workbook with inferred types, or all sheets as text with provenance."""
    items = list_items(spark, as_files(source))
    if all_sheets:
        return read_items(spark, items, header)
    wanted = sheet.strip() if sheet and sheet.strip() else None
    chosen = [i for i in items if (i.sheet == wanted if wanted else i.number == 0 and i.member <= 0)]
    if not chosen:
        raise SpecError(f"No sheet {wanted!r}; found: {', '.join(i.sheet for i in items)}.")
    df = read_items(spark, chosen, header).drop(SOURCE_FILE, SOURCE_SHEET)
    return infer_types(df) if infer else df
