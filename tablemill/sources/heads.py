"""Headers, first rows and layout of many delimited files, read inside Spark tasks.

Each task opens its own files and reads only as far as it needs, so the cost depends on
the number of files, not on their size.
"""

from __future__ import annotations

import csv
import gzip
import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tablemill.sources.files import InputFile, file_system

SAMPLE_BYTES = 65536
# Delimiters tried when a file's own is not known.
DELIMITERS = (",", ";", "\t", "|")
# How a file's delimiter is found: judged from its first lines, or a comma unless that fails.
DETECT = "detect"
COMMA_FIRST = "comma first"


def record_batch(columns: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    """Rows of a task's output as one Arrow batch."""
    cells = zip(*rows) if rows else ([] for _ in columns)
    arrays = [pa.array(list(values), kind) for values, kind in zip(cells, columns.values())]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def path_frame(spark: SparkSession, files: Iterable[InputFile]) -> DataFrame:
    """The file list as a frame, spread so that tasks hold about one file each."""
    rows = [(f.path, f.relative, f.size) for f in files]
    frame = spark.createDataFrame(rows, "path string, relative string, size long")
    return frame.repartition(max(1, min(len(rows), 8 * spark.sparkContext.defaultParallelism)))


def open_binary(path: str):
    """A seekable, decompressed-if-gzip stream of a file, opened where it is used."""
    system, inner, _ = file_system(path)
    stream = system.open_input_file(inner)
    if stream.read(2) == b"\x1f\x8b":
        stream.seek(0)
        return gzip.GzipFile(fileobj=stream)
    stream.seek(0)
    return stream


def text_rows(stream, delimiter: str) -> Iterator[list[str]]:
    """Records of delimited text; blank lines are skipped."""
    lines = io.TextIOWrapper(stream, encoding="utf-8-sig", errors="replace", newline="")
    csv.field_size_limit(2**31 - 1)
    return (row for row in csv.reader(lines, delimiter=delimiter) if row)


def sniff(sample: str, prefer: str | None = None) -> str:
    """The delimiter that cuts the first lines into equal and most numerous cells.

    ``prefer`` is taken as long as no line has more cells than the first one.
    """
    widths = {mark: _widths(sample, mark) for mark in DELIMITERS}
    if prefer and max(widths[prefer], default=0) <= (widths[prefer] or [0])[0]:
        return prefer
    even = [mark for mark in DELIMITERS if widths[mark] and min(widths[mark]) == max(widths[mark]) > 1]
    return max(even, key=lambda mark: widths[mark][0], default=",")


def _widths(sample: str, mark: str) -> list[int]:
    return [len(row) for row in csv.reader(io.StringIO(sample, newline=""), delimiter=mark) if row][:20]


def candidates(sep: str) -> tuple[str, ...]:
    """The delimiters in question."""
    return DELIMITERS if sep in (DETECT, COMMA_FIRST) else (sep,)


def heads(spark: SparkSession, files: Iterable[InputFile], sep: str) -> DataFrame:
    """First record of every file that has one, by each delimiter in question: path, mark, cells, chosen.

    ``sep`` is a delimiter, ``DETECT`` or ``COMMA_FIRST``. ``chosen`` marks the delimiter that
    the file's beginning speaks for.
    """
    marks = candidates(sep)

    def delimiter(path: str) -> str:
        if sep not in (DETECT, COMMA_FIRST):
            return sep
        with open_binary(path) as stream:
            data = stream.read(SAMPLE_BYTES)
        if len(data) == SAMPLE_BYTES:
            data = data[: data.rfind(b"\n") + 1] or data
        return sniff(data.decode("utf-8-sig", errors="replace"), "," if sep == COMMA_FIRST else None)

    columns = {"path": pa.string(), "mark": pa.string(), "cells": pa.list_(pa.string()), "chosen": pa.bool_()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                best = delimiter(path)
                for mark in marks:
                    with open_binary(path) as stream:
                        first = next(text_rows(stream, mark), None)
                    if first:
                        found.append((path, mark, first, mark == best))
            yield record_batch(columns, found)

    return path_frame(spark, files).mapInArrow(read, "path string, mark string, cells array<string>, chosen boolean")


def record_widths(spark: SparkSession, files: Iterable[InputFile], marks: tuple[str, ...]) -> DataFrame:
    """path, widest: the most cells of any record, for each delimiter. Each file is read by one task."""
    columns = {"path": pa.string(), "widest": pa.list_(pa.int32())}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                widest = []
                for mark in marks:
                    with open_binary(path) as stream:
                        widest.append(max(map(len, text_rows(stream, mark)), default=0))
                found.append((path, widest))
            yield record_batch(columns, found)

    return path_frame(spark, files).mapInArrow(read, "path string, widest array<int>")


def wide_records(spark: SparkSession, files: list[tuple[str, str, int]]) -> DataFrame:
    """path, n: records with more cells than a width, for files given as path, delimiter and width."""
    columns = {"path": pa.string(), "n": pa.int64()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for place in batch.to_pylist():
                with open_binary(place["path"]) as stream:
                    found.append((place["path"], sum(len(row) > place["width"] for row in text_rows(stream, place["mark"]))))
            yield record_batch(columns, found)

    frame = spark.createDataFrame(files, "path string, mark string, width int")
    return frame.repartition(len(files)).mapInArrow(read, "path string, n long")


def unique_headers(names: Iterable[str | None]) -> list[str]:
    """Trimmed headers, blanks as ``Column_i``, repeats as ``name_2``, ``name_3``, ….

    Names that differ only by case count as repeats, since columns are matched that way.
    """
    seen: dict[str, int] = {}
    taken: set[str] = set()
    result = []
    for position, raw in enumerate(names, start=1):
        base = (raw or "").strip() or f"Column_{position}"
        number = seen.get(base.lower(), 0) + 1
        name = base if number == 1 else f"{base}_{number}"
        while name.lower() in taken:
            number += 1
            name = f"{base}_{number}"
        seen[base.lower()] = number
        taken.add(name.lower())
        result.append(name)
    return result
