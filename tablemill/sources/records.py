"""Records of large delimited files with quoted line breaks, read by byte ranges in many tasks.

Whether a byte range begins inside a quoted cell depends on everything before it. So each
range is first read under both assumptions, which gives a small function: how it ends, and
how wide its records are, for either beginning. Those functions are composed along the file,
which tells how every range really begins. After that, each range is read by a task of its
own: it takes the records that begin in it, the last one to its end behind the range.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.session import materialize
from tablemill.sources.files import InputFile, file_system

#: Bytes of records that a task hands on at once.
BATCH_BYTES = 4 << 20
BOM = b"\xef\xbb\xbf"


@dataclass(frozen=True)
class Cells:
    """How one delimiter cuts lines into cells. A quote matters only at the beginning of a cell."""

    mark: bytes
    closed: re.Pattern[bytes]
    opened: re.Pattern[bytes]

    def follow(self, line: bytes, inside: bool) -> tuple[bool, int]:
        """Whether the next line begins inside a quoted cell, and the delimiters outside of quotes."""
        if b'"' not in line:
            return inside, 0 if inside else line.count(self.mark)
        bare = self.closed.sub(rb"\1", b'"' + line if inside else line)
        left_open = self.opened.search(bare)
        return left_open is not None, (bare[: left_open.end()] if left_open else bare).count(self.mark)


@lru_cache
def cells_of(mark: str) -> Cells:
    own = re.escape(mark.encode())
    closed = re.compile(rb"(^|" + own + rb')"[^"]*+(?:""[^"]*+)*+"')
    return Cells(mark.encode(), closed, re.compile(rb"(?:^|" + own + rb')"'))


def _lines(path: str, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """(position behind the line, line) of the lines that begin in a range, and with no end all that follow."""
    system, inner, _ = file_system(path)
    with system.open_input_file(inner) as raw:
        raw.seek(max(0, start - 1))
        stream = io.BufferedReader(raw, 1 << 20)
        at = start
        if start:
            at = start - 1 + len(stream.readline())
        while end is None or at < end:
            line = stream.readline()
            if not line:
                return
            begin, at = at, at + len(line)
            yield at, line[len(BOM) :] if begin == 0 and line.startswith(BOM) else line


@dataclass
class _Reading:
    """One range read under one assumption about its beginning."""

    inside: bool
    closed: bool = False  # a record ends in the range
    head: int = 0  # delimiters up to the first end of a record
    widest: int = 0  # the most cells of a record that lies in the range behind that
    tail: int = 0  # delimiters behind the last end of a record

    def take(self, line: bytes, cells: Cells) -> None:
        self.inside, found = cells.follow(line, self.inside)
        self.tail += found
        if self.inside:
            return
        if self.closed:
            self.widest = max(self.widest, self.tail + 1)
        else:
            self.closed, self.head = True, self.tail
        self.tail = 0

    def row(self) -> tuple:
        return self.inside, self.closed, self.head if self.closed else self.tail, self.widest, self.tail if self.closed else 0


def _ranges(spark: SparkSession, files: Iterable[InputFile], size: int) -> DataFrame:
    rows = [(f.path, f.size) for f in files]
    listed = spark.createDataFrame(rows, "path string, size long")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), F.lit(size).cast("long"))).alias("start")
    count = sum(max(1, -(-s // size)) for _, s in rows)
    return listed.select("path", "size", start).withColumn("end", F.least(F.col("start") + size, "size")).repartition(count)


def _reading_fields(name: str) -> dict[str, pa.DataType]:
    kinds = {"inside": pa.bool_(), "closed": pa.bool_(), "head": pa.int64(), "widest": pa.int64(), "tail": pa.int64()}
    return {f"{name}_{field}": kind for field, kind in kinds.items()}


def range_states(spark: SparkSession, files: Iterable[InputFile], marks: tuple[str, ...], size: int) -> DataFrame:
    """path, mark, start, end, inside, widest, lone: every byte range, and whether it begins inside a quoted cell.

    ``widest`` is the most cells of any record of the file, ``lone`` tells that it has carriage
    returns without a line feed. A written table with one row a range and delimiter.
    """
    fields = {"path": pa.string(), "mark": pa.string(), "start": pa.int64(), "end": pa.int64(), "lone": pa.bool_()}
    fields |= _reading_fields("out") | _reading_fields("in")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for place in batch.to_pylist():
                readings = [(m, cells_of(m), _Reading(False), _Reading(True)) for m in marks]
                lone = False
                for _, line in _lines(place["path"], place["start"], place["end"]):
                    lone = lone or line.count(b"\r") > line.endswith(b"\r\n")
                    for _, cells, outside, inside in readings:
                        outside.take(line, cells)
                        inside.take(line, cells)
                found += [(place["path"], m, place["start"], place["end"], lone, *o.row(), *i.row()) for m, _, o, i in readings]
            yield _as_batch(fields, found)

    kinds = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean"}
    shape = ", ".join(f"`{n}` {kinds[k]}" for n, k in fields.items())
    known = _ranges(spark, files, size).select("path", "start", "end").mapInArrow(read, shape)
    composed = known.groupBy("path", "mark").applyInPandas(_compose, "path string, mark string, start long, end long, inside boolean, widest long, lone boolean")
    return materialize(composed, "ranges")


def _as_batch(fields: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([] for _ in fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, fields.values())], list(fields))


def _compose(ranges: pd.DataFrame) -> pd.DataFrame:
    """The beginnings of one file's ranges, in order, from what each does to either beginning."""
    inside, carried, widest, begins = False, 0, 0, []
    ranges = ranges.sort_values("start")
    for row in ranges.itertuples(index=False):
        begins.append(inside)
        own = {n: getattr(row, f"{'in' if inside else 'out'}_{n}") for n in ("inside", "closed", "head", "widest", "tail")}
        if own["closed"]:
            widest = max(widest, carried + own["head"] + 1, own["widest"])
            carried = own["tail"]
        else:
            carried += own["head"]
        inside = bool(own["inside"])
    widest = max(widest, carried + 1) if inside else widest
    return ranges[["path", "mark", "start", "end"]].assign(inside=begins, widest=widest, lone=bool(ranges["lone"].any()))


def _records(path: str, start: int, end: int, inside: bool, cells: Cells) -> Iterator[bytes]:
    """The records that begin in a range, without their line ends; blank lines are none."""
    held: list[bytes] = []
    skipping, state = inside, inside
    for at, line in _lines(path, start, None):
        begin = at - len(line)
        if begin >= end and not held:
            return
        state, _ = cells.follow(line, state)
        if skipping:
            skipping = state
            continue
        held.append(line)
        if not state:
            record = b"".join(held)
            held = []
            record = record[:-1] if record.endswith(b"\n") else record
            record = record[:-1] if record.endswith(b"\r") else record
            if record:
                yield record
    if held:
        yield b"".join(held)


def read_records(states: DataFrame, paths: list[str], mark: str, header: bool) -> DataFrame:
    """path, record: every record of the files as text, without the first of each if that is a header."""
    spark = states.sparkSession
    wanted = spark.createDataFrame([(p,) for p in paths], "path string")
    ranges = states.where(F.col("mark") == mark).join(F.broadcast(wanted), "path").select("path", "start", "end", "inside")
    fields = {"path": pa.string(), "record": pa.string()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = cells_of(mark)
        for batch in batches:
            for place in batch.to_pylist():
                rows, size = [], 0
                first = header and place["start"] == 0
                for record in _records(place["path"], place["start"], place["end"], place["inside"], cells):
                    if first:
                        first = False
                        continue
                    rows.append((place["path"], record.decode("utf-8", "replace")))
                    size += len(record)
                    if size >= BATCH_BYTES:
                        yield _as_batch(fields, rows)
                        rows, size = [], 0
                yield _as_batch(fields, rows)

    return ranges.repartition(max(1, ranges.count())).mapInArrow(read, "path string, record string")
