"""Sorting, limits and offsets.

Rows with equal sort keys are put in an order of their own, so that every page of a query is
cut from one and the same sequence: by where they are stored, or else by what they show.

A page behind an offset is sought, not counted off. A histogram of the sort keys with running
counts tells in which range of keys the page begins; the range is narrowed until its first row
is known by its keys. The page is then what comes at or after those keys, which is a filter
on the source. No task holds the skipped rows, and nothing is sorted but the keys in question.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DataType,
    DateType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

# Keys sought by sorting: within so many rows the first row of a page is found by a top-k of keys alone.
LEAF = 50_000
# Keys drawn for the bounds of a histogram, and the most bounds that are made of them.
DRAWN, BOUNDS = 2048, 127


def ordering(col: Column, direction: str) -> Column:
    """Nulls come last either way."""
    return col.asc_nulls_last() if direction == "ASC" else col.desc_nulls_last()


@dataclass(frozen=True)
class Key:
    """A sort key: a column of the frame that is sorted."""

    name: str
    direction: str
    kind: DataType

    @property
    def col(self) -> Column:
        return F.col(self.name)

    @property
    def ordered(self) -> Column:
        return ordering(self.col, self.direction)

    @property
    def reversed(self) -> Column:
        return self.col.desc_nulls_first() if self.direction == "ASC" else self.col.asc_nulls_first()

    @property
    def countable(self) -> bool:
        """Whether values of the key can come to the driver and back without loss."""
        return isinstance(self.kind, (NumericType, StringType, BooleanType, BinaryType, DateType, TimestampType, TimestampNTZType))

    @property
    def carried(self) -> Column:
        return F.unix_micros(self.col) if isinstance(self.kind, TimestampType) else self.col

    def literal(self, value: object) -> Column:
        if isinstance(self.kind, TimestampType):
            return F.timestamp_micros(F.lit(value))
        if isinstance(self.kind, TimestampNTZType):
            return F.lit(value.isoformat(" ", "microseconds")).cast(self.kind)
        return F.lit(bytes(value) if isinstance(self.kind, BinaryType) else value).cast(self.kind)

    def before(self, value: object) -> Column:
        """The key comes before a value."""
        return self.col < self.literal(value) if self.direction == "ASC" else self.col > self.literal(value)

    def behind(self, value: object) -> Column:
        """The key comes after a value; nulls come after all."""
        later = self.col > self.literal(value) if self.direction == "ASC" else self.col < self.literal(value)
        return later | self.col.isNull()

    def equal(self, value: object) -> Column:
        return self.col.isNull() if value is None else self.col == self.literal(value)


def sort_rows(df: DataFrame, keys: Sequence[Column], ties: Sequence[Column]) -> DataFrame:
    """Order rows by ``keys`` and rows that agree in them by ``ties``.

    A page near the start is a top-k and needs no shuffle. A full sort is split into ranges
    of the keys, and rows with equal keys cannot be split that way; the ties behind the keys
    let one frequent value be spread over many ranges.
    """
    return df.orderBy(*keys, *ties)


@dataclass(frozen=True)
class Bucket:
    """Rows in one range of a key: all with one value, or all strictly between two (None: open)."""

    low: object
    high: object
    single: bool
    null: bool
    rows: int
    earlier: int

    def holds(self, key: Key) -> Column:
        if self.null:
            return key.col.isNull()
        if self.single:
            return key.equal(self.low)
        inside = key.col.isNotNull()
        inside = inside & ~key.before(self.low) & (key.col != key.literal(self.low)) if self.low is not None else inside
        return inside & key.before(self.high) if self.high is not None else inside


@dataclass(frozen=True)
class KeyIndex:
    """A histogram of one key with running counts, in the key's order. May be kept and used for many pages."""

    buckets: tuple[Bucket, ...]

    def find(self, position: int) -> Bucket | None:
        return next((b for b in self.buckets if b.earlier <= position < b.earlier + b.rows), None)

    def save(self, spark: SparkSession, key: Key, path: str) -> None:
        """Write the buckets as a table, one row each, their bounds in the key's own type."""
        rows = [(b.low, b.high, b.single, b.null, b.rows, b.earlier) for b in self.buckets]
        carried = "long" if isinstance(key.kind, TimestampType) else key.kind.simpleString()
        shape = f"low {carried}, high {carried}, single boolean, null boolean, rows long, earlier long"
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KeyIndex:
        rows = spark.read.parquet(path).orderBy("earlier").collect()
        return cls(tuple(Bucket(r["low"], r["high"], r["single"], r["null"], r["rows"], r["earlier"]) for r in rows))


def key_index(rows: DataFrame, key: Key, keys: Sequence[Key]) -> KeyIndex:
    """Count the rows in ranges of a key, the bounds taken from a bounded draw of its values.

    The draw only decides how even the ranges are; the counts are of all rows. Every bound has
    a range of its own, so a frequent value is set apart, and there are at most twice BOUNDS
    ranges and one for nulls. Two passes over the keys; only the counts come to the driver.
    """
    dice = F.xxhash64(*[k.col for k in keys])
    drawn = rows.where(key.col.isNotNull()).select(key.col, dice.alias("__dice")).orderBy("__dice").limit(DRAWN)
    listed = [r[0] for r in drawn.select(key.name).distinct().orderBy(key.ordered).select(key.carried).collect()]
    step = max(1, -(-len(listed) // BOUNDS))
    bounds = listed[step // 2 :: step] if listed else []

    def number(low: int, high: int) -> Column:
        """The range of a value among the bounds, by halving."""
        if low == high:
            return F.lit(2 * low)
        middle = (low + high) // 2
        own = F.when(key.before(bounds[middle]), number(low, middle)).when(key.equal(bounds[middle]), F.lit(2 * middle + 1))
        return own.otherwise(number(middle + 1, high))

    last = 2 * len(bounds) + 1
    where = F.when(key.col.isNull(), F.lit(last)).otherwise(number(0, len(bounds)))
    counts = dict(map(tuple, rows.groupBy(where.alias("range")).agg(F.count(F.lit(1)).alias("n")).collect()))
    buckets, earlier = [], 0
    for k in range(last + 1):
        if counts.get(k):
            at = k // 2
            low = bounds[at] if k % 2 and k != last else (bounds[at - 1] if 0 < at and k != last else None)
            high = bounds[at] if k != last and at < len(bounds) else None
            buckets.append(Bucket(low, high, bool(k % 2 and k != last), k == last, counts[k], earlier))
            earlier += counts[k]
    return KeyIndex(tuple(buckets))


def first_of_page(rows: DataFrame, keys: Sequence[Key], position: int, index: KeyIndex | None = None) -> tuple[list, int] | None:
    """The key values of the row at a position, and how many rows with the same values come before it.

    Ranges that the position isn't in are left out level by level; within the last one, a top-k
    of the keys finds the row. None if there are no more than ``position`` rows.
    """
    level, rest = 0, position
    while rest > LEAF and level < len(keys):
        own = index if index is not None else key_index(rows, keys[level], keys)
        index = None
        bucket = own.find(rest)
        if bucket is None:
            return None
        rows = rows.where(bucket.holds(keys[level]))
        rest -= bucket.earlier
        level += bucket.single or bucket.null
    if level == len(keys):  # all rows left are equal in their keys
        row = rows.select(_values(keys)).first()
        return (list(row), rest) if row else None
    near = rows.orderBy(*[k.ordered for k in keys]).limit(rest + 1)
    groups = near.groupBy(*[k.col for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
    groups = groups.withColumn("__all", F.sum("__n").over(Window.partitionBy(F.lit(0))))
    last = groups.orderBy(*[k.reversed for k in keys]).limit(1).select(*_values(keys), "__n", "__all").first()
    if last is None or last["__all"] <= rest:
        return None
    return list(last)[:-2], last["__n"] - 1


def _values(keys: Sequence[Key]) -> list[Column]:
    return [k.carried.alias(f"__value_{i}") for i, k in enumerate(keys)]


def _from(keys: Sequence[Key], values: Sequence) -> Column:
    """Rows at or after the given key values; the first key by itself as well, which the scan can use."""
    later, same = F.lit(False), F.lit(True)
    for key, value in zip(keys, values):
        if value is not None:
            later = later | (same & key.behind(value))
        same = same & key.equal(value)
    return F.coalesce(later | same, F.lit(False))


def _first_key(key: Key, value: object) -> Column:
    return key.col.isNull() if value is None else key.equal(value) | key.behind(value)


def page_of(
    rows: DataFrame, keys: Sequence[Key], limit: int, offset: int, index: KeyIndex | None = None
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the order of ``keys``; a limit of 0 means all the rest.

    The order has to be total but for rows that are equal in all their columns. Behind keys of
    nested types, whose values can't be sought, the skipped rows are sorted with the page.
    """
    order = [k.ordered for k in keys]
    if offset and not all(k.countable for k in keys):
        rows = rows.orderBy(*order).offset(offset)
    elif offset:
        found = first_of_page(rows.select([k.col for k in keys]), keys, offset, index)
        if found is None:
            return rows.limit(0)
        values, skipped = found
        rows = rows.where(_first_key(keys[0], values[0]) & _from(keys, values)).orderBy(*order)
        rows = rows.offset(skipped) if skipped else rows
    else:
        rows = rows.orderBy(*order)
    return rows.limit(limit) if limit else rows
