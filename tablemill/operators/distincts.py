"""Exact distinct counts that can be united: of months, of members, of finer groups.

A count of distinct values can't be added to another one, but the sets behind them can be
united. A summary holds these sets. Whole numbers are kept by blocks of 32,768: as a bitmap of
4 KB where many of a block occur, as the list of their places in it where few do. Other values
are kept as they are. A summary stored per month answers for any choice of months without the
months' rows being read again.

Tasks drop repeated values before anything is shuffled. What one group holds in memory is one
block, whatever the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tablemill.errors import SpecError
from tablemill.plans.scope import column

VALUE, BLOCK, BITS, PLACES = "__value", "__block", "__bits", "__places"
# Places up to which a list is no larger than the bitmap: 2 bytes each against 4 KB.
FEW = 2048


def distinct_summary(df: DataFrame, groups: Sequence[str], name: str) -> DataFrame:
    """The sets of a column's values by group, nulls left out; a group of nulls alone has an empty set."""
    values = df.select(*map(column, groups), column(name).alias(VALUE)).distinct()
    if not isinstance(values.schema[VALUE].dataType, IntegralType):
        return values
    number = F.col(VALUE).cast("long")
    placed = values.select(
        *map(column, groups), F.bitmap_bucket_number(number).alias(BLOCK), F.bitmap_bit_position(number).cast("short").alias("__place"),
        F.lit(None).cast("binary").alias(BITS),
    )
    return _packed(placed, groups)


def unite_distinct(summaries: Sequence[DataFrame], groups: Sequence[str]) -> DataFrame:
    """The summary of all rows behind summaries of one column, by the same groups or by fewer of them."""
    if not summaries:
        raise SpecError("There are no summaries to unite.")
    kinds = {VALUE in s.columns for s in summaries}
    if len(kinds) > 1:
        raise SpecError("Summaries of whole numbers and of other values can't be united.")
    if kinds.pop():
        return reduce(DataFrame.unionByName, [s.select(*map(column, groups), VALUE) for s in summaries]).distinct()
    rows = reduce(DataFrame.unionByName, [s.select(*map(column, groups), BLOCK, BITS, PLACES) for s in summaries])
    # Sets are shuffled in their short form and only then taken apart.
    dealt = rows.repartition(*map(column, groups), BLOCK)
    return _packed(dealt.select(*map(column, groups), BLOCK, F.explode_outer(PLACES).alias("__place"), BITS), groups)


def _packed(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One row per group and block from single places and bitmaps."""
    keys = [*map(column, groups), F.col(BLOCK)]
    dealt = rows.repartition(*keys)
    nothing = F.lit(b"").cast("binary")
    both = dealt.groupBy(*keys).agg(
        F.bitmap_construct_agg(F.col("__place").cast("long")).alias("__single"),
        F.bitmap_or_agg(F.coalesce(F.col(BITS), nothing)).alias("__maps"),
        F.collect_set("__place").alias(PLACES),
        F.count(BITS).alias("__mapped"),
    )
    short = (F.col("__mapped") == 0) & (F.size(PLACES) <= FEW)
    halves = both.select(*keys, F.explode(F.array("__single", "__maps")).alias(BITS), F.when(short, F.col(PLACES)).alias(PLACES))
    whole = halves.groupBy(*keys).agg(F.bitmap_or_agg(BITS).alias(BITS), F.first(PLACES).alias(PLACES))
    return whole.select(*keys, F.when(F.col(PLACES).isNull(), F.col(BITS)).alias(BITS), PLACES)


def count_summary(summary: DataFrame, groups: Sequence[str], alias: str) -> DataFrame:
    """The distinct count of each of a summary's groups; without groups, one row."""
    keys = list(map(column, groups))
    return summary.groupBy(*keys).agg(F.coalesce(F.sum(_size(summary)), F.lit(0)).cast("long").alias(alias))


def _size(summary: DataFrame) -> Column:
    if VALUE in summary.columns:
        return F.col(VALUE).isNotNull().cast("int")
    return F.coalesce(F.size(PLACES).cast("long"), F.bitmap_count(BITS))
