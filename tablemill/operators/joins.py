"""Equi-joins that stay exact and balanced when one key holds much of the data.

Inner joins, and outer joins whose preserved side holds the hot key, are left to adaptive
execution: it splits a hot partition at run time. It cannot split the other side of an
outer join, because an unmatched row would then be emitted once per split. When that other
side is large, the outer join is written as an inner join, which can be split on both sides:

    left outer join  =  left  inner join  (right  +  one blank row per left key it lacks)

The lacking keys come from the distinct keys of both sides. These are combined before the
shuffle, so a hot key takes part as a single row, and only key columns are read for them.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tablemill.plans.scope import column, quoted

# Below this size a whole side fits into one ordinary task, so skew cannot hurt.
SPLIT_BYTES = 256 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate for a frame, or None where it cannot be asked."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:
        return None


def is_small(df: DataFrame, limit: int = SPLIT_BYTES) -> bool:
    """True only when the estimate proves the frame to be within ``limit`` bytes."""
    size = estimated_bytes(df)
    return size is not None and size <= limit


def equi_join(
    left: DataFrame,
    right: DataFrame,
    pairs: Sequence[tuple[str, str]],
    how: str,
    sources: Sequence[DataFrame] = (),
    key_source: DataFrame | None = None,
    split: bool | None = None,
) -> DataFrame:
    """Join on equal columns. All column names of the two sides must differ.

    ``sources`` are the base tables behind the side that an outer join may drop rows of;
    their sizes decide whether the split form is used unless ``split`` says so outright.
    ``key_source`` is a table that holds all keys of the preserved side, if there is one that
    is cheaper to read than that side itself.
    """
    if how in ("left", "right"):
        loose = right if how == "left" else left
        if split is None:
            split = not all(is_small(s) for s in (sources or [loose]))
        if split and _comparable(left, right, pairs):
            return _split_outer(left, right, pairs, how, key_source)
    return left.join(right, _equal(pairs), how)


def _comparable(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> bool:
    """True if both keys of every pair are of one type, or both are numbers."""
    kinds = [(left.schema[a].dataType, right.schema[b].dataType) for a, b in pairs]
    return all(x == y or isinstance(x, NumericType) and isinstance(y, NumericType) for x, y in kinds)


def _equal(pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(operator.and_, [column(a) == column(b) for a, b in pairs])


def _split_outer(
    left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str, key_source: DataFrame | None
) -> DataFrame:
    kept, loose = (left, right) if how == "left" else (right, left)
    kept_keys, loose_keys = zip(*(pairs if how == "left" else [(b, a) for a, b in pairs]))
    marks = [f"__key_{i}" for i in range(len(pairs))]
    keys = [column(n).alias(mark) for n, mark in zip(loose_keys, marks)]
    wanted = (key_source or kept).select([column(n).alias(f"__kept{mark}") for n, mark in zip(kept_keys, marks)])
    if key_source is not None:
        # Earlier outer joins may have blanked the keys, which the table itself does not show.
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.schema.fields]
        wanted = wanted.union(left.sparkSession.range(1).select(blank))
    wanted = wanted.distinct()
    present = loose.select(keys).distinct()
    lacking = wanted.join(present, _equal([(f"__kept{mark}", mark) for mark in marks]), "left_anti")
    # A row with a null key matches nothing. It is left out here, and the null keys of the
    # preserved side find their blank row by null-safe equality.
    usable = loose.na.drop("any", subset=[quoted(n) for n in loose_keys]).select("*", *keys)
    blanks = [F.lit(None).cast(f.dataType).alias(f.name) for f in loose.schema.fields]
    filled = usable.union(lacking.select(*blanks, *[column(f"__kept{mark}") for mark in marks]))
    same = reduce(operator.and_, [column(n).eqNullSafe(column(mark)) for n, mark in zip(kept_keys, marks)])
    first, second = (kept, filled) if how == "left" else (filled, kept)
    return first.join(second, same, "inner").select([column(c) for c in left.columns + right.columns])
