"""Monthly cleaning: lookup tables, load conversion and labels for source rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.errors import SpecError
from tablemill.functions.casts import to_double
from tablemill.functions.months import label_of_previous
from tablemill.functions.units import load_kilowatts
from tablemill.operators.joins import equi_join, is_small
from tablemill.operators.places import reading_order
from tablemill.plans.scope import column
from tablemill.session import materialize

# Columns taken from the hierarchy lookup, by key.
DIVISION_KEY = "DIV_CODE"
DIVISION_COLUMNS = ("DISCOM", "CIR_SP_ID", "ZON_SP_ID", "DIV_NAME", "CIRCLE_NAME", "ZONE_NAME")
SUBDIVISION_KEY = "SUB_DIV_CODE"
SUBDIVISION_SOURCE_KEY = "SDO_SP_ID"
SUBDIVISION_COLUMNS = ("SDO_NAME",)
SUPPLY_KEY = "SUPPLY_TYPE"

# Stored bytes up to which a lookup is broadcast; beyond that it joins by shuffle.
BROADCAST_BYTES = 16 * 1024 * 1024


def first_rows(df: DataFrame, key: str, columns: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """One row per key: the first in ``order``, or in reading order when none is given.

    ``min_by`` combines before the shuffle, so a key with many copies sends one row per task.
    """
    numbered = df.select(
        column(key),
        F.struct(*[column(c) for c in columns], F.lit(1).alias("__one")).alias("__rest"),
        F.struct(*(order or reading_order(df))).alias("__place"),
    )
    best = numbered.groupBy(column(key)).agg(F.min_by("__rest", "__place").alias("__rest"))
    return best.select(column(key), *[F.col("__rest").getField(c).alias(c) for c in columns])


def lookup_join(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join on one shared key, compared as text.

    Other names on both sides become ``name_x`` (left) and ``name_y`` (lookup). The lookup
    is broadcast only if its size is known to be within bounds. Otherwise both sides are
    shuffled; a hot key then sits on the left, where adaptive execution splits it.
    """

    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        right = F.broadcast(right) if is_small(lookup, BROADCAST_BYTES) else right
        return equi_join(left, right, [("__match", "__key")], "left", split=False)

    return named_join(df, lookup, key, key, join)


def named_join(df: DataFrame, lookup: DataFrame, key: str, text: str, join: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The names of a lookup join, with a given join of ``__match`` on the left to ``__key``, both text.

    ``text`` is the lookup's column of the key, or of its text, which is not shown then.
    """
    kept = [c for c in lookup.columns if c.lower() not in (key.lower(), text.lower())]
    clash = {c.lower() for c in df.columns} & {c.lower() for c in kept}
    left = df.toDF(*[f"{c}_x" if c.lower() in clash else c for c in df.columns])
    right = lookup.select(
        column(text).cast("string").alias("__key"),
        *[column(c).alias(f"{c}_y" if c.lower() in clash else c) for c in kept],
    )
    left = left.withColumn("__match", column(key).cast("string"))
    return join(left, right).drop("__match", "__key")


def lookup_tables(
    hierarchy: DataFrame, supply: DataFrame, order: Sequence[Column] = (), places: Sequence[Column] | None = None
) -> dict[str, DataFrame]:
    """Division, sub-division and supply lookups by key, one row per key value.

    ``places`` is the order within the hierarchy, if it is another one.
    """
    places = order if places is None else places
    offices = first_rows(hierarchy, SUBDIVISION_SOURCE_KEY, SUBDIVISION_COLUMNS, places)
    details = [c for c in supply.columns if c != SUPPLY_KEY]
    return {
        DIVISION_KEY: first_rows(hierarchy, DIVISION_KEY, DIVISION_COLUMNS, places),
        SUBDIVISION_KEY: offices.withColumnRenamed(SUBDIVISION_SOURCE_KEY, SUBDIVISION_KEY),
        SUPPLY_KEY: first_rows(supply, SUPPLY_KEY, details, order),
    }


def lookup_enrich(
    df: DataFrame, hierarchy: DataFrame, supply: DataFrame, order: Sequence[Column] = ()
) -> DataFrame:
    """Add division, sub-division and supply columns, each where ``df`` has the key.

    The hierarchy serves two lookups, so where both are wanted the columns in question are
    written first, in one job, and it is computed once. Lookups without their duplicates are
    written too, unless their estimate is small: only that tells their size. A small one is
    then broadcast, and the rows are never shuffled by its few keys, which would leave a task
    with all rows of a key.
    """
    places: Sequence[Column] = order
    if DIVISION_KEY in df.columns and SUBDIVISION_KEY in df.columns:
        names = dict.fromkeys((DIVISION_KEY, SUBDIVISION_SOURCE_KEY, *DIVISION_COLUMNS, *SUBDIVISION_COLUMNS))
        place = F.struct(*(order or reading_order(hierarchy))).alias("__order")
        hierarchy = materialize(hierarchy.select(*map(column, names), place), "hierarchy")
        places = [F.col("__order")]
    for key, lookup in lookup_tables(hierarchy, supply, order, places).items():
        if key in df.columns:
            lookup = lookup if is_small(lookup, BROADCAST_BYTES) else materialize(lookup, "lookup")
            df = lookup_join(df, lookup, key)
    return df


def digits_only(df: DataFrame, name: str) -> DataFrame:
    """Keep rows whose column consists of digits only."""
    return df.filter(column(name).cast("string").rlike("^[0-9]+$"))


def with_fallbacks(df: DataFrame) -> DataFrame:
    """Add TOTAL_AMT and SUB_DIV_CODE from their source columns where they are missing."""
    if "BILLED_AMOUNT" in df.columns and "TOTAL_AMT" not in df.columns:
        amount = to_double(F.col("BILLED_AMOUNT"), df.schema["BILLED_AMOUNT"].dataType)
        df = df.withColumn("TOTAL_AMT", amount)
    if "SDO_CODE" in df.columns and SUBDIVISION_KEY not in df.columns:
        df = df.withColumn(SUBDIVISION_KEY, F.col("SDO_CODE").cast("string"))
    return df


def enrich_monthly(
    df: DataFrame,
    hierarchy: DataFrame,
    supply: DataFrame,
    as_of: dt.date,
    order: Sequence[Column] = (),
) -> DataFrame:
    """The whole monthly cleaning; see lookup_enrich for the jobs that are run ahead.

    Keeps rows with an all-digit ACCT_ID, joins the lookups, and adds LOAD_KW and MONTH
    (the month before ``as_of``).
    """
    missing = [c for c in ("ACCT_ID", "LOAD", "LOAD_UNIT") if c not in df.columns]
    if missing:
        raise SpecError(f"Monthly source rows need {', '.join(missing)}.")
    rows = digits_only(with_fallbacks(df), "ACCT_ID")
    rows = lookup_enrich(rows, hierarchy, supply, order)
    load = to_double(F.col("LOAD"), rows.schema["LOAD"].dataType)
    return rows.withColumn("LOAD_KW", load_kilowatts(load, F.col("LOAD_UNIT").cast("string"))).withColumn(
        "MONTH", F.lit(label_of_previous(as_of))
    )
