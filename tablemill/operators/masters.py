"""Master tables stored in buckets of their key, joined month after month without moving them.

A master that is written once in buckets of its key as text is already where a join on that
key needs it: only the month's rows are shuffled, to as many parts as there are buckets.

A bucket is read by one task, so keys that hold more than one bucket's fair share of either
side would fill a task. There are at most as many of them as buckets. Rows with such keys, null
among them, are joined on their own: the month's hot keys are salted, those of the master
alone are shuffled on both sides, where adaptive execution splits them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tablemill.errors import SpecError
from tablemill.operators.enrichment import Enriched, Keys, enriched
from tablemill.operators.joins import equi_join
from tablemill.operators.lookups import named_join
from tablemill.plans.scope import SHADOW, TEXT, column, lookup_table, quoted
from tablemill.sources.catalog import ObjectInfo, create_object


@dataclass(frozen=True)
class Master:
    """A stored master: its rows, the keys by their own names and as the columns of text that it is bucketed by."""

    rows: DataFrame
    keys: tuple[str, ...]
    texts: tuple[str, ...]
    buckets: int


def store_master(
    spark: SparkSession, name: str, df: DataFrame, keys: Sequence[str], buckets: int | None = None, replace: bool = False, month: str | None = None
) -> ObjectInfo:
    """Write a master table in buckets of its keys as text.

    Keys of other types get a column with their text beside them, which specifications don't
    show. ``buckets`` should be such that a bucket suits a task; by default it is the session's
    number of shuffle partitions.
    """
    known = {f.name.lower(): f for f in df.schema.fields}
    missing = [key for key in keys if key.lower() not in known]
    if missing or not keys:
        raise SpecError(f"A stored master needs key columns; missing: {', '.join(missing) or 'all'}.")
    texts, added = [], []
    for field in (known[key.lower()] for key in keys):
        text = field.name
        if not isinstance(field.dataType, StringType):
            text = f"{field.name}__{TEXT}"
            while text.lower() in known:
                text += "_"
            added.append(column(field.name).cast("string").alias(text, metadata={SHADOW: field.name, "kind": TEXT}))
        texts.append(text)
    number = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return create_object(spark, name, df.select("*", *added), replace=replace, month=month, buckets=(number, texts))


def open_master(spark: SparkSession, name: str) -> Master:
    """A stored master by name; other tables are refused."""
    rows = lookup_table(spark, name)
    told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {'.'.join(map(quoted, name.split('.')))}").collect()}
    texts = tuple(part.replace("``", "`") for part in re.findall(r"`((?:[^`]|``)+)`", told.get("Bucket Columns") or ""))
    if not texts:
        raise SpecError(f"{name!r} is not stored in buckets; write it with store_master.")
    keys = tuple(str(rows.schema[text].metadata.get(SHADOW, text)) for text in texts)
    return Master(rows, keys, texts, int(told["Num Buckets"]))


def enrich_stored(df: DataFrame, master: Master, keys: Keys, fetch: Sequence[str]) -> Enriched:
    """The same rows and statistics as ``enrich``, with the master read where it is stored.

    ``keys`` have to be those that the master is stored by. Runs two jobs ahead that read the key
    columns of both sides.
    """
    places = {b.lower(): a for a, b in keys}
    if len(places) != len(keys) or {k.lower() for k in master.keys} != set(places):
        raise SpecError(f"The master is stored by {', '.join(master.keys)}; join it on these.")
    ordered = [(places[b.lower()], b) for b in master.keys]
    return enriched(df, master.rows, ordered, fetch, lambda left, right, pairs: stored_join(left, right, pairs, master.buckets), master.texts)


def lookup_stored(df: DataFrame, master: Master) -> DataFrame:
    """The same rows as ``lookup_join``, with a lookup that is stored by its one key, a row per key."""
    if len(master.keys) != 1:
        raise SpecError("A lookup is stored by one key.")
    return named_join(
        df, master.rows, master.keys[0], master.texts[0], lambda left, right: stored_join(left, right, [("__match", "__key")], master.buckets)
    )


def stored_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], buckets: int) -> DataFrame:
    """Left join to a side that is stored in buckets of its keys, which are text on both sides."""
    own, stored = [a for a, _ in pairs], [b for _, b in pairs]
    often = set(heavy_keys(left, own, buckets))
    stored_often = set(heavy_keys(right, stored, buckets)) - often
    if not often | stored_often:
        return _in_place(left, right, pairs, buckets)
    in_left, in_right = _among(own, often | stored_often), _among(stored, often | stored_often)
    joined = _in_place(left.filter(~in_left), right.filter(~in_right), pairs, buckets)
    for keys, salts in ((often, buckets), (stored_often, 1)):
        if keys:
            joined = joined.union(_by_shuffle(left.filter(_among(own, keys)), right.filter(_among(stored, keys)), pairs, salts))
    return joined


def _by_shuffle(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], salts: int) -> DataFrame:
    """The join with both sides shuffled, so that adaptive execution may split or broadcast them.

    Marked keys are no longer those of the buckets, which would be read by one task each. With
    more than one salt, each key's rows on the left are dealt over that many parts, and its rows on
    the right go to all of them; there are few, unless the result is far larger still.
    """
    marks = [(f"__own_{i}", f"__stored_{i}") for i in range(len(pairs))]
    left = left.select("*", *[F.concat(column(a), F.lit("=")).alias(mark) for (a, _), (mark, _) in zip(pairs, marks)])
    right = right.select("*", *[F.concat(column(b), F.lit("=")).alias(mark) for (_, b), (_, mark) in zip(pairs, marks)])
    if salts > 1:
        marks.append(("__own_salt", "__stored_salt"))
        left = left.withColumn("__own_salt", F.monotonically_increasing_id() % salts)
        right = right.withColumn("__stored_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return equi_join(left, right, marks, "left").drop(*[name for pair in marks for name in pair])


def _in_place(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], buckets: int) -> DataFrame:
    dealt = left.repartition(buckets, *[column(a) for a, _ in pairs])
    return equi_join(dealt, right, pairs, "left", split=False)


def heavy_keys(df: DataFrame, names: Sequence[str], parts: int) -> list[tuple[str | None, ...]]:
    """Keys that hold more than one ``parts``-th of all rows: fewer than ``parts``, whatever the data."""
    counts = df.groupBy(*map(column, names)).agg(F.count(F.lit(1)).alias("__n"))
    total = df.count()
    return [tuple(row[:-1]) for row in counts.filter(F.col("__n") > F.lit(total) / parts).collect()]


def _among(names: Sequence[str], keys: set[tuple[str | None, ...]]) -> Column:
    """Whether the columns hold one of the keys; never null."""
    if len(names) == 1:
        return _any_of(names[0], {key[0] for key in keys})
    firsts = {}
    for key in keys:
        firsts.setdefault(key[0], set()).add(key[1:])
    found = F.lit(False)
    for first, rest in firsts.items():
        found = found | (_any_of(names[0], {first}) & _among(names[1:], rest))
    return found


def _any_of(name: str, values: set[str | None]) -> Column:
    texts = sorted(v for v in values if v is not None)
    found = F.coalesce(column(name).isin(texts), F.lit(False)) if texts else F.lit(False)
    return found | column(name).isNull() if None in values else found
