"""Enrichment: rows looked up in a master table by keys compared as text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablemill.errors import SpecError
from tablemill.functions.casts import to_text
from tablemill.operators.joins import equi_join
from tablemill.plans.scope import column

Keys = Sequence[tuple[str, str]]
Join = Callable[[DataFrame, DataFrame, list[tuple[str, str]]], DataFrame]


@dataclass
class Enriched:
    """Enriched rows; the statistics fill in when the rows are written or collected."""

    rows: DataFrame
    observation: Observation

    def stats(self) -> dict[str, int]:
        seen = self.observation.get
        return {
            "matched_rows": seen["matched"],
            "unmatched_rows": seen["total"] - seen["matched"],
            "total_rows": seen["total"],
        }


def enrich(df: DataFrame, master: DataFrame, keys: Keys, fetch: Sequence[str]) -> Enriched:
    """Left join of ``df`` to ``master``: every row of ``df`` plus the fetched columns.

    ``keys`` pairs a column of ``df`` with one of ``master``. A master key that occurs
    several times repeats the row. A fetched name that ``df`` already has gets a suffix.
    """
    return enriched(df, master, keys, fetch, lambda left, right, pairs: equi_join(left, right, pairs, "left", [master]))


def enriched(df: DataFrame, master: DataFrame, keys: Keys, fetch: Sequence[str], join: Join, texts: Sequence[str] = ()) -> Enriched:
    """The enrichment by a given left join. ``texts`` are columns of ``master`` that hold its keys as text."""
    _check(df, master, keys, fetch)
    names = list(df.columns)
    added = _free_names(names, fetch)
    left = df.select("*", *[to_text(column(a), df.schema[a].dataType).alias(f"__l{i}") for i, (a, _) in enumerate(keys)])
    stored = texts or [b for _, b in keys]
    right = master.select(
        *[to_text(column(b), master.schema[b].dataType).alias(f"__r{i}") for i, b in enumerate(stored)],
        *[column(c).alias(f"__f{i}") for i, c in enumerate(fetch)],
        F.lit(True).alias("__hit"),
    )
    joined = join(left, right, [(f"__l{i}", f"__r{i}") for i in range(len(keys))])
    observation = Observation()
    joined = joined.observe(observation, F.count("__hit").alias("matched"), F.count(F.lit(1)).alias("total"))
    rows = joined.select(
        *[column(n) for n in names], *[column(f"__f{i}").alias(n) for i, n in enumerate(added)]
    )
    return Enriched(rows, observation)


def enrich_stats(df: DataFrame, master: DataFrame, keys: Keys) -> DataFrame:
    """Matched, unmatched and total rows of the enrichment, without building its rows.

    Both sides are counted per key before they meet, so a hot key is one row on each side.
    """
    _check(df, master, keys, ())
    left = df.groupBy(*[to_text(column(a)).alias(f"__l{i}") for i, (a, _) in enumerate(keys)])
    right = master.groupBy(*[to_text(column(b)).alias(f"__r{i}") for i, (_, b) in enumerate(keys)])
    pairs = [(f"__l{i}", f"__r{i}") for i in range(len(keys))]
    met = equi_join(
        left.agg(F.count(F.lit(1)).alias("__ln")), right.agg(F.count(F.lit(1)).alias("__rn")), pairs, "left", split=False
    )
    counts = met.agg(
        F.coalesce(F.sum(F.col("__ln") * F.col("__rn")), F.lit(0)).alias("matched_rows"),
        F.coalesce(F.sum(F.when(F.col("__rn").isNull(), F.col("__ln"))), F.lit(0)).alias("unmatched_rows"),
    )
    return counts.select("matched_rows", "unmatched_rows", (F.col("matched_rows") + F.col("unmatched_rows")).alias("total_rows"))


def _check(df: DataFrame, master: DataFrame, keys: Keys, fetch: Sequence[str]) -> None:
    if not keys:
        raise SpecError("Enrichment needs at least one pair of key columns.")
    for wanted, frame, what in (
        ([a for a, _ in keys], df, "uploaded data"),
        ([b for _, b in keys] + list(fetch), master, "master table"),
    ):
        missing = [name for name in wanted if name not in frame.columns]
        if missing:
            raise SpecError(f"Not in the {what}: {', '.join(missing)}. Available: {', '.join(frame.columns)}.")


def _free_names(taken: Sequence[str], wanted: Sequence[str]) -> list[str]:
    used = {name.lower() for name in taken}
    result = []
    for name in wanted:
        free, n = name, 0
        while free.lower() in used:
            n += 1
            free = f"{name}_{n}"
        used.add(free.lower())
        result.append(free)
    return result
