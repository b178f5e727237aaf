"""Placement of rows on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm.shared import free_name

TABLE_SLOTS = 65_537


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int = TABLE_SLOTS) -> list[int]:
    """The shard number of every slot.

    A shard prefers the slots offset, offset + skip, offset + 2 skip and so on; since the
    number of slots is prime, that visits each of them. The shards take turns, each claiming
    the first slot of its order that is still free.
    """
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("Shards must be named, distinct and no more than the slots.")
    if not _is_prime(slots):
        raise ValueError(f"{slots} slots: the number must be prime.")
    at = [_number(f"offset/{name}") % slots for name in shards]
    skip = [_number(f"skip/{name}") % (slots - 1) + 1 if slots > 2 else 1 for name in shards]
    table, left = [-1] * slots, slots
    while left:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def table_frame(spark: SparkSession, shards: Sequence[str], slots: int = TABLE_SLOTS) -> DataFrame:
    """The lookup table as (slot, shard): one row per slot, so of a fixed size."""
    filled = ",".join(map(str, fill_table(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("slot", "k")).select(
        "slot", F.element_at(F.array(*map(F.lit, shards)), F.col("k").cast("int") + 1).alias("shard")
    )


def key_number(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts, the same in every engine; a null differs from an empty text."""
    text = F.concat_ws("/", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


@dataclass(frozen=True)
class ShardPlan:
    """Shards, table size, and from which share of all rows (of an even shard) a key is spread."""

    shards: tuple[str, ...]
    slots: int = TABLE_SLOTS
    hot_share: float = 0.5


def place(df: DataFrame, key: Sequence[str], plan: ShardPlan, spread_by: Sequence[str] = ()) -> DataFrame:
    """Adds `slot` and `shard` (replacing columns of those names).

    The key's number modulo the table size is the slot; the table is broadcast, as its size
    is a parameter and not that of the data. With `spread_by`, keys holding more than
    `hot_share` of an even shard's rows are placed by key and those columns together: there
    are fewer than shards / hot_share such keys, counted with partial sums, so they are
    broadcast too. Null keys are a key like any other; equal rows get equal places; an empty
    frame gives an empty one.
    """
    slot, shard = "slot", "shard"
    rows = df.drop(*[c for c in df.columns if c.lower() in (slot, shard) and c not in (*key, *spread_by)])
    number = key_number(*[F.col(c) for c in key])
    table = F.broadcast(table_frame(df.sparkSession, plan.shards, plan.slots))
    if spread_by:
        hot, own, total = free_name(df, "_hot"), free_name(df, "_key"), free_name(df, "_rows")
        rows = rows.withColumn(own, number)
        counts = rows.groupBy(own).agg(F.count("*").alias(total))
        least = counts.agg((F.sum(total) * plan.hot_share / len(plan.shards)).alias("_least"))
        frequent = counts.join(F.broadcast(least), F.col(total) > F.col("_least")).select(own, F.lit(True).alias(hot))
        rows = rows.join(F.broadcast(frequent), own, "left")
        number = F.when(F.col(hot), key_number(*[F.col(c) for c in (*key, *spread_by)])).otherwise(F.col(own))
        rows = rows.withColumn(slot, F.pmod(number, F.lit(plan.slots)).cast("int")).drop(hot, own)
    else:
        rows = rows.withColumn(slot, F.pmod(number, F.lit(plan.slots)).cast("int"))
    return rows.join(table, slot).select(*[c for c in rows.columns if c != slot], slot, shard)
