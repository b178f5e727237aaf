"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The white space that parts words.
SPACE = r"[\x20\x09-\x0D]"
#: Words of 64 bits that a sieve has at most: the bound of what is broadcast, whatever the number of keys.
SIEVE_WORDS = 1 << 18


def words(text: Column) -> Column:
    """The maximal runs of characters other than white space; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once a row.

    A column that a lambda refers to is computed again for each element once the optimizer
    moves the expression into a filter; a lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """_word, _bits: one bit for each key, placed by a hash; a table of bounded size, for sifted()."""
    word, bit = _place(F.col(key))
    return keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def sifted(df: DataFrame, bits: DataFrame, key: str, there: bool) -> DataFrame:
    """The rows whose key may be among those of a sieve, or (not `there`) the rows whose key surely isn't.

    No row is moved. Keys that share a bit with another are told apart by a join of what may be there.
    """
    word, bit = _place(F.col(key))
    hit = (word == F.col("_word")) & (F.col("_bits").bitwiseAND(bit) != 0)
    return df.join(F.broadcast(bits), hit, "left_semi" if there else "left_anti")


def _place(key: Column) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    return F.pmod(F.shiftrightunsigned(h, 6), F.lit(SIEVE_WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def running(df: DataFrame, group: list[str], part: str, order: list, amounts: dict[str, Column], how: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Adds, by name, the sums of amounts over all earlier rows of the group, whatever its size.

    `part` cuts a group's order into consecutive pieces. Pieces are summed first (combined
    before the shuffle), the few sums are accumulated, and only rows of one piece are sorted
    together, so that a group with a third of all rows is still spread over many tasks. `how`
    is F.sum or F.bit_xor.
    """
    before = {out: f"__before_{k}" for k, out in enumerate(amounts)}
    pieces = df.groupBy(*group, part).agg(*[how(a).alias(before[out]) for out, a in amounts.items()])
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*group, part, *[F.coalesce(how(F.col(b)).over(earlier), F.lit(0)).alias(b) for b in before.values()])
    inside = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(pieces, [*group, part])
    own = {f"__in_{k}": F.coalesce(how(a).over(inside), F.lit(0)) for k, a in enumerate(amounts.values())}
    joined = joined.withColumns(own)
    for k, (out, b) in enumerate(before.items()):
        joined = joined.withColumn(out, _joined(F.col(b), F.col(f"__in_{k}"), how))
    return joined.drop(*before.values(), *own)


def _joined(a: Column, b: Column, how: Callable[[Column], Column]) -> Column:
    return a.bitwiseXOR(b) if how is F.bit_xor else a + b
