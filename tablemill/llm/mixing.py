"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.shared import free_name, running, words
from tablemill.session import materialize

#: A source is repeated this often at most.
MOST_PASSES = 3
#: Pieces of the shuffled order hold about so many documents, pieces of the schedule so many slots.
PIECE_ROWS, PIECE_SLOTS = 20_000, 65_536
CELLS = 1_024


@dataclass(frozen=True)
class Mix:
    """The parts of a mix, all lazy over written tables.

    sources: source, weight, source_size, target, quota (the target in whole words), source_no
    documents: doc_id, source, size, source_no, source_size, target, start (of the document in
    its source's shuffled stream); a document with words is told by source_no and start
    schedule: slot, source_no, pass_no, block, start, end (the words of the stream a slot takes)
    """

    sources: DataFrame
    documents: DataFrame
    schedule: DataFrame
    block: int

    def taken(self) -> DataFrame:
        """doc_id, source, size, source_size, target, taken: one row per row of the input."""
        first, last = F.expr(f"start div {self.block}"), F.expr(f"(start + size - 1) div {self.block}")
        pieces = self.documents.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
        slots = self.schedule.select("source_no", "block", F.col("start").alias("_from"), F.col("end").alias("_to"))
        overlap = F.least("_to", F.col("start") + F.col("size")) - F.greatest("_from", "start")
        return (
            pieces.join(slots, ["source_no", "block"], "left")
            .withColumn("_n", F.when(F.col("_from").isNotNull(), F.greatest(overlap, F.lit(0))).otherwise(0))
            .groupBy("source_no", "start", "doc_id", "source", "size", "source_size", "target", "_row")
            .agg(F.sum("_n").cast("long").alias("taken"))
            .select("doc_id", "source", "size", "source_size", "target", "taken")
        )


def targets(sizes: DataFrame, weights: Column | None = None) -> DataFrame:
    """source, source_no, weight, source_size, target, quota for sizes given as (source, size).

    Sources in code point order, null last. A target stops at three times its source's size;
    the excess goes to the others by weight. That level is found in closed form: with the
    sources in the order in which they fill up, the first one that does not fill up under the
    level left by those before it gives the level of all that follow. One row per source.
    """
    by_name = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("source_no", by_name.cast("long"))
    table = table.withColumn("weight", (F.col("source_no") % 3 + 1 if weights is None else weights).cast("double"))
    most, everything = F.col("source_size") * MOST_PASSES, Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = Window.orderBy("_full_at", "source_no")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("_full_at", most / F.col("weight")).withColumns(
        {
            "_left": F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(before), F.lit(0)),
            "_weights": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    level = F.col("_left") / F.col("_weights")
    open_at = F.when(F.col("_full_at") >= level, F.struct("_full_at", "source_no", level.alias("level")))
    table = table.withColumn("_level", F.min(open_at).over(everything)["level"])
    target = F.least(most.cast("double"), F.coalesce(F.col("_level") * F.col("weight"), most.cast("double")))
    table = table.withColumn("target", target)
    return table.withColumn("quota", F.least(F.floor(F.col("target") + 0.5), most)).select(
        "source", "source_no", "weight", "source_size", "target", "quota"
    )


def _points(n: int, spark) -> DataFrame:
    """slot, at: the van der Corput sequence in base 2, scaled to whole numbers below n."""
    bits = max(1, (n - 1).bit_length())
    mirrored = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("long")
    return spark.range(n).toDF("slot").withColumn("at", F.floor(mirrored / float(2**bits) * n).cast("long"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 64) -> Mix:
    """Which words of which documents fill which slots of the mix.

    The words of a source form one stream, its documents shuffled by a hash of their id, cut
    into blocks of `block` words. As many slots as blocks are needed are dealt to the sources
    by low-discrepancy points in the cumulative weights; a source's slots, ranked, take its
    blocks in order, starting again at the end, until its quota is met. Where the points give
    a source too few slots, its last slot takes the blocks left; surplus slots stay empty.

    Reruns agree, whatever the partitioning. A null text has no words, a null id hashes like
    one of its own, a null source is a source. Rows that are equal in id, source and size get
    the places of each other. Documents without words are never taken. Only ids, sources and
    sizes are shuffled, no texts; other columns are ignored.
    """
    spark = df.sparkSession
    sized = df.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_shuffle"),
    )
    sized = materialize(sized, "sizes")
    sources = materialize(targets(sized.select("source", "size")), "sources")
    blocks = F.ceil(F.col("source_size") / block)
    rest = F.col("quota") - F.floor(F.col("quota") / F.greatest("source_size", F.lit(1))) * F.col("source_size")
    needed = F.floor(F.col("quota") / F.greatest("source_size", F.lit(1))) * blocks + F.ceil(rest / block)
    sources = sources.withColumns({"blocks": blocks, "needed": needed.cast("long")})
    last = Window.orderBy("source_no")
    spans = sources.where("needed > 0").withColumn("to", F.sum("needed").over(last)).withColumn("from", F.col("to") - F.col("needed"))

    counts = sized.agg(F.count("*").alias("n")).first()
    slots = spans.agg(F.coalesce(F.max("to"), F.lit(0))).first()[0]
    digits = 1
    while 16**digits * PIECE_ROWS < counts["n"]:
        digits += 1
    placed = sized.join(
        sources.select(F.col("source").alias("_source"), "source_no", "source_size", "target"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    placed = placed.withColumn("_piece", F.substring("_shuffle", 1, digits))
    placed = running(placed, ["source_no"], "_piece", ["_shuffle", "doc_id", "size"], {"start": F.col("size")})
    # Documents without words share a start; a number of their own keeps their rows apart.
    placed = placed.withColumn("_row", F.when(F.col("size") == 0, F.monotonically_increasing_id()).otherwise(F.lit(-1)))

    width = max(1, -(-slots // CELLS))
    cells = spans.withColumn("cell", F.explode(F.sequence(F.expr(f"from div {width}"), F.expr(f"(to - 1) div {width}"))))
    dealt = _points(slots, spark).withColumn("cell", F.expr(f"at div {width}"))
    dealt = dealt.join(cells.select("cell", "from", "to", "source_no"), "cell").where("at >= from and at < to").select("slot", "source_no")
    # Each source also gets a slot at the end, so that none goes without.
    dealt = dealt.union(spans.select(F.col("source_no") + slots, "source_no"))
    dealt = dealt.withColumns({"_piece": F.expr(f"slot div {PIECE_SLOTS}"), "_one": F.lit(1).cast("long")})
    ranked = running(dealt, ["source_no"], "_piece", ["slot"], {"rank": F.col("_one")})
    owned = dealt.groupBy("source_no").agg(F.sum("_one").alias("_slots"))
    facts = spans.select("source_no", "source_size", "quota", "blocks", "needed").join(owned, "source_no")
    ranked = ranked.join(facts, "source_no").where("rank < needed")
    upto = F.when(F.col("rank") == F.col("_slots") - 1, F.col("needed") - 1).otherwise(F.col("rank"))
    each = ranked.withColumn("rank", F.explode(F.sequence("rank", upto)))
    each = each.withColumns({"pass_no": F.expr("rank div blocks"), "block": F.col("rank") % F.col("blocks")})
    each = each.withColumn("start", F.col("block") * block)
    end = F.least(F.col("start") + block, F.col("source_size"), F.col("quota") - F.col("pass_no") * F.col("source_size"))
    schedule = each.withColumn("end", end).where("end > start").select("slot", "source_no", "pass_no", "block", "start", "end")
    return Mix(sources, placed, schedule, block)


def repeat(df: DataFrame, mixed: Mix, id_col: str = "doc_id") -> DataFrame:
    """The rows of the mixed frame, each as often as its document is taken whole.

    The end of a source's share cuts one document; it counts from one half on. How often is
    decided by id: rows that repeat an id share its average, so that it is the same in each run,
    and rows without an id count as repeating one. Columns of any name pass through; an empty
    frame gives an empty one.
    """
    key, times, copy = (free_name(df, n) for n in ("_id", "_times", "_copy"))
    often = mixed.taken().groupBy("doc_id").agg(F.sum("taken").alias("t"), F.sum("size").alias("n")).where("t > 0")
    often = often.select(F.col("doc_id").alias(key), F.floor(F.col("t") / F.col("n") + 0.5).cast("int").alias(times)).where(F.col(times) > 0)
    rows = df.join(often, F.col(id_col).eqNullSafe(F.col(key)))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(key, times, copy)
