"""Chat formatting: conversations that begin alike are merged in a prefix tree, laid out depth-first."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tablemill.llm.shared import running
from tablemill.session import materialize

# The template. A turn is TURN, the role, a line break, the text and END.
TURN, END, TRAINED = "<|turn|>", "<|end|>", "assistant"
#: Pieces of a conversation that are sorted together hold so many turns.
PIECE_TURNS = 512
SEGMENT = re.compile(re.escape(TURN) + r"((?:[^\\\n]|\\.)*)\n(.*)" + re.escape(END), re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: Column) -> Column:
    """Backslashes doubled, and one put inside each control string of this and other usual templates.

    `<|`, `<s>`, `</s>`, `[INST]` and `[/INST]` therefore occur in no escaped text, and
    unescape() gives the text back.
    """
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(doubled, r"<(?=\||/?s>)", r"<\\"), r"\[(?=/?INST\])", r"[\\")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


@dataclass(frozen=True)
class Tree:
    """The formatted corpus, as written tables.

    segments: tree, chain, depth, start, end, position, loss_start, loss_end, formatted, ancestors
    One row per distinct prefix of any conversation, so shared turns appear once. `start` to
    `end` is the segment's place in the stream of its tree, in code points, depth-first;
    `position` is the position id of its first one, the following ones count up. Loss is on
    loss_start to loss_end of the stream (null: none). A code point attends to all of
    `ancestors` (array of start, end) and to its own segment up to itself.

    conversations: conv_id, key, tree, spans
    Where a conversation's turns are: array of (first, last, chain, start, end), depths
    first to last of a chain, in order.
    """

    segments: DataFrame
    conversations: DataFrame


def prefix_tree(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Tree:
    """Formats conversations given as one row per turn, ordered by turn, then role and text.

    Null roles and texts count as empty, null turns come first, and rows with a null
    conversation id are one conversation. Repeated rows are turns of their own. Other columns
    are ignored; an empty frame gives empty tables.

    A prefix is known by 128 bits over all its turns and their places, summed up by exclusive
    or, in pieces, so a conversation of any length is spread over tasks. The smallest
    conversation with a prefix represents it; the prefixes that one conversation represents
    follow each other and form a chain. Depth-first, a chain comes whole, then the chains that
    branch off it, the deepest branch first: the order of the lists of branchings, which is all
    that has to be sorted. A chain's list is as long as it has branchings above it.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("null"))
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    head = F.concat(F.lit(TURN), F.replace(escape(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), key.alias("key"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        head.alias("head"), escape(text).alias("body"),
    )
    rows = rows.withColumns({"size": F.length("head") + F.length("body") + len(END), "piece": F.coalesce(F.expr(f"turn div {PIECE_TURNS}"), F.lit(-(2**62)))})
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    rows = running(rows, ["key"], "piece", order, {"depth": F.lit(1).cast("long"), "position": F.col("size").cast("long")})
    rows = rows.withColumns({"piece": F.expr(f"depth div {PIECE_TURNS}"), **{f"own{k}": F.xxhash64(F.lit(k), "depth", "role", "text") for k in (1, 2)}})
    rows = running(rows, ["key"], "piece", ["depth"], {f"before{k}": F.col(f"own{k}") for k in (1, 2)}, F.bit_xor)
    rows = rows.withColumns({f"prefix{k}": F.col(f"own{k}").bitwiseXOR(F.col(f"before{k}")) for k in (1, 2)})
    rows = materialize(rows.select("conv_id", "key", "depth", "position", "role", "head", "body", "size", "prefix1", "prefix2"), "turns")

    prefix = ["depth", "prefix1", "prefix2"]
    rows = materialize(rows.join(rows.groupBy(*prefix).agg(F.min("key").alias("chain")), prefix).drop("prefix1", "prefix2"), "prefixes")
    # Deeper prefixes are shared by fewer conversations: along one, its representatives only grow.
    runs = rows.groupBy("key", "chain").agg(
        F.first("conv_id").alias("conv_id"), F.min("depth").alias("first"), F.max("depth").alias("last"), F.min("position").alias("from"),
        F.max(F.col("position") + F.col("size")).alias("to"),
    )
    runs = materialize(runs, "runs")
    branch = F.array_sort(F.collect_list(F.struct("first", "chain")))
    paths = runs.groupBy("key").agg(branch.alias("way"), F.max(F.when(F.col("key") == F.col("chain"), F.col("to") - F.col("from"))).alias("size"))
    way = F.transform("way", lambda b: F.struct((-b["first"]).alias("depth"), b["chain"].alias("chain")))
    chains = paths.where("size IS NOT NULL").select(F.col("key").alias("chain"), F.col("way")[0]["chain"].alias("tree"), way.alias("way"), "size")
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chains = materialize(chains.repartitionByRange(parts, "way").withColumn("part", F.spark_partition_id()), "chains")
    chains = running(chains, [], "part", ["way"], {"start": F.col("size")})
    roots = chains.where("chain = tree").select("tree", F.col("start").alias("root"))
    chains = materialize(chains.join(roots, "tree").select("chain", "tree", (F.col("start") - F.col("root")).alias("start")), "places")

    spans = runs.join(chains, "chain").select(
        "key", "conv_id", "tree", "first", "last", "chain", "start", (F.col("start") + F.col("to") - F.col("from")).alias("end"), "from"
    )
    listed = F.array_sort(F.collect_list(F.struct("first", "last", "chain", "start", "end")))
    conversations = materialize(spans.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.first("tree").alias("tree"), listed.alias("spans")), "conversations")
    above = conversations.select(
        F.col("key").alias("chain"),
        F.transform(F.slice("spans", 1, F.size("spans") - 1), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("above"),
    )
    own = rows.where("key = chain").join(runs.where("key = chain").select("chain", "from"), "chain").join(chains, "chain").join(above, "chain")
    start = F.col("start") + F.col("position") - F.col("from")
    chain_start = F.when(start > F.col("start"), F.array(F.struct(F.col("start").alias("start"), start.alias("end")))).otherwise(F.expr("array()"))
    loss = start + F.length("head")
    segments = own.select(
        "tree", "chain", "depth", start.alias("start"), (start + F.col("size")).alias("end"), "position",
        F.when(F.col("role") == TRAINED, loss).alias("loss_start"), F.when(F.col("role") == TRAINED, loss + F.length("body")).alias("loss_end"),
        F.concat("head", "body", F.lit(END)).alias("formatted"), F.concat("above", chain_start).alias("ancestors"),
    )
    return Tree(materialize(segments, "segments"), conversations)


def read_back(tree: Tree) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the formatted corpus alone.

    The turns of a conversation are found by its spans, brought together in order and digested
    one after the other, so none is ever held whole.
    """
    kind = tree.conversations.schema["conv_id"].dataType
    spans = tree.conversations.select("key", "conv_id", F.explode("spans").alias("s"))
    wanted = spans.select("key", "conv_id", F.col("s.chain").alias("chain"), F.explode(F.sequence("s.first", "s.last")).alias("depth"))
    found = wanted.join(tree.segments, ["chain", "depth"])
    found = found.select(
        "conv_id", "key", "depth", "formatted", (F.col("loss_start") - F.col("start")).cast("long").alias("a"), (F.col("loss_end") - F.col("start")).cast("long").alias("b")
    )
    longs, texts = ("n_turns", "loss_chars", "formatted_chars"), ("turns_sha256", "loss_sha256")
    schema = StructType([StructField("conv_id", kind), *[StructField(c, LongType()) for c in longs], *[StructField(c, StringType()) for c in texts]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, arrow = None, None
        state: list = []

        def row() -> pa.RecordBatch:
            own_id, counts, turns, loss = state
            values = [own_id, *counts, turns.hexdigest(), loss.hexdigest()]
            kinds = [arrow, *[pa.int64()] * 3, *[pa.string()] * 2]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=schema.names)

        for batch in batches:
            arrow = batch.schema.field(0).type
            for k in range(batch.num_rows):
                own_id, own_key, _, formatted, a, b = (c[k].as_py() for c in batch.columns)
                if own_key != key:
                    if key is not None:
                        yield row()
                    key, state = own_key, [own_id, [0, 0, 0], hashlib.sha256(), hashlib.sha256()]
                role, text = map(unescape, SEGMENT.fullmatch(formatted).groups())
                state[1][0] += 1
                state[1][2] += len(formatted)
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if a is not None:
                    learned = unescape(formatted[a:b])
                    state[1][1] += len(learned)
                    state[3].update(learned.encode("utf-8", "surrogatepass"))
        if key is not None:
            yield row()

    digests = found.repartition("key").sortWithinPartitions("key", "depth").mapInArrow(run, schema)
    return digests.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
