"""Near-duplicate documents by SimHash fingerprints and deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tablemill.llm.components import connected_components
from tablemill.llm.shared import free_name, sieve, sifted
from tablemill.session import materialize

SHINGLE, SEED, BITS = 3, 42, 64
#: Fingerprints link at so few differing bits: with two segments, one differs by one bit at most.
MOST_BITS = 2
SEGMENTS, SEGMENT_BITS = 2, 32
#: Buckets with more fingerprints are not paired but linked through cliques.
PAIRED_BUCKET = 256
#: Shingle hashes whose bits are counted at once.
COUNTED = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint as a signed number; zero for a text without words."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the ASCII white space only
    if not own:
        return 0
    shingle = min(shingle, len(own))
    joined, lengths = b" ".join(own), np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    counts, n = np.zeros(BITS, np.int64), len(own) - shingle + 1
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, COUNTED):
        to = min(k + COUNTED, n)
        spans = zip(starts[k:to].tolist(), ends[k + shingle - 1 : to + shingle - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; a null or wordless text has fingerprint zero."""
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = pa.array([fingerprint(texts[k].as_py()) for k in range(batch.num_rows)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["doc_id", "fp"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, StructType([StructField("doc_id", kind), StructField("fp", LongType())]))


def _variants(distinct: DataFrame) -> DataFrame:
    """(key, fp): each segment with each of its bits wiped out, the key naming segment and bit."""
    low = F.expr(f"fp & {2**SEGMENT_BITS - 1}L")
    own = F.when(F.col("w") < SEGMENT_BITS, low).otherwise(F.expr(f"shiftrightunsigned(fp, {SEGMENT_BITS})"))
    wiped = own.bitwiseAND(F.expr(f"~shiftleft(1L, w % {SEGMENT_BITS})"))
    each = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS * SEGMENT_BITS - 1))).alias("w"))
    return each.select((wiped + F.col("w").cast("long") * 2**SEGMENT_BITS).alias("key"), "fp")


def links(distinct: DataFrame, paired: int = PAIRED_BUCKET) -> DataFrame:
    """(a, b): links between fingerprints, given once each in `fp`, of at most two differing bits.

    Of two such fingerprints one segment differs by at most one bit, so they share the variant
    with that bit wiped out. The variants meet by equality; in buckets of up to `paired`
    members, pairs are verified on the full fingerprint. Members of larger buckets are linked
    without pairs: all their variants with two bits wiped out are taken, fingerprints that
    share one differ in those bits only, so at most four share it and each of them is linked to
    the smallest. Every pair within two bits is found in one way or the other; with large
    buckets the pair itself may be represented by a path.
    """
    each = _variants(distinct)
    # Counted with partial sums and joined, which splits a crowded bucket over tasks. Most
    # variants are alone in their bucket; a sieve keeps them from being moved for the join.
    shared = materialize(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    crowded = materialize(sifted(each, sieve(shared, "key"), "key", True).join(shared, "key"), "buckets")
    small = crowded.where(F.col("n") <= paired)
    a, b = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (F.expr("bit_count(a ^ b)") <= MOST_BITS)).select("a", "b")
    wiped = [(1 << i) | (1 << j) for j in range(BITS) for i in range(j)]
    masks = F.array(*[F.lit(m - ((m >> 63) << 64)).cast("long") for m in wiped])
    many = crowded.where(F.col("n") > paired).select("fp").distinct()
    cliques = many.select("fp", F.posexplode(masks).alias("w", "m")).select("w", F.expr("fp & ~m").alias("rest"), "fp")
    # At most four share a window here.
    least = cliques.withColumn("b", F.min("fp").over(Window.partitionBy("w", "rest"))).where("fp <> b")
    return pairs.union(least.select("fp", "b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", paired: int = PAIRED_BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every row.

    component_id is the smallest id of all documents reachable over links of at most two
    differing bits, null only if none of them has an id. Texts without words share fingerprint
    zero and are linked like any other. Copies meet as one fingerprint before anything is
    compared, so a group of any size costs one row there. Other columns are ignored; an empty
    frame gives an empty one.
    """
    table = materialize(fingerprints(df, id_col, text_col), "fingerprints")
    groups = table.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(links(groups.select("fp"), paired), "a", "b")
    groups = groups.join(parts, F.col("fp") == F.col("node"), "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    named = groups.select("fp", "component").join(firsts, "component").select("fp", "component_id")
    return table.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups_of: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """The rows of one document of each group of near duplicates, with all their columns.

    The groups come from `groups_of`, which gives doc_id and component_id for every row.
    The document with the smallest id stays. Of rows repeating that id one stays too. Where no
    document of the group has an id, one row stays: the one whose text has the smallest MD5.
    """
    key = free_name(df, "_key")
    # Rows without an id come after all others and are told apart by their texts.
    none = F.col(id_col).isNull()
    own = F.struct(none.alias("none"), F.col(id_col).alias("id"), F.when(none, F.md5(text_col)).alias("text"))
    rows = df.withColumn(key, own)
    own = F.count(F.when(F.col("doc_id") == F.col("component_id"), 1)).alias("n")
    # Most rows stay, and stay where they are: only those that a sieve of the others holds back are moved and joined.
    doubtful = materialize(groups_of(rows, key, text_col).groupBy("doc_id").agg(own).where("n <> 1").withColumnRenamed("doc_id", key), "doubtful")
    bits = sieve(doubtful, key)
    held = sifted(rows, bits, key, True)
    repeated = held.join(doubtful.where("n > 1").select(key), key, "left_semi").dropDuplicates([key])
    alike = held.join(doubtful.select(key), key, "left_anti")
    return sifted(rows, bits, key, False).unionByName(alike).unionByName(repeated).drop(key)
