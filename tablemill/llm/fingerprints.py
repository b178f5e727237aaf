"""Document fingerprints: a Merkle tree over sections, their paragraphs and the clauses in those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.shared import let
from tablemill.session import materialize

#: Hexadecimal digits of a branch that a fingerprint keeps; the root is kept whole.
BRANCH_DIGITS = 12
#: Parts of the order of ids, each of which is sorted by itself.
ORDER_PARTS = 64


# What ends a section, and what ends a clause within a paragraph, which is a line.
SECTION_END, LEAF_END = r"\n[ \t\r]*\n[ \t\n\x0B\f\r]*", r"[.!?:;,|]+[ \t\r]+"


def _parted(marked: Column) -> Column:
    """What stands between marks; the empty rest behind a last one is none."""
    return F.filter(F.split(marked, "\u0000"), lambda x, i: (x != "") | (i == 0))


def _pieces(text: Column, ends: str) -> Column:
    """The text cut behind each match of `ends`, nothing left out."""
    return _parted(F.regexp_replace(text, f"({ends})", "$1\u0000"))


def _joined(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, ""), 256)


def tree(text: Column) -> Column:
    """The tree as array<struct<hash, paragraphs: array<struct<hash, leaves: array<string>>>>>.

    Sections end at blank lines, paragraphs at line breaks, and leaves are the clauses of a
    paragraph: they end behind `.`, `!`, `?`, `:`, `;`, `,` or `|` and white space. A hash is
    the SHA-256 of what is below: of the text for a leaf, of the children's hashes for the
    others. Null counts as an empty text, which has one section of one paragraph of one empty
    leaf. NUL and \u0001 are written as two characters each before anything is cut or hashed,
    so texts that differ have different trees.
    """
    whole = F.replace(F.coalesce(text, F.lit("")), F.lit("\u0001"), F.lit("\u0001\u0002"))
    whole = F.replace(whole, F.lit("\u0000"), F.lit("\u0001\u0003"))

    def paragraph(p: Column) -> Column:
        leaves = F.transform(_pieces(p, LEAF_END), lambda x: F.sha2(x, 256))
        return F.struct(_joined(leaves).alias("hash"), leaves.alias("leaves"))

    def section(s: Column) -> Column:
        paragraphs = F.transform(_parted(F.replace(s, F.lit("\n"), F.lit("\n\u0000"))), paragraph)
        return F.struct(_joined(F.transform(paragraphs, lambda p: p["hash"])).alias("hash"), paragraphs.alias("paragraphs"))

    return F.transform(_pieces(whole, SECTION_END), section)


def fingerprint(branches: Column) -> Column:
    """`root:section=paragraph>leaf,leaf|paragraph>leaf;section=…`, branches by their first digits, the root in full."""
    short = lambda h: F.substring(h, 1, BRANCH_DIGITS)
    paragraph = lambda p: F.concat(short(p["hash"]), F.lit(">"), F.array_join(F.transform(p["leaves"], short), ","))
    section = lambda s: F.concat(short(s["hash"]), F.lit("="), F.array_join(F.transform(s["paragraphs"], paragraph), "|"))
    root = _joined(F.transform(branches, lambda s: s["hash"]))
    return F.concat(root, F.lit(":"), F.array_join(F.transform(branches, section), ";"))


def _below(branches: Column, mark: str) -> Column:
    """The distinct children of some branches, written behind their own digits and a sign."""
    return F.array_distinct(F.flatten(F.transform(branches, lambda b: F.split(F.substring(b, BRANCH_DIGITS + 2, 2_147_483_647), mark))))


def _leaves_of(branches: Column) -> Column:
    """How many leaves some branches have, children parted by commas and strokes."""
    one = lambda b: F.length(b) - F.length(F.translate(b, ",|", "")) + 1
    return F.aggregate(branches, F.lit(0), lambda n, b: n + one(b))


def compare(left: Column, right: Column) -> Column:
    """struct<likeness, sections, paragraphs, leaves> of two fingerprints, and how many branches of the left one differ.

    The comparison goes down from the roots and enters only branches that the other side
    doesn't have: of distinct sections in both, all leaves are shared; of the others the distinct
    paragraphs are compared, and the clauses only of paragraphs that differ. Likeness is 1 for
    equal roots, else the shared leaves by the leaves looked at of both sides, in six decimals.
    """

    def clauses(v: Column) -> Column:
        shared = v["shared"] + F.size(F.array_intersect(v["a"], v["b"]))
        all_leaves = 2 * v["shared"] + F.size(v["a"]) + F.size(v["b"])
        changed = F.size(F.array_except(v["a"], v["b"]))
        return F.struct(F.round(2 * shared / all_leaves, 6).alias("likeness"), v["sections"].alias("sections"), v["paragraphs"].alias("paragraphs"), changed.cast("long").alias("leaves"))

    def paragraphs(v: Column) -> Column:
        left_own = F.array_except(v["a"], v["b"])
        return let(
            F.struct(
                (v["shared"] + _leaves_of(F.array_intersect(v["a"], v["b"]))).alias("shared"), v["sections"].alias("sections"), F.size(left_own).cast("long").alias("paragraphs"),
                _below(left_own, ",").alias("a"), _below(F.array_except(v["b"], v["a"]), ",").alias("b"),
            ),
            clauses,
        )

    def sections(v: Column) -> Column:
        left_own = F.array_except(v["a"], v["b"])
        return let(
            F.struct(
                _leaves_of(F.array_intersect(v["a"], v["b"])).alias("shared"), F.size(left_own).cast("long").alias("sections"),
                _below(left_own, r"\|").alias("a"), _below(F.array_except(v["b"], v["a"]), r"\|").alias("b"),
            ),
            paragraphs,
        )

    same = F.substring(left, 1, 64) == F.substring(right, 1, 64)
    none = F.lit(0).cast("long")
    equal = F.struct(F.lit(1.0).alias("likeness"), none.alias("sections"), none.alias("paragraphs"), none.alias("leaves"))
    body = lambda p: F.array_distinct(F.split(F.substring(p, 66, 2_147_483_647), ";"))
    return F.when(same, equal).otherwise(let(F.struct(body(left).alias("a"), body(right).alias("b")), sections))


def likeness(left: Column, right: Column) -> Column:
    return compare(left, right)["likeness"]


def edits(left: Column, right: Column) -> Column:
    """Where two trees differ: array<struct<section, paragraph, leaf>>, numbered from zero as in the left one.

    Sections and paragraphs whose hash the right tree has too are not entered. Empty for equal roots.
    """
    sections = F.transform(right, lambda s: s["hash"])
    lines = F.flatten(F.transform(right, lambda s: s["paragraphs"]))
    paragraphs, leaves = F.transform(lines, lambda p: p["hash"]), F.array_distinct(F.flatten(F.transform(lines, lambda p: p["leaves"])))

    def in_section(s: Column, i: Column) -> Column:
        def in_paragraph(p: Column, j: Column) -> Column:
            numbered = F.transform(p["leaves"], lambda h, k: F.struct(i.alias("section"), j.alias("paragraph"), k.alias("leaf"), h.alias("hash")))
            return F.filter(numbered, lambda x: ~F.array_contains(paragraphs, p["hash"]) & ~F.array_contains(leaves, x["hash"]))

        return F.filter(F.flatten(F.transform(s["paragraphs"], in_paragraph)), lambda x: ~F.array_contains(sections, s["hash"]))

    found = F.flatten(F.transform(left, in_section))
    return F.transform(found, lambda x: F.struct(x["section"].alias("section"), x["paragraph"].alias("paragraph"), x["leaf"].alias("leaf")))


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, fingerprint for every row, without any shuffle. Other columns are ignored."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("doc_id", "text", let(tree(F.col("text")), fingerprint).alias("fingerprint"))


def neighbours(ids: DataFrame) -> DataFrame:
    """doc_id, n, next_id, previous_id, previous_n in descending order of distinct ids, in a ring.

    Null comes last. The ids are sorted in ranges, each by itself; only the ends of the ranges,
    of which there are as many as `ORDER_PARTS`, are looked at together.
    """
    spark = ids.sparkSession
    parts = max(ORDER_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = ids.repartitionByRange(parts, F.col("doc_id").desc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "order")
    order = [F.col("doc_id").desc_nulls_last()]
    inside = Window.partitionBy("part").orderBy(*order)
    entry = F.struct("doc_id", "n")
    rows = dealt.withColumns({"_next": F.lead(entry).over(inside), "_previous": F.lag(entry).over(inside)})
    ends = rows.groupBy("part").agg(
        F.max(F.when(F.col("_previous").isNull(), entry)).alias("first"), F.max(F.when(F.col("_next").isNull(), entry)).alias("last")
    )
    ring, every = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lead("first").over(ring), F.first("first").over(every)).alias("after"),
        F.coalesce(F.lag("last").over(ring), F.last("last").over(every)).alias("before"),
    )
    rows = rows.join(ends, "part").select("doc_id", "n", F.coalesce("_next", "after").alias("x"), F.coalesce("_previous", "before").alias("y"))
    return rows.select("doc_id", "n", F.col("x.doc_id").alias("next_id"), F.col("y.doc_id").alias("previous_id"), F.col("y.n").alias("previous_n"))


def compare_with_edit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, changed_sections, changed_paragraphs.

    A document's edited text has its last half (rounded down) replaced by the first as many
    code points of the next document, in descending order of ids in a ring, a null id last.
    A document that is alone is its own next. Each text is shuffled once whole; to the document
    before it go only the code points that one can need, and the fingerprint. Rows that repeat
    an id are all kept; as the next document they count once, by their smallest text. The last
    two columns count the distinct sections, and the paragraphs in those, that the edit changed.
    """
    # Fingerprints are made behind the shuffle, twice, which is cheaper than to shuffle them with the texts.
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    print_ = let(tree(F.col("text")), fingerprint)
    ids = df.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n"))
    ids = ids.groupBy("doc_id").agg(F.max("n").alias("n"), F.count("*").alias("rows"))
    ring = neighbours(ids.select("doc_id", "n")).join(ids.select(F.col("doc_id").alias("_id"), "rows"), F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    ring = materialize(ring, "ring")
    place = ring.select(F.col("doc_id").alias("_id"), "next_id", "previous_id", F.floor(F.col("previous_n") / 2).cast("int").alias("_wanted"), "rows")
    placed = rows.join(place, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    heads = placed.select(
        F.col("previous_id").alias("_for"), F.expr("substring(text, 1, _wanted)").alias("_head"), print_.alias("_next_print"), "text", "rows"
    )
    several = heads.where("rows > 1").groupBy("_for").agg(F.min(F.struct("text", "_head", "_next_print")).alias("m"))
    heads = heads.where("rows = 1").select("_for", "_head", "_next_print").union(several.select("_for", "m._head", "m._next_print"))
    joined = rows.join(heads, F.col("doc_id").eqNullSafe(F.col("_for"))).withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    joined = joined.withColumn("_edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("_head", F.lit(1), half)))
    joined = joined.withColumn("fingerprint", print_).withColumn("edited_fingerprint", let(tree(F.col("_edited")), fingerprint))
    edit = compare(F.col("fingerprint"), F.col("edited_fingerprint"))
    joined = joined.withColumn("_edit", edit)
    return joined.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        F.col("_edit.likeness").alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next_print")).alias("near_next"),
        F.col("_edit.sections").alias("changed_sections"), F.col("_edit.paragraphs").alias("changed_paragraphs"),
    )
