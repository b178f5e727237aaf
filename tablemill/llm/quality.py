"""Quality rules: how far a document's characters and common words are from its language's."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.shared import SPACE, free_name, let, words
from tablemill.session import materialize

# Common words of languages, most common first.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "en": "the of and to in a is that for it was on as with be by at this from are",
    "es": "de la que el en y a los se del las un por con no una su para es al",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au",
}
# The symbols that count as such.
SYMBOLS = r"[#*$%&|<>]"
#: Character classes, each with the pattern of its members; what is in none of them is a class too.
CLASSES = {
    "lower": r"\p{Ll}", "upper": r"\p{Lu}", "number": r"\p{N}", "space": SPACE, "stop": r"[.,;:?'\"()\-]", "symbol": r"[#*$%&|<>!@^_=+~/\\\[\]{}]",
}
OTHER = ""


@dataclass(frozen=True)
class QualityRules:
    """Limits of the verdict. Distances are Jensen-Shannon distances to base 2, from 0 to 1.

    A histogram is compared only if it counts enough: `least_chars` characters, `least_words`
    words. Shorter texts are judged by the base rules alone.
    """

    least_words_base: int = 50
    most_repeated_percent: int = 50
    most_class_distance: float = 0.29
    most_word_distance: float = 0.325
    least_chars: int = 200
    least_words: int = 100
    common: dict[str, str] = field(default_factory=lambda: dict(COMMON_WORDS))


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, f"{pattern}+", ""))


def _class_counts(text: Column) -> Column:
    counts = [F.length(text) - _without(text, p) for p in CLASSES.values()]
    rest = F.length(text)
    for c in counts:
        rest = rest - c
    return F.array(*[c.cast("double") for c in [*counts, rest]])


def _reference_key(lang: Column, rules: QualityRules) -> Column:
    return F.when(lang.isin(*rules.common), lang).otherwise(OTHER)


def _histogram(text: Column, lang: Column, rules: QualityRules) -> Column:
    """Struct of key (of the reference), chars, n (words), classes and common, both of counts.

    Words are runs of letters, lower-cased. `common` counts each place of the language's list,
    then all other words.
    """
    longest = max(len(v.split()) for v in rules.common.values())
    key = _reference_key(lang, rules)
    lists = F.create_map(*[x for k, v in rules.common.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))])
    listed = F.coalesce(F.try_element_at(lists, key), F.array().cast("array<string>"))
    letters = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")

    def common(v: Column) -> Column:
        places = F.filter(F.transform(v["words"], lambda w: F.array_position(v["list"], w)), lambda p: p > 0)
        whole = F.size(v["words"])

        def counts(m: Column) -> Column:
            each = [F.size(m) - F.size(F.array_remove(m, k + 1)) for k in range(longest)]
            return F.array(*[c.cast("double") for c in [*each, whole - F.size(m)]])

        return F.struct(whole.alias("n"), let(places, counts).alias("common"))

    found = let(F.struct(letters.alias("words"), listed.alias("list")), common)
    return let(
        F.struct(found.alias("found"), key.alias("key"), F.length(text).alias("chars"), _class_counts(text).alias("classes")),
        lambda v: F.struct(v["key"].alias("key"), v["chars"].alias("chars"), v["found"]["n"].alias("n"), v["classes"].alias("classes"), v["found"]["common"].alias("common")),
    )


def references(measured: DataFrame, histogram: str, rules: QualityRules) -> DataFrame:
    """key, classes, common: the shares in all texts of a language together, written once.

    One row per listed language and one, with an empty key, for all others together.
    """
    longest = max(len(v.split()) for v in rules.common.values())
    counted = measured.select(f"{histogram}.key", F.concat(f"{histogram}.classes", f"{histogram}.common").alias("c"))
    size = len(CLASSES) + 1
    summed = counted.groupBy("key").agg(*[F.sum(F.col("c")[k]).alias(f"c{k}") for k in range(size + longest + 1)])

    def shares(first: int, n: int) -> Column:
        counts = F.array(*[F.col(f"c{first + k}") for k in range(n)])
        return let(
            F.struct(counts.alias("c"), F.aggregate(counts, F.lit(0.0), lambda a, x: a + x).alias("n")),
            lambda v: F.transform(v["c"], lambda x: F.when(v["n"] > 0, x / v["n"]).otherwise(0.0)),
        )

    return materialize(summed.select("key", shares(0, size).alias("classes"), shares(size, longest + 1).alias("common")), "references")


def jensen_shannon(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of counts, made shares, to shares of the same length; base 2."""

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def distance(c: Column) -> Column:
        both = F.zip_with(c["p"], c["q"], lambda x, q: part(x / c["n"], (x / c["n"] + q) / 2) + part(q, (x / c["n"] + q) / 2))
        return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))

    whole = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return let(F.struct(counts.alias("p"), shares.alias("q"), whole.alias("n")), lambda c: F.when(c["n"] > 0, distance(c)))


def repeat_words(own: Column) -> Column:
    """Words in 3-word windows that occur at least twice, given the words of a text.

    Windows are told apart by 64-bit hashes chained over their words. Texts without a repeated
    window are settled by a distinct count; in the others the windows are sorted together with
    their places, and those next to an equal one are kept. A window covers three words, less
    where the next repeated one begins within it.
    """

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def found(s: Column) -> Column:
        same = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def settled(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(placed, found)).otherwise(0)

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))
        return F.when(F.size(w) > 3, let(hashes, settled)).otherwise(0)

    return let(own, windows)


def base_measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(v: Column) -> Column:
        own, rows = v["words"], v["lines"]
        return F.struct(
            F.size(own).cast("long").alias("n_words"), F.length(F.array_join(own, "")).cast("long").alias("word_chars"),
            v["symbols"].cast("long").alias("n_symbols"), (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
            repeat_words(own).cast("long").alias("n_repeat_words"),
        )

    symbols = F.length(text) - _without(text, SYMBOLS)
    return let(F.struct(words(text).alias("words"), lines.alias("lines"), symbols.alias("symbols")), counts)


def judge(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", rules: QualityRules | None = None, out: str = "quality", columns: list[str] | None = None
) -> DataFrame:
    """All rows, their columns (or those named), and a struct column `out` behind them.

    Its fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, word_distance (rounded to four places, null below the least length) and
    kept. A null text counts as an empty one, and fails the base rules; a null or unlisted
    language is compared with all unlisted ones together. Every row is judged by itself, so
    repeated rows get equal verdicts, an empty frame gives an empty one, and columns of any
    name pass through (one named `out` is replaced).

    Texts are read and measured once; the measures are written, with the columns asked for, and
    both the references and the verdicts come from there.
    """
    rules = rules or QualityRules()
    names = [c for c in columns if c.lower() != out.lower()] if columns is not None else [c for c in df.columns if c.lower() != out.lower()]
    text = F.coalesce(F.col(text_col), F.lit(""))
    base, histogram, key = (free_name(df, n) for n in ("_base", "_histogram", "_key"))
    measured = df.select(
        *[F.col(f"`{c}`") for c in names], base_measures(text).alias(base), _histogram(text, F.col(lang_col), rules).alias(histogram)
    )
    measured = materialize(measured, "measures")
    refs = references(measured, histogram, rules).select(F.col("key").alias(key), F.struct("classes", "common").alias(key + "ref"))
    # One row per listed language and one for the rest: the bound of what is broadcast.
    rows = measured.join(F.broadcast(refs), F.col(f"{histogram}.key") == F.col(key), "left")

    def verdict(v: Column) -> Column:
        b, h, ref = v["base"], v["histogram"], v["ref"]
        near = F.when(h["chars"] >= rules.least_chars, F.round(jensen_shannon(h["classes"], ref["classes"]), 4))
        common = F.when((h["n"] >= rules.least_words) & (h["key"] != OTHER), F.round(jensen_shannon(h["common"], ref["common"]), 4))
        failed = (b["n_words"] < rules.least_words_base) | (100 * b["n_repeat_words"] > rules.most_repeated_percent * b["n_words"])
        fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

        def judged(m: Column) -> Column:
            far = (F.coalesce(m["class_distance"], F.lit(0.0)) > rules.most_class_distance) | (
                F.coalesce(m["word_distance"], F.lit(0.0)) > rules.most_word_distance
            )
            known = [m[n].alias(n) for n in [*fields, "base_failed", "class_distance", "word_distance"]]
            return F.struct(*known, (~m["base_failed"] & ~far).alias("kept"))

        found = [b[n].alias(n) for n in fields]
        return let(F.struct(*found, failed.alias("base_failed"), near.alias("class_distance"), common.alias("word_distance")), judged)

    parts = F.struct(F.col(base).alias("base"), F.col(histogram).alias("histogram"), F.col(key + "ref").alias("ref"))
    return rows.select(*[F.col(f"`{c}`") for c in names], let(parts, verdict).alias(out))
