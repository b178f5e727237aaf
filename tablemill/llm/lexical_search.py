"""Ranked lexical search turned round: documents stream past an index of the items' terms.

The items' inverted index (term -> items) is broadcast, one bounded block of items after the
other; each document's term counts run through it, and a task keeps the best documents of
every item in a bounded heap. The heaps of all tasks are merged at the end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tablemill.session import materialize

#: Documents an item keeps.
TOP = 20
#: A block of items ends before it holds more (term, item) postings or items than this.
MOST_POSTINGS, MOST_ITEMS = 1_000_000, 4096
#: Cells of the (documents x items) score matrix, and postings, worked on at once in a task.
CELLS = 1 << 21

# Bytes of terms: ASCII letters in lower case, digits, and every byte of a non-ASCII character.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in order, repeats included; none for a null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Index:
    """Terms of a block of items, each with its items and how often they hold it."""

    ids: list = field(default_factory=list)
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)
    size: int = 0

    def add(self, item_id, counts: Counter) -> None:
        for term, times in counts.items():
            self.postings.setdefault(term, []).append((len(self.ids), times))
        self.ids.append(item_id)
        self.size += len(counts)

    def packed(self) -> Packed:
        numbers = {term: k for k, term in enumerate(self.postings)}
        listed = [p for own in self.postings.values() for p in own]
        lengths = np.fromiter(map(len, self.postings.values()), np.int64, len(numbers))
        items, times = np.array(listed, np.int64).reshape(-1, 2).T
        return Packed(numbers, np.cumsum(lengths) - lengths, lengths, items.copy(), times.copy(), len(self.ids))


@dataclass
class Packed:
    """The index as arrays: the postings of term k are items[starts[k] : starts[k] + lengths[k]]."""

    numbers: dict[bytes, int]
    starts: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    times: np.ndarray
    n_items: int


def blocks(items: DataFrame, id_col: str, text_col: str, most_postings: int = MOST_POSTINGS, most_items: int = MOST_ITEMS) -> Iterator[Index]:
    """The items in blocks of bounded size, read partition by partition. Items without terms are left out."""
    block = Index()
    for row in items.select(F.col(id_col), F.col(text_col)).toLocalIterator():
        counts = Counter(terms(row[1]))
        if not counts:
            continue
        if block.ids and (block.size + len(counts) > most_postings or len(block.ids) == most_items):
            yield block
            block = Index()
        block.add(row[0], counts)
    if block.ids:
        yield block


def _statistics(documents: DataFrame, index) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and for every term of the index the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = index.value.numbers
        counts, n, total = np.zeros(len(numbers), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0):
                own = terms(text.as_py())
                n, total = n + bool(own), total + len(own)
                for term in numbers.keys() & set(own):
                    counts[numbers[term]] += 1
        held = np.flatnonzero(counts)
        keys, values = np.concatenate([held, [-1, -2]]), np.concatenate([counts[held], [n, total]])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.int64())], names=["term", "n"])

    shape = StructType([StructField("term", LongType()), StructField("n", LongType())])
    counted = dict(map(tuple, documents.select("text").mapInArrow(run, shape).groupBy("term").agg(F.sum("n")).collect()))
    df = np.zeros(len(index.value.numbers), np.int64)
    for term, n in counted.items():
        if term >= 0:
            df[term] = n
    return counted.get(-1, 0), counted.get(-2, 0), df


class _Heaps:
    """The best documents of each item: rows (item, score, no_id, id), at most `top` an item."""

    def __init__(self, n_items: int, top: int):
        self.top, self.least = top, np.zeros(n_items, np.int64)
        self.rows = np.zeros((0, 4), np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        doc, item = np.nonzero((scores > 0) & (scores >= self.least))
        if not len(doc):
            return
        rows = np.concatenate([self.rows, np.stack([item, scores[doc, item], missing[doc], ids[doc]], axis=1)])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - first
        self.rows = rows[place < self.top]
        full = rows[place == self.top - 1]
        self.least[full[:, 0]] = full[:, 1]


def _best(documents: DataFrame, index, weights, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, score, doc_id): the heaps of all tasks, items by their number in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = index.value, weights.value
        heaps, lookup, width = _Heaps(own.n_items, top), own.numbers.get, len(own.numbers)
        step = max(1, CELLS // own.n_items)

        def score(found: list[np.ndarray], lengths: list[int]) -> np.ndarray:
            docs = np.repeat(np.arange(len(found)), [len(x) for x in found])
            codes, tf = np.unique(docs * width + np.concatenate(found), return_counts=True)
            docs, term = codes // width, codes % width
            m = 75 + 25 * np.array(lengths, np.int64) * n_docs // n_terms
            gain = w[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[docs]))
            sums, reach = np.zeros(len(found) * own.n_items, np.int64), np.cumsum(own.lengths[term])
            at = 0
            while at < len(term):  # so many matched terms that their postings stay within the limit
                to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + CELLS, "right")))
                length = own.lengths[term[at:to]]
                which = np.repeat(np.arange(at, to), length)
                place = np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length) + own.starts[term[which]]
                np.add.at(sums, docs[which] * own.n_items + own.items[place], gain[which] * own.times[place])
                at = to
            return sums.reshape(len(found), own.n_items)

        for batch in batches:
            ids = batch.column(0)
            missing = np.asarray(ids.is_null()).astype(np.int64)
            numbers = np.asarray(ids.fill_null(0)).astype(np.int64)
            kept, found, lengths = [], [], []
            for k, text in enumerate(batch.column(1)):
                listed = terms(text.as_py())
                matched = [x for x in map(lookup, listed) if x is not None]
                if matched:
                    kept.append(k)
                    found.append(np.array(matched, np.int64))
                    lengths.append(len(listed))
                if len(kept) == step:
                    heaps.offer(score(found, lengths), numbers[kept], missing[kept])
                    kept, found, lengths = [], [], []
            if kept:
                heaps.offer(score(found, lengths), numbers[kept], missing[kept])
        item, score_of, none, number = heaps.rows.T
        columns = [pa.array(item, pa.int64()), pa.array(score_of, pa.int64()), pa.array(number, pa.int64(), mask=none.astype(bool))]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "score", "doc_id"])

    shape = StructType([StructField(name, LongType()) for name in ("item", "score", "doc_id")])
    return documents.mapInArrow(run, shape)


def search(
    documents: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    most_postings: int = MOST_POSTINGS,
    most_items: int = MOST_ITEMS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` highest-scoring documents of every item, scores above 0 only.

    Every row of `items` is an item of its own and every row of `documents` a document, repeated
    ones too. Ids of documents are whole numbers; equal scores go by ascending id, those without
    an id last. Null and empty texts have no terms: such items have no rows, such documents are
    found by none and count nowhere. All other columns are ignored. Documents are read twice for
    each block of items (once for the counts, once for the scores) and never shuffled; only the
    heaps are, `top` rows an item and task.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = items.schema[item_id_col].dataType
    shape = StructType([StructField("item", LongType()), StructField("item_id", kind)])
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts: list[DataFrame] = []
    for block in blocks(items, item_id_col, item_text_col, most_postings, most_items):
        if parts:  # further blocks: what the ones before found is a written table of `top` rows an item
            parts[-1] = materialize(parts[-1], "search")
        index = spark.sparkContext.broadcast(block.packed())
        n_docs, n_terms, df = _statistics(texts, index)
        if not n_docs:
            break
        weights = spark.sparkContext.broadcast(np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64))
        ranked = _best(texts, index, weights, n_docs, n_terms, top)
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(block.ids)), shape)
        parts.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return items.select(F.col(item_id_col).alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
