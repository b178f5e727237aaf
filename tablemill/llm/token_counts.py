"""Token counts by distinct pre-tokens: each is counted once, and no document's ids are ever made."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

#: Documents are taken together up to so many characters, and so many documents.
BLOCK_CHARS, BLOCK_DOCS = 16_000_000, 60_000
#: Buckets of pre-tokens for each shuffle partition.
BUCKETS_PER_PARTITION = 2
# The mark of a blank in the pieces, and what is always a token of its own.
MARK, ALONE = "▁", "\n"
PRE_TOKEN = re.compile(f"{MARK}*[^{MARK}{ALONE}]+|{MARK}+")


@lru_cache(4)
def model(path: str):
    """The processor, once a worker, if pre-tokens are independent under it.

    They are if no piece continues behind a blank or holds a line break, and if texts are
    taken as they are, with one blank put in front.
    """
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [own.id_to_piece(k) for k in range(own.get_piece_size())]
    if any(re.search(f"[^{MARK}]{MARK}", p) or (ALONE in p and len(p) > 1) for p in pieces):
        raise ValueError(f"{path}: pieces cross pre-tokens.")
    if own.encode("  ﬁ  a", out_type=str) != own.encode(f"{MARK}{MARK}ﬁ{MARK}{MARK}a", out_type=str) or not own.encode("a", out_type=str)[0].startswith(MARK):
        raise ValueError(f"{path}: texts are normalised in another way than expected.")
    return own


def pre_tokens(text: str) -> list[str]:
    """Runs of blanks with what follows them; line breaks, tokens by themselves, part them."""
    return PRE_TOKEN.findall(MARK + text.replace(" ", MARK)) if text else []


def count_pieces(words: list[str], path: str) -> list[int]:
    """The tokens of each pre-token. A line break in front keeps the model from adding a blank."""
    return [len(ids) - 2 for ids in model(path).encode([ALONE + w for w in words], num_threads=1)]


def _pack(words: list[str], sizes: np.ndarray, docs: np.ndarray, freqs: np.ndarray) -> bytes:
    head = "\n".join(words).encode("utf-8", "surrogatepass")
    kind = np.uint8 if len(freqs) == 0 or freqs.max() < 256 else np.uint32
    parts = [head, sizes.astype(np.uint32).tobytes(), docs.astype(np.uint16).tobytes(), freqs.astype(kind).tobytes()]
    sizes_line = np.array([len(p) for p in parts], np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes_line + b"".join(parts))


def _unpack(blob: bytes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    lengths = np.frombuffer(data[:16], np.uint32).tolist()
    at = np.cumsum([16, *lengths]).tolist()
    head, sizes, docs, freqs = (data[a:b] for a, b in zip(at, at[1:], strict=False))
    docs = np.frombuffer(docs, np.uint16)
    freqs = np.frombuffer(freqs, np.uint8 if len(freqs) == len(docs) else np.uint32)
    return head.decode("utf-8", "surrogatepass").split("\n"), np.frombuffer(sizes, np.uint32), docs, freqs


class _Block:
    """Frequencies of the pre-tokens of some documents."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.found: list[np.ndarray] = []
        self.ids: list = []
        self.bytes: list[int] = []
        self.breaks: list[int] = []
        self.chars = 0

    def add(self, own_id, text: str) -> None:
        words, number = pre_tokens(text), self.number
        self.found.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        self.ids.append(own_id)
        self.bytes.append(len(text.encode("utf-8", "surrogatepass")))
        self.breaks.append(text.count(ALONE))
        self.chars += len(text)

    def buckets(self, n: int) -> Iterator[tuple[int, bytes]]:
        """Per bucket: its pre-tokens in order, and for each the documents and frequencies."""
        words = list(self.number)
        docs = np.repeat(np.arange(len(self.found)), [len(f) for f in self.found])
        pairs, freqs = np.unique(np.concatenate([*self.found, np.array([], np.int64)]) * len(self.found) + docs, return_counts=True)
        word, doc = pairs // len(self.found), pairs % len(self.found)
        sizes = np.bincount(word, minlength=len(words))
        firsts = np.cumsum(sizes) - sizes
        split: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(words):
            split[zlib.crc32(w.encode("utf-8", "surrogatepass")) % n].append(k)
        for bucket, own in split.items():
            own.sort(key=words.__getitem__)
            chosen = np.array(own)
            length = sizes[chosen]
            at = np.repeat(firsts[chosen] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            yield bucket, _pack([words[k] for k in own], length, doc[at], freqs[at])


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, as the model at `path` would encode it.

    1. Documents are taken in blocks; a block's pre-tokens go to buckets by hash, each with the
       documents of the block that have it and how often, packed.
    2. In a bucket every distinct pre-token is counted once and joined to the frequencies; the
       products are added up by document of each block.
    3. A block's sums meet, one row from each bucket and one with its ids.

    Blocks are bounded, so the most frequent pre-token costs one entry a block. A null text
    counts as empty and has no tokens. Rows with equal or null ids stay rows of their own;
    other columns are ignored, and an empty frame gives an empty one.
    """
    spark = df.sparkSession
    n = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[id_col].dataType
    header = [StructField("block", LongType()), StructField("ids", ArrayType(kind)), StructField("n_bytes", ArrayType(LongType())), StructField("breaks", ArrayType(LongType()))]
    packed = StructType([StructField("bucket", IntegerType()), StructField("packed", BinaryType()), *header])
    added = StructType([StructField("sums", BinaryType()), *header])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, arrow = TaskContext.get().partitionId() << 32, _Block(), None

        def rows() -> Iterator[pa.RecordBatch]:
            for bucket, blob in block.buckets(n):
                columns = [[bucket], [blob], [number], [None], [None], [None]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names=packed.names)
            columns = [[number % n], [None], [number], [block.ids], [block.bytes], [block.breaks]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names=packed.names)

        for batch in batches:
            arrow = arrow or [pa.int32(), pa.binary(), pa.int64(), pa.list_(batch.schema.field(0).type), pa.list_(pa.int64()), pa.list_(pa.int64())]
            for own_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(own_id, text.as_py() or "")
                if block.chars >= BLOCK_CHARS or len(block.ids) >= BLOCK_DOCS:
                    yield from rows()
                    number, block = number + 1, _Block()
        if block.ids:
            yield from rows()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        bucket = None
        for batch in batches:
            own = []
            for row in range(batch.num_rows):
                if batch.column(1)[row].is_valid:
                    if batch.column(0)[row].as_py() != bucket:
                        bucket, known = batch.column(0)[row].as_py(), {}
                    words, sizes, docs, freqs = _unpack(batch.column(1)[row].as_py())
                    new = [w for w in words if w not in known]
                    known.update(zip(new, count_pieces(new, path), strict=True))
                    counts = np.repeat(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), sizes) * freqs
                    total = np.bincount(docs, weights=counts)
                    there = np.flatnonzero(total)
                    blob = there.astype(np.uint16).tobytes() + total[there].astype(np.uint32).tobytes()
                    own.append(zstandard.ZstdCompressor(level=1).compress(blob))
                else:
                    own.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), *batch.columns[2:]], names=added.names)

    def totals(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ids, rest = np.zeros(BLOCK_DOCS, np.int64), None, None
        for part in parts:
            for row in range(part.num_rows):
                if part.column(0)[row].is_valid:
                    blob = zstandard.ZstdDecompressor().decompress(part.column(0)[row].as_py())
                    size = len(blob) // 6
                    total[np.frombuffer(blob[: 2 * size], np.uint16)] += np.frombuffer(blob[2 * size :], np.uint32)
                else:
                    ids, rest = part.column(2)[row].values, [part.column(k)[row].values for k in (3, 4)]
        tokens = total[: len(ids)] + rest[1].to_numpy(zero_copy_only=False)
        over = pa.array(tokens > limit)
        yield pa.RecordBatch.from_arrays([ids, rest[0], pa.array(tokens, pa.int64()), over], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    result = StructType([StructField("doc_id", kind), StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])
    dealt = df.select(F.col(id_col), F.col(text_col)).mapInArrow(blocks, packed).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(sums, added).groupBy("block").applyInArrow(totals, result)
