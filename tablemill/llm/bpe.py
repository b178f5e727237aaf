"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets."""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

#: Code points worked on at once; a longer text is taken alone, whole.
AT_ONCE = 1 << 20
#: Distinct pieces remembered by a worker, and as many before them, and the longest of them.
REMEMBERED, LONGEST = 1 << 18, 48
#: Pieces of up to so many bytes are merged with a plain list of their pairs.
LISTED = 64
NO_RANK = 1 << 62
ID_BITS = 24

# Symbols of the scan: what the pre-tokeniser's pattern tells apart.
END, LETTER, ENDING, MIDDLE, SECOND, DOUBLE, NUMBER, QUOTE, OTHER, BLANK, WHITE = range(11)
LETTERS = (LETTER, ENDING, MIDDLE, SECOND, DOUBLE)
# Its states: what was read last. Quoted states are behind a quote that may begin 's, 're or 'll.
START, WORD, DIGITS, MARKS, SPACE, SPACES, QUOTED, HALF, HALF_L, SUFFIX = range(10)
# The white space of the Unicode standard.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """The symbol of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for chars, symbol in ((WHITE_SPACE, WHITE), (" ", BLANK), ("'", QUOTE), ("stmd", ENDING), ("rv", MIDDLE), ("e", SECOND), ("l", DOUBLE)):
        table[[ord(c) for c in chars]] = symbol
    return table


def _next_state(state: int, symbol: int) -> int:
    if symbol == QUOTE:  # a quote goes on with marks, also behind one blank; elsewhere it may begin a suffix
        return MARKS if state in (MARKS, SPACE, QUOTED) else QUOTED
    if state == QUOTED and symbol in (ENDING, MIDDLE, DOUBLE):
        return {ENDING: SUFFIX, MIDDLE: HALF, DOUBLE: HALF_L}[symbol]
    if (state, symbol) in ((HALF, SECOND), (HALF_L, DOUBLE)):
        return SUFFIX
    return {END: START, NUMBER: DIGITS, OTHER: MARKS, BLANK: SPACE, WHITE: SPACES}.get(symbol, WORD)


@lru_cache(1)
def transition_monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(function of each symbol, product table, images of START) of all transition functions.

    A symbol maps states to states. The functions made by chaining such maps are few; they
    are numbered, and their products, first factor applied first, kept as a table. That makes
    reading a text an associative scan over small numbers.
    """
    states, symbols = 10, 11
    maps = [tuple(_next_state(s, x) for s in range(states)) for x in range(symbols)]
    number = {m: k for k, m in enumerate(dict.fromkeys([tuple(range(states)), *maps]))}
    found = list(number)
    for f in found:  # grows while it is read
        for m in maps:
            if (h := tuple(m[x] for x in f)) not in number:
                number[h] = len(found)
                found.append(h)
    product = np.array([[number[tuple(g[x] for x in f)] for g in found] for f in found], np.uint16)
    return np.array([number[m] for m in maps], np.uint16), product, np.array([f[START] for f in found], np.uint8)


def scan_states(symbols: np.ndarray, width: int = 256) -> np.ndarray:
    """The state before each symbol, by a two-level scan over blocks of `width` symbols."""
    function, product, image = transition_monoid()
    n, base = len(symbols), product.shape[1]
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.uint8)
    padded[:n] = symbols
    steps = function[padded.reshape(rows, width).T]  # a row holds the same place of all blocks
    flat = product.ravel()
    before = np.empty((width, rows), np.uint16)
    run = np.zeros(rows, np.uint16)  # the identity
    for k in range(width):
        before[k] = run
        run = flat[run.astype(np.uint32) * base + steps[k]]
    # Blocks are chained in the same way, a few of them one by one.
    carry = np.zeros(rows, np.uint16)
    if rows > width:
        carry = _scan_functions(run, width)
    else:
        for k in range(1, rows):
            carry[k] = product[carry[k - 1], run[k - 1]]
    states = image[flat[carry.astype(np.uint32)[None, :] * base + before]]
    return states.T.ravel()[:n]


def _scan_functions(functions: np.ndarray, width: int) -> np.ndarray:
    """Products of all functions before each one."""
    _, product, _ = transition_monoid()
    n = len(functions)
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.uint16)
    padded[:n] = functions
    steps, before, run = padded.reshape(rows, width).T, np.empty((width, rows), np.uint16), np.zeros(rows, np.uint16)
    for k in range(width):
        before[k] = run
        run = product[run, steps[k]]
    carry = np.zeros(rows, np.uint16)
    for k in range(1, rows):
        carry[k] = product[carry[k - 1], run[k - 1]]
    return product[carry[None, :], before].T.ravel()[:n]


def piece_starts(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places where pieces begin in texts laid end to end, each followed by one END code."""
    symbols = symbol_table()[codes]
    symbols[ends] = END
    state = scan_states(symbols)
    after = np.append(symbols[1:], np.uint8(END))
    letter = (symbols >= LETTER) & (symbols <= DOUBLE)
    white = symbols >= BLANK
    before_white = (state == SPACE) | (state == SPACES)
    starts = letter & (state != WORD) & (state != SPACE)
    # Letters of a suffix belong to its quote; whether r, v or l do is seen from the next one.
    quoted = state == QUOTED
    starts &= ~(quoted & (symbols == ENDING))
    starts &= ~(quoted & (((symbols == MIDDLE) & (after == SECOND)) | ((symbols == DOUBLE) & (after == DOUBLE))))
    half = ((state == HALF) & (symbols != SECOND)) | ((state == HALF_L) & (symbols != DOUBLE))
    starts &= ~(letter & half)
    starts &= ~(((state == HALF) & (symbols == SECOND)) | ((state == HALF_L) & (symbols == DOUBLE)))
    starts |= (symbols == NUMBER) & (state != DIGITS) & (state != SPACE)
    marks = (symbols == OTHER) | (symbols == QUOTE)
    starts |= marks & (state != MARKS) & (state != SPACE) & (state != QUOTED)
    # A run of white space leaves its last character to what follows, if anything does.
    last = white & (after < BLANK) & (after != END)
    starts |= white & (~before_white | last)
    starts[ends] = True  # closes the last piece of a text
    return np.flatnonzero(starts)


@dataclass(frozen=True)
class Vocabulary:
    """Ranks, and the bytes of all tokens laid end to end with their places."""

    ranks: dict[bytes, int]
    blob: np.ndarray
    start: np.ndarray
    length: np.ndarray


@dataclass(frozen=True)
class Merger:
    """Ranks, ids of bytes, what pairs of ids become, and what pairs of bytes do."""

    ranks: dict[bytes, int]
    single: list[int]
    joined: dict[int, int]
    first: list[int]


class Pieces(dict):
    """Ids by piece, as the bytes of 32-bit numbers; short pieces are remembered, the latest and those before them."""

    def __init__(self, merger: Merger):
        super().__init__()
        self.merger = merger
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is None:
            ids = array("i", merge(piece.encode("utf-8", "surrogatepass"), self.merger)).tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def _merge_listed(piece: bytes, vocab: Merger) -> list[int]:
    """As merge(), on numbers: the ids of the parts, and the ids of what each pair would become."""
    get, single, first = vocab.joined.get, vocab.single, vocab.first
    ids = [single[b] for b in piece]
    pairs = [first[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
    while pairs and (least := min(pairs)) < NO_RANK:
        k = pairs.index(least)
        ids[k] = least
        del ids[k + 1], pairs[k]
        if k < len(pairs):
            pairs[k] = get(least << ID_BITS | ids[k + 1], NO_RANK)
        if k:
            pairs[k - 1] = get(ids[k - 1] << ID_BITS | least, NO_RANK)
    return ids


def merge(piece: bytes, vocab: Merger) -> list[int]:
    """Ids of a piece: again and again the leftmost of the pairs of lowest rank becomes one part."""
    ranks = vocab.ranks
    if (own := ranks.get(piece)) is not None:
        return [own]
    if len(piece) <= LISTED:
        return _merge_listed(piece, vocab)
    parts: list[bytes | None] = [piece[k : k + 1] for k in range(len(piece))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, k) for k in range(len(parts) - 1) if (r := ranks.get(parts[k] + parts[k + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, k = heapq.heappop(heap)
        if parts[k] is None or (j := after[k]) >= len(parts) or ranks.get(parts[k] + parts[j]) != rank:
            continue
        parts[k], parts[j] = parts[k] + parts[j], None
        after[k] = after[j]
        if after[k] < len(parts):
            before[after[k]] = k
            if (r := ranks.get(parts[k] + parts[after[k]])) is not None:
                heapq.heappush(heap, (r, k))
        if (i := before[k]) >= 0 and (r := ranks.get(parts[i] + parts[k])) is not None:
            heapq.heappush(heap, (r, i))
    return [ranks[p] for p in parts if p is not None]


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """A file of ranks: a base-64 token and its rank per line. Loaded once a worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return Vocabulary(ranks, np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(length) - length, length)


@lru_cache(2)
def known_pieces(path: str) -> Pieces:
    """What merging needs, for workers that encode. Every split of a token into two tokens is a pair."""
    ranks = vocabulary(path).ranks
    joined = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                joined[a << ID_BITS | b] = rank
    single = [ranks[bytes([b])] for b in range(256)]
    return Pieces(Merger(ranks, single, joined, [joined.get(a << ID_BITS | b, NO_RANK) for a in single for b in single]))


def _bundles(texts: list[str]) -> Iterator[list[str]]:
    bundle, size = [], 0
    for text in texts:
        if bundle and size + len(text) > AT_ONCE:
            yield bundle
            bundle, size = [], 0
        bundle.append(text)
        size += len(text) + 1
    if bundle:
        yield bundle


def encode_texts(texts: list[str], known: Pieces) -> Iterator[np.ndarray]:
    """The ids of each text."""
    for bundle in _bundles(texts):
        whole = "\n".join(bundle) + "\n"  # the joints are marked as ends below
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, bundle), np.int64, len(bundle)) + 1) - 1
        starts = piece_starts(codes, ends)
        at = np.searchsorted(starts, ends)
        places, first = starts.tolist(), 0
        for text_end in at.tolist():
            pieces = [whole[a:b] for a, b in zip(places[first:text_end], places[first + 1 : text_end + 1], strict=True)]
            yield np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.int32)
            first = text_end + 1


def offsets_of(ids: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """The byte at which each token begins."""
    length = vocab.length[ids]
    return np.cumsum(length) - length


def decode_ids(ids: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> bytes:
    """The bytes of tokens that begin at the given offsets, gathered in one step."""
    if not len(ids):
        return b""
    length = vocab.length[ids]
    source = np.repeat(vocab.start[ids] - (offsets - offsets[0]), length) + np.arange(int(length.sum()))
    return vocab.blob[source].tobytes()


def _lists(values: Iterable[np.ndarray], kind: pa.DataType) -> pa.Array:
    values = list(values)
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.array([], kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def _slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices whose sizes add up to `most`, or single rows."""
    first, size = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > first and size + n > most:
            yield batch.slice(first, k - first)
            first, size = k, 0
        size += n
    if first < batch.num_rows:
        yield batch.slice(first)


Batches = Iterator[pa.RecordBatch]


def _encoder(path: str, others: list[str], ids: str, offsets: str) -> Callable[[Batches], Batches]:
    """Batches of the other columns and the text, to the other columns, ids and offsets."""

    def run(batches: Batches) -> Batches:
        vocab, known = vocabulary(path), known_pieces(path)
        for batch in batches:
            lengths = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(len(others))], np.int64)
            for part in _slices(batch, lengths, 2 * AT_ONCE):
                found = list(encode_texts([x or "" for x in part.column(len(others)).to_pylist()], known))
                starts = _lists((offsets_of(x, vocab) for x in found), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], _lists(found, pa.int32()), starts], names=[*others, ids, offsets])

    return run


def _decoder(path: str, names: list[str], ids: str, offsets: str, out: str) -> Callable[[Batches], Batches]:
    """Batches of all columns, to the same and the bytes decoded."""
    mine, places = names.index(ids), names.index(offsets)

    def run(batches: Batches) -> Batches:
        vocab = vocabulary(path)

        def row(a: pa.ListScalar, b: pa.ListScalar) -> bytes:
            return decode_ids(a.values.to_numpy(zero_copy_only=False), b.values.to_numpy(zero_copy_only=False), vocab) if a.is_valid else b""

        for batch in batches:
            sizes = np.array([len(x.values) if x.is_valid else 0 for x in batch.column(mine)], np.int64)
            for part in _slices(batch, sizes, AT_ONCE):
                found = [row(a, b) for a, b in zip(part.column(mine), part.column(places), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=[*names, out])

    return run


def _others(df: DataFrame, *taken: str) -> list[str]:
    return [c for c in df.columns if c.lower() not in {t.lower() for t in taken}]


def _columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in names])


def encode(df: DataFrame, path: str, text_col: str = "text", ids: str = "ids", offsets: str = "offsets") -> DataFrame:
    """All columns but the text, then `ids` and the byte `offsets` at which tokens begin.

    The ids are those of the rank file's byte-level BPE without special tokens; a text's bytes
    are all in them. A null text counts as empty and has none. Texts are whole, rows are kept
    as they come, and an input column named like an output is left out.
    """
    others = _others(df, text_col, ids, offsets)
    schema = StructType([*_columns(df, others).schema.fields, StructField(ids, ArrayType(IntegerType())), StructField(offsets, ArrayType(LongType()))])
    return _columns(df, [*others, text_col]).mapInArrow(_encoder(path, others, ids, offsets), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", offsets: str = "offsets", out: str = "decoded") -> DataFrame:
    """All columns and the bytes that the ids stand for, placed by the offsets; empty without ids.

    A run of consecutive tokens can be decoded as well, given with its own offsets. A null
    list counts as empty. An input column named `out` is replaced.
    """
    names = _others(df, out)
    schema = StructType([*_columns(df, names).schema.fields, StructField(out, BinaryType())])
    return _columns(df, names).mapInArrow(_decoder(path, names, ids, offsets, out), schema)


def round_trip(
    df: DataFrame, path: str, text_col: str = "text", ids: str = "ids", offsets: str = "offsets", out: str = "decoded"
) -> DataFrame:
    """decode() of encode(), in one pass over each batch, so that ids cross to Python and back once."""
    others = _others(df, text_col, ids, offsets, out)
    own = [StructField(ids, ArrayType(IntegerType())), StructField(offsets, ArrayType(LongType())), StructField(out, BinaryType())]
    encoder, decoder = _encoder(path, others, ids, offsets), _decoder(path, [*others, ids, offsets], ids, offsets, out)

    def run(batches: Batches) -> Batches:
        return decoder(encoder(batches))

    return _columns(df, [*others, text_col]).mapInArrow(run, StructType([*_columns(df, others).schema.fields, *own]))
