"""Whitening of embeddings through a bidiagonal qd solver.

Centred rows are reduced to one small triangular factor by blockwise QR in the tasks. On the
driver, where everything is of the size dimension x dimension, Householder reflections make
the factor bidiagonal, dqds gives its singular values to high relative accuracy, and twisted
factorisations of the shifted squares give the directions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from tablemill.errors import SpecError
from tablemill.session import materialize

#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64.0, 1_000_000
COMPONENTS = 16
#: Entries beyond this are held at it, so that sums of whole numbers stay exact.
LARGEST = 1 << 40
#: The small matrices of the solver live on the driver, so the dimension is bounded.
MOST_DIMENSIONS = 2048
#: Rows reduced by one QR step, and partial results merged by one task.
BLOCK, FAN_IN = 4096, 16
_EPS = np.finfo(float).eps


# --- the solver, on dimension x dimension matrices -------------------------------------------


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal q, superdiagonal e and orthogonal p of an upper bidiagonal B with R = U B p'."""
    a, d = r.astype(float).copy(), r.shape[1]
    p = np.eye(d)
    for k in range(d):
        v = _reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= np.outer(v, 2 * (v @ a[k:, k:]))
        if k + 2 < d:
            v = _reflector(a[k, k + 1 :])
            if v is not None:
                a[k:, k + 1 :] -= np.outer(2 * (a[k:, k + 1 :] @ v), v)
                p[:, k + 1 :] -= np.outer(2 * (p[:, k + 1 :] @ v), v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _reflector(x: np.ndarray) -> np.ndarray | None:
    norm = np.linalg.norm(x)
    if len(x) < 2 or norm == 0:
        return None
    v = x.copy()
    v[0] += np.copysign(norm, x[0])
    return v / np.linalg.norm(v)


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The singular values, falling, of an upper bidiagonal matrix, each to high relative accuracy.

    The differential quotient-difference algorithm with shifts, on the squares of the entries. A
    shift that makes a pivot negative is too large and taken back; zero shifts always succeed.
    """
    done: list[float] = []
    stack = [(np.asarray(q, float) ** 2, np.asarray(e, float) ** 2, 0.0)]
    while stack:
        a, b, moved = stack.pop()
        while len(a) > 1:
            if b[-1] <= _EPS**2 * (moved + a[-1]) or b[-1] == 0:
                done.append(moved + a[-1])
                a, b = a[:-1], b[:-1]
                continue
            cut = np.flatnonzero(b[:-1] <= _EPS**2 * (moved + np.minimum(a[:-2], a[1:-1]))) if len(b) > 1 else []
            if len(cut):
                stack.append((a[: cut[0] + 1], b[: cut[0]], moved))
                a, b = a[cut[0] + 1 :], b[cut[0] + 1 :]
                continue
            # Gershgorin's bound on the least eigenvalue of the end of the matrix, never too large by much.
            low, _ = _step(a, b, 0.0)
            guess = max(0.0, 0.98 * (low - 0.5 * np.sqrt(low * b[-1]))) if low > 0 else 0.0
            for shift in (guess, 0.5 * guess, 0.0):
                least, out = _step(a, b, shift, keep=True)
                if least >= 0:
                    break
            a, b = out
            moved += shift
        done.append(moved + a[0])
    return np.sqrt(np.maximum(np.sort(np.array(done))[::-1], 0))


def _step(a: np.ndarray, b: np.ndarray, shift: float, keep: bool = False):
    """One dqds transform. Gives the least pivot and, with keep, the new rows."""
    n = len(a)
    to, off, d = np.empty(n), np.empty(n - 1), a[0] - shift
    least = d
    for k in range(n - 1):
        to[k] = d + b[k]
        if to[k] <= 0:
            return (-1.0, (a, b)) if keep else (0.0, None)
        ratio = a[k + 1] / to[k]
        off[k] = b[k] * ratio
        d = d * ratio - shift
        least = min(least, d)
    to[-1] = d
    return (least, (to, off)) if keep else (least, None)


def twisted(q: np.ndarray, e: np.ndarray, square: float) -> np.ndarray:
    """The unit eigenvector of B'B for an eigenvalue, from the twisted factorisation with the smallest twist.

    The stationary transform factors B'B - square from the top, the progressive one from the
    bottom; they meet where the remaining pivot is least, and the vector follows by products alone.
    """
    d, low = q * q, q[:-1] * e  # L D L' with L's subdiagonal e / q
    ratio = np.divide(e, q[:-1], out=np.zeros_like(e), where=q[:-1] != 0)
    n, tiny = len(q), 1e-150  # entries are at most about one here
    s, down = np.empty(n), np.zeros(n - 1)
    s[0] = -square
    for k in range(n - 1):
        pivot = s[k] + d[k]
        pivot = pivot if abs(pivot) > tiny else tiny
        down[k] = low[k] / pivot
        s[k + 1] = down[k] * ratio[k] * s[k] - square
    p, up = np.empty(n), np.zeros(n - 1)
    p[-1] = d[-1] - square
    for k in range(n - 2, -1, -1):
        pivot = d[k] * ratio[k] ** 2 + p[k + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        up[k] = low[k] / pivot
        p[k] = p[k + 1] * (d[k] / pivot) - square
    r = int(np.argmin(np.abs(s + p + square)))
    z = np.zeros(n)
    z[r] = 1.0
    for k in range(r - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(r, n - 1):
        z[k + 1] = -up[k] * z[k]
    return z / np.linalg.norm(z)


def directions(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of R, falling, and its right singular vectors as columns.

    Vectors of values that are close together are made orthogonal in turn, and one step of
    inverse iteration sharpens each that doesn't yet meet its equation to working accuracy.
    Values that are zero but for rounding are left out.
    """
    scale = float(np.abs(r).max()) if r.size else 0.0
    if scale == 0:
        return np.zeros(0), np.zeros((r.shape[1], 0))
    q, e, p = bidiagonalise(r / scale)
    values = dqds(q, e)
    values = values[values > len(q) * _EPS * values[0]] if len(values) and values[0] > 0 else values[:0]
    b = np.diag(q) + np.diag(e, 1)
    square, draw = b.T @ b, np.random.default_rng(0)
    vectors = np.zeros((len(q), len(values)))
    for k, value in enumerate(values):
        z = twisted(q, e, value * value)
        near = vectors[:, [j for j in range(k) if values[j] - value < 1e-3 * value]]
        z = _apart(z, near, draw)
        for turn in range(4):
            if np.linalg.norm(square @ z - value * value * z) <= 4 * len(q) * _EPS * values[0] ** 2:
                break
            # As good as singular on purpose: the solution grows along the vector sought.
            shifted = square - (value * value + (turn + 1.5) * _EPS * values[0] ** 2) * np.eye(len(q))
            try:
                z = _apart(np.linalg.solve(shifted, z), near, draw)
            except np.linalg.LinAlgError:
                continue
        vectors[:, k] = z
    return values * scale, p @ vectors


def _apart(z: np.ndarray, near: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """The unit vector along z, made orthogonal to those near; if nothing is left of z, another one."""
    z = z / np.linalg.norm(z)
    while True:
        for _ in range(2):
            z = z - near @ (near.T @ z)
        norm = np.linalg.norm(z)
        if norm > 1e-3:
            return z / norm
        z = draw.normal(size=len(z))
        z = z / np.linalg.norm(z)


# --- the rows, in Spark ----------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """What was fitted: n distinct vectors with the sums per dimension, directions (columns) and eigenvalues."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows of whole numbers."""
        return (self.n * x - self.sums) / self.n @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sums of (n x - S)^2 as whole numbers, and where they don't fit 64 bits."""
        y = self.n * x - self.sums
        return (y * y).sum(axis=1), (y.astype(float) ** 2).sum(axis=1) >= 2.0**63 * (1 - 1e-9)


def whole_numbers(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x) for every usable row: the vector is not null, nor holds null or non-finite entries."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    usable = F.col(vector_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    held = lambda c: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c * SCALE))
    return df.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).alias("vec_id"), F.transform(v, lambda c: F.floor(held(c)) + OFFSET).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _merged(df: DataFrame, column: str, first: Callable[[np.ndarray], np.ndarray], merge: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """One small matrix for a whole table of vectors, put together in a tree of tasks.

    `first` reduces rows of the vectors to rows of the result, `merge` reduces stacked results;
    both give few rows of `width` columns whatever they get. At most FAN_IN results meet at a time.
    """

    def tasks(reduce: Callable[[np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                rows = _matrix(batch.column(0))
                for k in range(0, len(rows), BLOCK):
                    got = reduce(rows[k : k + BLOCK])
                    held = got if held is None else merge(np.concatenate([held, got]))
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.list_(pa.float64()))], names=["m"])

        return run

    shape = StructType([StructField("m", ArrayType(DoubleType()))])
    parts = df.rdd.getNumPartitions()
    own = df.select(column).mapInArrow(tasks(first), shape)
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        own = own.repartition(parts).mapInArrow(tasks(merge), shape)
    rows = [r[0] for r in own.collect()]
    return merge(np.array(rows)) if rows else np.zeros((0, width))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table (vec_id, x) over its distinct vectors x; None if there are none.

    Only vectors of the table's most frequent length count (of equally frequent ones the longest).
    Sums are of whole numbers and exact. Components with no variance are left out, so there may
    be fewer than asked for: none where all vectors are equal.
    """
    distinct = materialize(vectors.select("x").distinct(), "distinct-vectors")
    row = distinct.agg(F.count("*"), F.max(F.size("x"))).first()
    n, d = row
    if not n:
        return None
    if d > MOST_DIMENSIONS:
        raise SpecError(f"{d} dimensions; at most {MOST_DIMENSIONS} are taken.")
    totals = distinct.agg(*[F.sum(F.col("x")[k]).alias(f"s{k}") for k in range(d)]).first()
    sums = np.array(list(totals), np.int64)

    def triangle(rows: np.ndarray) -> np.ndarray:
        return np.linalg.qr(rows, mode="r")

    def centred(rows: np.ndarray) -> np.ndarray:
        return triangle((n * rows.astype(np.int64) - sums) / n)

    r = _merged(distinct, "x", centred, triangle, d)
    if len(r) < d:
        r = np.concatenate([r, np.zeros((d - len(r), d))])
    values, directed = directions(r)
    squares, total = values**2, float((r * r).sum())
    kept = slice(0, components)
    model = Whitening(n, sums, directed[:, kept], squares[kept] / n, squares[kept] / total if total else squares[kept], 0.0)
    k = len(model.values)

    def moments(rows: np.ndarray) -> np.ndarray:
        w = model.project(rows.astype(np.int64))
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])[None, :]

    sums_of = _merged(distinct, "x", moments, lambda m: m.sum(axis=0)[None, :], k + k * k)[0] / n if k else np.zeros(0)
    mean, cov = sums_of[:k], sums_of[k:].reshape(k, k)
    error = float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0
    return Whitening(model.n, model.sums, model.vectors, model.values, model.explained, error)


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row and component.

    Rows whose vector is null or empty or holds null or non-finite entries are left out, and so are
    those of another length than the most frequent one (of equally frequent ones the longest).
    Repeated vectors count once in the fit and keep a row each in the result; ids may repeat or be
    null. Entries beyond 2**34 are held there. `deviation` is null where it doesn't fit 64 bits.
    Other columns are ignored. Without usable rows, or where all vectors are equal, the result is empty.
    """
    usable = whole_numbers(df, id_col, vector_col)
    lengths = usable.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is not None:
        usable = usable.where(F.size("x") == lengths["d"])
    model = fit(usable, components) if lengths is not None else None
    kind = df.schema[id_col].dataType
    whole = [("n", LongType()), ("deviation", LongType()), ("whitened", DoubleType()), ("explained", DoubleType()), ("identity_error", DoubleType())]
    shape = StructType([StructField("vec_id", kind), StructField("component", IntegerType()), *[StructField(a, t) for a, t in whole]])
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], shape)
    shared, k = df.sparkSession.sparkContext.broadcast(model), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            deviation, beyond = own.deviation(x)
            rows = len(x)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, own.n, np.int64)),
                pa.array(np.repeat(deviation, k), mask=np.repeat(beyond, k)),
                pa.array(own.project(x).ravel()),
                pa.array(np.tile(own.explained, rows)),
                pa.array(np.full(rows * k, own.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=shape.names)

    return usable.mapInArrow(run, shape)
