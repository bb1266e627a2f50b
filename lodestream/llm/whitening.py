"""Whitening of embeddings by a tall-skinny QR factorisation (TSQR); no covariance is formed to find the components.

The rows are whole numbers, so their sums are exact. Every task centres its rows by n*x - S, a whole number again, and
folds them into a triangular factor R of d x d numbers. Factors are merged in a tree, FAN at a time, each level a
shuffle of them. The singular values and right vectors of the last R are those of all centred rows: s*s/n are the
eigenvalues of the covariance, and a row's projections divided by the roots of those are its whitened values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Partial results that one task merges; the driver merges the last ones, at most so many.
FAN = 32
#: Numbers of a block of rows that a task works on at once.
BLOCK = 1 << 21
#: Whole numbers beyond this are held at it, so that the shift can't overflow.
FAR = 1 << 62
#: Singular values of less than this share of the largest count as zero: their components don't exist.
ZERO = 1e-12


def finite(vector: Column) -> Column:
    """Neither null nor with a null, infinite or NaN entry."""
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))


def whole(vector: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """floor(scale * c) + shift of each entry."""
    return F.transform(vector, lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(FAR)), F.lit(-FAR)) + shift)


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and whole numbers, some rows at a time."""
    step = max(d, BLOCK // max(d, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            some = batch.slice(at, step)
            yield some.column(0), some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exact: in 64 bits where they suffice, else in Python's whole numbers."""
    if n * _largest(x) + max(map(abs, sums)) < FAR:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(y: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; null where it is no 64-bit number."""
    if _largest(y) ** 2 * y.shape[1] < FAR:
        return np.einsum("ij,ij->i", y, y).tolist()
    return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in y)]


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's exact sums, for each length of vector: d, pos, rows, sum (as digits)."""
    found: dict[int, list] = {}
    for batch in batches:
        lists = batch.column(0)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        for d in map(int, np.unique(lengths)):
            x = lists.filter(pa.array(lengths == d)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            kind = np.int64 if len(x) * _largest(x) < FAR else object
            have = found.setdefault(d, [0, [0] * d])
            have[0] += len(x)
            have[1] = [a + int(b) for a, b in zip(have[1], x.astype(kind).sum(axis=0))]
    rows = [(d, i, n, str(s)) for d, (n, sums) in found.items() for i, s in enumerate(sums)]
    columns = [("d", pa.int32()), ("pos", pa.int32()), ("rows", pa.int64()), ("sum", pa.string())]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(columns)], [c for c, _ in columns])


def exact_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Rows and sums of each dimension of the vectors `x` of the most common length, the longer of two; (0, []) without any."""
    parts = vectors.select("x").where(F.size("x") > 0).mapInArrow(_partial_sums, "d int, pos int, rows long, sum string")
    sums = cut(parts.groupBy("d", "pos").agg(F.sum("rows").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("s")))
    best = sums.where("pos = 0").orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not best:
        return 0, []
    return best[0].n, [int(r.s) for r in sums.where(F.col("d") == best[0].d).orderBy("pos").collect()]


def tree_merged(parts: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes:
    """One result of `parts` (part, blob): FAN neighbours at a time, one level after the other."""

    def level(table: pa.Table) -> pa.Table:
        part = table.column("part").to_numpy()
        blobs = table.column("blob").to_pylist()
        return pa.table({"part": pa.array([int(part[0]) // FAN], pa.int64()), "blob": pa.array([merge([blobs[i] for i in np.argsort(part)])], pa.binary())})

    parts = cut(parts)
    while parts.count() > FAN:
        parts = cut(parts.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(level, "part long, blob binary"))
    return merge([r.blob for r in sorted(parts.collect())])


def _stored(blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([blob], pa.binary())], ["part", "blob"])


def triangular(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR factorisation of all rows x - S/n of `vectors` (an id, x)."""
    d = len(sums)

    def fold(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([r, rows]), mode="r")

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for _, x in _blocks(batches, d):
            r = fold(r, deviations(x, n, sums).astype(np.float64) / n)
        if len(r):
            yield _stored(r.tobytes())

    def merge(blobs: list[bytes]) -> bytes:
        r = np.zeros((0, d))
        for blob in blobs:
            r = fold(r, np.frombuffer(blob).reshape(-1, d))
        return r.tobytes()

    return np.frombuffer(tree_merged(vectors.mapInArrow(factor, "part long, blob binary"), merge)).reshape(-1, d)


def directions(r: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors as columns, their eigenvalues and the shares of the trace, largest first, without those that are zero.

    Of the two signs an eigenvector has the one that makes its largest entry positive.
    """
    _, s, vt = np.linalg.svd(r)
    e = s * s / n
    keep = [k for k in range(min(components, len(s))) if s[k] > ZERO * s[0]]
    v = vt[keep].T
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(len(keep))]) if keep else v
    return v, e[keep], e[keep] / e.sum() if keep else e[keep]


def _joined(a: tuple, b: tuple) -> tuple:
    """Rows, means and centred products of two sets of rows together."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def covariance(vectors: DataFrame, n: int, sums: list[int], projection: np.ndarray) -> np.ndarray:
    """The covariance, divisor n, of the projections of all rows, each block centred before it is multiplied."""
    d, k = projection.shape
    none = (0.0, np.zeros(k), np.zeros((k, k)))

    def coded(total: tuple) -> bytes:
        return np.concatenate([[total[0]], total[1], total[2].ravel()]).tobytes()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = none
        for _, x in _blocks(batches, d):
            w = deviations(x, n, sums).astype(np.float64) / n @ projection
            middle = w.mean(axis=0)
            total = _joined(total, (float(len(w)), middle, (w - middle).T @ (w - middle)))
        if total[0]:
            yield _stored(coded(total))

    def merge(blobs: list[bytes]) -> bytes:
        total = none
        for blob in blobs:
            numbers = np.frombuffer(blob)
            total = _joined(total, (numbers[0], numbers[1 : k + 1], numbers[k + 1 :].reshape(k, k)))
        return coded(total)

    numbers = np.frombuffer(tree_merged(vectors.mapInArrow(part, "part long, blob binary"), merge))
    return numbers[k + 1 :].reshape(k, k) / numbers[0]


def whiten(rows: DataFrame, components: int = 32, vector: str = "embedding", key: str = "vec_id", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """One row for each vector and component: key, component, n, deviation, whitened, explained, identity_error.

    rows: an id and a vector; other columns are ignored. Vectors that are null, empty, hold null or non-finite
    entries, or have another length than most (of two lengths as common, the longer counts) are dropped. Repeated rows and
    null ids keep their rows. Components are numbered from 1 by falling eigenvalue; those without any variance
    don't exist, so that equal vectors alone, like an empty table, give no rows. deviation is null where it
    exceeds 64 bits. The vectors are read four times (sums, factors, check, result) and never shuffled or written;
    what is shuffled are one R and one k x k matrix a task.
    """
    kind = f"`{key}` {dict(rows.dtypes)[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    clean = rows.select(key, vector).where(finite(F.col(vector)))
    clean = clean.select(key, whole(F.col(vector), scale, shift).alias("x"))
    n, sums = exact_sums(clean)
    nothing = rows.sparkSession.createDataFrame([], kind)
    if not n:
        return nothing
    d = len(sums)
    clean = clean.where(F.size("x") == d)
    v, e, explained = directions(triangular(clean, n, sums), n, components)
    k = len(e)
    if not k:
        return nothing
    projection = v / np.sqrt(e)
    error = float(np.abs(covariance(clean, n, sums, projection) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, d):
            y = deviations(x, n, sums)
            w = y.astype(np.float64) / n @ projection
            m = len(x)
            at = pa.array(np.repeat(np.arange(m), k))
            columns = [
                ids.take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(squares(y), pa.int64()).take(at),
                pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return clean.mapInArrow(project, kind)
