"""Exact top-k by inner product, with elimination by a pivot table.

The distances of every vector to many pivots are computed once. For a query q and a vector x, the triangle
inequality gives |d(q,p) - d(x,p)| <= d(q,x) for each pivot p; the largest of these lower bounds is an upper
bound of the inner product, (|q|^2 + |x|^2 - bound^2) / 2, in which x counts with its own length. Pivots are looked at
in groups, those that tell most about the query first; a candidate that one group rules out is not looked at again,
and where a group rules out next to nothing, no more are looked at. What is left is evaluated in the order of
its bound until that falls below the k-th score found. Scores are those of whole numbers, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rows from which pivots are chosen and first thresholds taken.
SAMPLE = 2048
PIVOTS, GROUP = 256, 32
#: Share of the candidates left that a group of pivots has to rule out for the next one to be looked at.
PAYS = 1 / 16
#: Queries of one pass over the table (broadcast: QUERIES * (dimension + PIVOTS) * 8 bytes).
QUERIES = 4096
#: Above this, a double no longer holds every whole number.
EXACT = 2.0**52


def matrix(column: pa.Array, dimension: int, scale: float) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.reshape(-1, dimension) * scale)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Half of them farthest first, each the vector farthest from those before it; the others as the sample has them.

    Far ones stand at the edges, where distances tell much about everything; the others stand where vectors are many.
    """
    if not len(sample):
        return sample
    chosen = [int(np.argmax((sample * sample).sum(axis=1)))]
    near = distances(sample, sample[chosen])[:, 0]
    while len(chosen) < min(count // 2, len(sample)):
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, distances(sample, sample[chosen[-1:]])[:, 0])
    rest = np.setdiff1d(np.arange(len(sample)), chosen)[: count - len(chosen)]
    return sample[np.r_[chosen, rest].astype(int)]


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as int64."""
    if not len(x) or max(x.max(), -x.min()) * np.abs(q).max() * x.shape[1] < EXACT:
        return (x @ q).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in x]
    return np.array(whole, np.int64)  # an overflow raises


class Best:
    """The k best of one query so far: by score, then smaller id."""

    def __init__(self, k: int, least: int | None):
        self.k, self.ids, self.score, self.least = k, np.empty(0, np.int64), np.empty(0, np.int64), least

    def add(self, ids: np.ndarray, score: np.ndarray) -> None:
        if self.least is not None:
            may = score >= self.least
            ids, score = ids[may], score[may]
            if not len(ids):
                return
        ids, score = np.concatenate([self.ids, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score))[: self.k]
        self.ids, self.score = ids[order], score[order]
        if len(order) == self.k:
            self.least = max(self.least if self.least is not None else int(self.score[-1]), int(self.score[-1]))


class Table:
    """A batch of vectors with their pivot table, laid out so that a pivot's distances stand together."""

    def __init__(self, x: np.ndarray, dx: np.ndarray):
        self.x, self.far = x, np.ascontiguousarray(dx.T)
        self.square = np.einsum("ij,ij->i", x, x)
        self.usual = self.far.mean(axis=1) if len(x) else np.zeros(len(self.far))

    def bounds(self, q: np.ndarray, far: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose upper bound of the inner product with q reaches `least`, and these bounds.

        Pivots whose distance to q is far from what is usual come first, as they give the largest lower bounds. Once a
        group of them rules out less than PAYS of what is left, the rest are scored: that costs less than looking on.
        """
        square = self.square + q @ q
        room = 1e-9 * square + 1  # for rounding
        order = np.argsort(-np.abs(far - self.usual), kind="stable")
        left, low = None, np.zeros(len(self.x))
        for p in range(0, len(order), GROUP):
            some = order[p : p + GROUP]
            gap = self.far[some] if left is None else self.far[np.ix_(some, left)]
            gap -= far[some, None]
            np.abs(gap, out=gap)
            low = np.maximum(low, gap.max(axis=0))
            may = (square - low * low) / 2 + room >= least
            before = len(low)
            left = np.flatnonzero(may) if left is None else left[may]
            low, square, room = low[may], square[may], room[may]
            if before - len(left) < PAYS * before or not len(left):
                break
        if left is None:  # no pivots
            left = np.arange(len(self.x))
        return left, (square - low * low) / 2 + room


def search(batches: Iterator[pa.RecordBatch], asked, k: int, dimension: int, scale: float) -> Iterator[pa.RecordBatch]:
    """The best k of this partition for each query; batches have vec_id, embedding, distances to the pivots.

    The last rows, with query_id null, count the pairs that were there (vec_id) and that were scored (score).
    """
    ids, q, far, least = asked.value
    best = [Best(k, None if x is None else int(x)) for x in least]
    pairs = scored = 0
    for batch in batches:
        own = batch.column(0).to_numpy()
        x = matrix(batch.column(1), dimension, scale)
        table = Table(x, batch.column(2).flatten().to_numpy().reshape(len(own), -1))
        pairs += len(own) * len(ids)
        for b, one, away, i in zip(best, q, far, ids):
            may, bound = table.bounds(one, away, -np.inf if b.least is None else b.least)
            other = own[may] != i
            may, bound = may[other], bound[other]
            order = np.argsort(-bound, kind="stable")
            may, bound = may[order], bound[order]
            at, step = 0, 64
            while at < len(may) and (b.least is None or bound[at] >= b.least):
                some = may[at : at + step]
                if b.least is not None:
                    some = some[bound[at : at + step] >= b.least]
                b.add(own[some], scores(x[some], one))
                scored += len(some)
                at, step = at + step, step * 2
    rows = [(int(ids[i]), v, s) for i, b in enumerate(best) for v, s in zip(b.ids.tolist(), b.score.tolist())]
    for s in range(0, len(rows), 8192):
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[s : s + 8192]], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([pairs], pa.int64()), pa.array([scored], pa.int64())], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: float = 1024.0, counts: list | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other vectors.

    vectors: vec_id, embedding; other columns are ignored. A component x counts as floor(scale * x), the score is
    the inner product, ties go to the smaller vec_id. Rows with a null id, a null vector, a null or non-finite
    component take no part. `queries` picks the query rows. An id that repeats is asked once, with its smallest
    vector, and none of its rows answers it; as answers, repeated rows of another id count each. Vectors are
    compared with those of their own dimension. Too few candidates give fewer rows; an empty table gives none.

    Queries go through the table in passes of a bounded number; each is broadcast with its first threshold, the
    k-th score within a bounded sample of the rows, which tasks find. `counts` gets (pairs, pairs scored).
    """
    spark = vectors.sparkSession
    fit = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asked"))
    fit = fit.where("vec_id is not null and embedding is not null").where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    fit = fit.withColumn("size", F.size("embedding"))
    found, dimension = None, -1
    with Scratch(spark) as scratch:
        while (dimension := fit.where(F.col("size") > dimension).agg(F.min("size")).first()[0]) is not None:
            same = fit.where(F.col("size") == dimension).drop("size")
            if not dimension:  # nothing to compare: all scores are 0
                same = same.withColumn("embedding", F.array(F.lit(0.0)))
            wide = max(dimension, 1)
            sample = same.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE).toPandas()
            near = np.floor(np.array(sample["embedding"].tolist(), np.float64).reshape(-1, wide) * scale)
            known = spark.sparkContext.broadcast((sample["vec_id"].to_numpy(np.int64), near, choose_pivots(near, PIVOTS)))

            def table(batches, known=known, wide=wide):
                for batch in batches:
                    d = distances(matrix(batch.column(1), wide, scale), known.value[2])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["vec_id", "embedding", "asked", "far"])

            def thresholds(batches, known=known, wide=wide):
                ids, rows, _ = known.value
                for batch in batches:
                    least = []
                    for i, q in zip(batch.column(0).to_pylist(), matrix(batch.column(1), wide, scale)):
                        other = np.sort(scores(rows[ids != i], q))
                        least.append(int(other[-k]) if len(other) >= k else None)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], ["vec_id", "embedding", "far", "least"])

            every = scratch.table(same.mapInArrow(table, "vec_id long, embedding array<double>, asked boolean, far array<double>"), f"table-{dimension}")
            asked = every.where("asked").groupBy("vec_id").agg(F.min(F.struct("embedding", "far")).alias("x")).select("vec_id", "x.embedding", "x.far")
            asked = scratch.table(asked.mapInArrow(thresholds, "vec_id long, embedding array<double>, far array<double>, least long"), f"asked-{dimension}")
            passes = -(-asked.count() // QUERIES)
            for n in range(passes):
                rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == n).withColumn("least", F.col("least").cast("string")).toPandas()
                if not len(rows):
                    continue
                q = np.floor(np.array(rows["embedding"].tolist(), np.float64).reshape(-1, wide) * scale)
                least = [int(x) if isinstance(x, str) else None for x in rows["least"]]
                sent = spark.sparkContext.broadcast((rows["vec_id"].to_numpy(np.int64), q, np.array(rows["far"].tolist(), np.float64).reshape(len(rows), -1), least))
                part = every.select("vec_id", "embedding", "far").mapInArrow(lambda b, sent=sent, wide=wide: search(b, sent, k, wide, scale), "query_id long, vec_id long, score long")
                part = scratch.table(part, f"found-{dimension}-{n}")
                found = part if found is None else found.unionByName(part)
        if found is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        if counts is not None:
            counts.append(tuple(found.where("query_id is null").agg(F.sum("vec_id"), F.sum("score")).first()))
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        best = found.where("query_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return scratch.result(best.select("query_id", "rank", "vec_id", "score"))
