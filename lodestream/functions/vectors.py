"""Expressions on vectors, as arrays of doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TINY = 1e-9


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is null or next to nothing."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n >= TINY, dot(a, b) / n), F.lit(0.0))


def normalised(a: Column) -> Column:
    """Of unit length; null for next to nothing.

    The vector and its norm are each bound to a variable, as an expression inside a lambda is evaluated for every element.
    """

    def divided(v: Column) -> Column:
        return F.get(F.transform(F.array(norm(v)), lambda n: F.when(n >= TINY, F.transform(v, lambda x: x / n))), F.lit(0))

    return F.get(F.transform(F.array(a), divided), F.lit(0))


def added_up(batches: Iterator[pa.RecordBatch], keys: list[str], weights: list[str], vector: str = "vector") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Keys, each once, and for each of `weights` an array of its sums and, beside them, those of the vectors times it.

    The rows are sorted by `keys`. A task holds a batch and the sums of the last key.
    """
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        new[0] = True
        for k in keys:
            a, b = batch.column(k).slice(1), batch.column(k).slice(0, n - 1)
            other = pc.not_equal(a, b)
            new[1:] |= pc.if_else(pc.is_valid(other), other, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        v = batch.column(vector).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
        v = np.column_stack([np.ones(n), v])
        totals = [np.add.reduceat(v * batch.column(w).to_numpy(zero_copy_only=False)[:, None], starts, axis=0) for w in weights]
        heads = batch.select(keys).take(pa.array(starts))
        if last is not None and last[0].equals(heads.slice(0, 1)):
            for t, more in zip(totals, last[1]):
                t[0] += more[0]
        elif last is not None:
            yield last
        if len(starts) > 1:
            yield heads.slice(0, len(starts) - 1), [t[:-1] for t in totals]
        last = heads.slice(len(starts) - 1), [t[-1:] for t in totals]
    if last is not None:
        yield last


def sums(rows: DataFrame, keys: list[str], weights: list[str], vector: str = "vector") -> DataFrame:
    """keys, and for each column of `weights` its sum and, as `<name>_v`, the sum of the vectors times it.

    The rows of a key must stand in one partition, as a window or `repartition` by the keys leaves them; here they are sorted, if
    they are not.
    """
    numbers = [f for w in weights for f in (T.StructField(w, T.DoubleType()), T.StructField(f"{w}_v", T.ArrayType(T.DoubleType())))]
    schema = T.StructType([*(rows.schema[k] for k in keys), *numbers])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for heads, totals in added_up(batches, keys, weights, vector):
            columns = list(heads.columns)
            for t in totals:
                columns += [pa.array(t[:, 0]), lists(t[:, 1:])]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.select(*keys, *weights, vector).sortWithinPartitions(*keys).mapInArrow(added, schema)


def lists(rows: np.ndarray, real: np.ndarray | None = None) -> pa.ListArray:
    """The rows of a matrix as vectors; null where they are not `real`."""
    ends = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(rows.ravel()), mask=None if real is None else pa.array(~real))


def units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a matrix, of unit length, and which of them are not next to nothing."""
    n = np.sqrt((rows * rows).sum(axis=1))
    real = n >= TINY
    return rows / np.where(real, n, 1.0)[:, None], real
