"""LambdaRank: boosted trees that are fitted to the pairwise gradients of NDCG within lists.

A list is one row of the training table: its labels, the bins of its features and its scores. A pass over the table gives, for
the tree that grows, the sums of gradients by leaf, feature and bin; Spark adds them up, and what comes back is as
large as the tree, whatever the number of lists. A level of a tree is a pass.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import once
from .ranking import MISSING, Trees

#: Trees after which the scores are written anew, so that a pass has few trees to walk.
REFRESH = 10
#: Numbers in a block of pairs that a task looks at.
PAIRS = 1 << 22


def lambdas(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures of lists of one length (rows): each pair of labels pulls by how much its swap changes NDCG."""
    place = np.argsort(np.argsort(-score, axis=1, kind="stable"), axis=1)
    discount = 1 / np.log2(place + 2.0)
    gain = 2.0**label - 1
    best = (-np.sort(-gain, axis=1) / np.log2(np.arange(label.shape[1]) + 2.0)).sum(axis=1)
    apart = lambda x: x[:, :, None] - x[:, None, :]
    change = np.abs(apart(gain) * apart(discount)) / np.where(best > 0, best, 1)[:, None, None]
    rho = 1 / (1 + np.exp(np.clip(apart(score), -50, 50)))
    pull = np.where(apart(label) > 0, change * rho, 0.0)
    bend = np.where(apart(label) > 0, change * rho * (1 - rho), 0.0)
    return pull.sum(axis=1) - pull.sum(axis=2), bend.sum(axis=1) + bend.sum(axis=2)


def _by_length(labels: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lists of one length at a time, few enough for their pairs: their row numbers, and the places of their values."""
    offsets = labels.offsets.to_numpy()
    starts, lengths = offsets[:-1] - offsets[0], np.diff(offsets)
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        step = max(1, PAIRS // int(n * n))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            yield some, starts[some][:, None] + np.arange(n)


class _Tree:
    """A tree on bins: nodes as (feature, bin, left, right, value); a leaf has feature -1."""

    def __init__(self):
        self.nodes: list[list] = [[-1, 0, 0, 0, 0.0]]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array([n[i] for n in self.nodes]) for i in range(4))
        at = np.zeros(len(bins), np.int64)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(bins[rows, feature[node]] <= cut[node], left[node], right[node])
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array([n[4] for n in self.nodes])[self.leaves(bins)]

    def split(self, leaf: int, feature: int, cut: int, left: float, right: float) -> tuple[int, int]:
        n = len(self.nodes)
        self.nodes[leaf][:4] = [feature, cut, n, n + 1]
        self.nodes += [[-1, 0, 0, 0, left], [-1, 0, 0, 0, right]]
        return n, n + 1


def bin_edges(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """For each feature the largest values of its bins but the last."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    found = rows.agg(*(F.percentile_approx(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), shares, 10_000).alias(f) for f in features)).first()
    return [np.unique(np.array(found[f] or [], float)) for f in features]


def as_lists(rows: DataFrame, by: str, label: str, features: list[str], edges: list[np.ndarray]) -> DataFrame:
    """by, labels, bins (a byte a feature and item), scores: a row for each list. A null label is 0, a null feature 0."""
    values = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    item = F.struct(F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("y"), F.array(*values).alias("x"))
    lists = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("items"))  # a list is as long as what was shown
    flat = lists.select(F.col(by).cast("string").alias("list"), F.transform("items", lambda i: i["y"]).alias("labels"), F.flatten(F.transform("items", lambda i: i["x"])).alias("x"))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, len(features))
            codes = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]).astype(np.uint8)
            ends = batch.column(1).offsets.to_numpy() * len(features)
            raw = codes.tobytes()
            blobs = [raw[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:])]
            zeros = pa.ListArray.from_arrays(pa.array(batch.column(1).offsets.to_numpy() - batch.column(1).offsets.to_numpy()[0], pa.int32()), pa.array(np.zeros(len(x))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary()), zeros], ["list", "labels", "bins", "scores"])

    return flat.mapInArrow(binned, "list string, labels array<double>, bins binary, scores array<double>")


def _bins(batch: pa.RecordBatch, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, features)


def _chosen(batch: pa.RecordBatch, share: float, seed: int) -> np.ndarray:
    """For each list whether the tree looks at it: by a hash of its name, so a task that runs again agrees."""
    import zlib

    return np.array([zlib.crc32(f"{seed}:{x}".encode()) < share * 2**32 for x in batch.column(0).to_pylist()])


def fit(
    rows: DataFrame, by: str, label: str, features: list[str], trees: int = 200, rate: float = 0.05, leaves: int = 31, least: int = 20, bins: int = 64, lists: float = 0.8, columns: float = 0.9, ridge: float = 1e-3, seed: int = 7,
) -> Trees:
    """The ensemble of `trees`, for `ranking.tree_scores` with the same features.

    Trees grow level by level to at most `leaves` leaves of at least `least` items; each looks at a share of the lists and
    of the features. A list whose labels are all equal pulls at nothing. Without rows, or where nothing can be told apart,
    trees have one leaf of 0.
    """
    edges = bin_edges(rows, features, bins)
    table = once(as_lists(rows, by, label, features, edges))
    width, depth, fitted, fresh = len(features), math.ceil(math.log2(max(leaves, 2))), [], []
    for number in range(trees):
        tree, found = _Tree(), np.random.default_rng([seed, number])
        allowed = sorted(found.choice(width, max(1, round(columns * width)), replace=False).tolist())
        growing = [0]
        for _ in range(depth):
            growing = _grow(table, tree, growing, fresh, allowed, width, bins, least, ridge, rate, leaves, lists, seed * 100_003 + number)
            if not growing:
                break
        fitted.append(tree)
        fresh.append(tree)
        if len(fresh) == REFRESH:
            table, fresh = once(_rescored(table, fresh, width)), []
    at = lambda f, cut: float(edges[f][cut])
    return Trees([[(n[0], at(n[0], n[1]) if n[0] >= 0 else 0.0, n[2], n[3], n[4], True, MISSING["None"]) for n in t.nodes] for t in fitted])


def _rescored(table: DataFrame, trees: list[_Tree], width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _bins(batch, width)
            scores = batch.column(3)
            now = scores.flatten().to_numpy() + sum(t.values(x) for t in trees)
            offsets = pa.array(scores.offsets.to_numpy() - scores.offsets.to_numpy()[0], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(offsets, pa.array(now))], batch.schema.names)

    return table.mapInArrow(run, table.schema)


def _grow(table, tree, growing, fresh, allowed, width, bins, least, ridge, rate, leaves, lists, seed) -> list[int]:
    """Splits the leaves `growing` where that gains most; returns the new ones."""
    number = {leaf: i for i, leaf in enumerate(growing)}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(number) * width * bins))
        for batch in batches:
            x = _bins(batch, width)
            if not len(x):
                continue
            score = batch.column(3).flatten().to_numpy() + sum((t.values(x) for t in fresh), np.zeros(len(x)))
            label, chosen = batch.column(1).flatten().to_numpy(), _chosen(batch, lists, seed)
            g, h, n = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
            for which, places in _by_length(batch.column(1)):
                places = places[chosen[which]]
                if len(places):
                    g[places], h[places] = lambdas(score[places], label[places])
                    n[places] = 1
            leaf = tree.leaves(x)
            mine = np.array([number.get(i, -1) for i in range(len(tree.nodes))])[leaf]
            here = np.flatnonzero((mine >= 0) & (n > 0))
            for f in allowed:
                cell = (mine[here] * width + f) * bins + x[here, f]
                for i, v in enumerate((g, h, n)):
                    total[i] += np.bincount(cell, v[here], total.shape[1])
        cells = np.flatnonzero(total[2])
        if len(cells):
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), *(pa.array(t[cells]) for t in total)], ["cell", "g", "h", "n"])

    added = table.mapInArrow(sums, "cell int, g double, h double, n double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    cube = np.zeros((3, len(number) * width * bins))
    for r in added.collect():  # at most leaves * features * bins
        cube[:, r.cell] = r.g, r.h, r.n
    g, h, n = cube.reshape(3, len(number), width, bins)
    worth = lambda a, b: a * a / (b + ridge)
    found = []
    for leaf, i in number.items():
        best = None
        for f in allowed:
            gl, hl, nl = g[i, f].cumsum()[:-1], h[i, f].cumsum()[:-1], n[i, f].cumsum()[:-1]
            gr, hr, nr = g[i, f].sum() - gl, h[i, f].sum() - hl, n[i, f].sum() - nl
            gain = np.where((nl >= least) & (nr >= least), worth(gl, hl) + worth(gr, hr) - worth(gl + gr, hl + hr), 0.0)
            cut = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[cut] > 1e-12 and (best is None or gain[cut] > best[0]):
                best = (float(gain[cut]), leaf, f, cut, -rate * gl[cut] / (hl[cut] + ridge), -rate * gr[cut] / (hr[cut] + ridge))
        if best:
            found.append(best)
    room = leaves - sum(node[0] < 0 for node in tree.nodes)
    found = sorted(found, key=lambda b: (-b[0], b[1]))[:room]
    return list(itertools.chain(*(tree.split(leaf, f, cut, float(a), float(b)) for _, leaf, f, cut, a, b in sorted(found, key=lambda b: b[1]))))
