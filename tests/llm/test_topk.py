from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestream.llm import topk


def brute(rows, k, asked):
    fit = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in fit if asked(i)}):
        own = min(v for i, v in fit if i == q)
        scored = sorted(((-sum(a * b for a, b in zip(own, v)), i) for i, v in fit if i != q and len(v) == len(own)))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def check(spark, rows, k=10):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, score string, far string").repartition(3)
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 5 == 0, k).collect()))
    assert got == sorted(brute([(i, v) for i, v in rows], k, lambda i: i % 5 == 0))


def test_random_vectors(spark):
    rng = np.random.default_rng(4)
    check(spark, [(i, [float(np.float32(x)) for x in rng.normal(size=12)]) for i in range(300)])


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (10, [float("inf"), 0.0]), (15, [0.5, -0.25]), (20, [0.0, 0.0]), (7, [1.0]), (25, [3.0]), (30, []), (31, [])]
    check(spark, rows, 2)
    check(spark, [], 3)


def test_ties_go_to_the_smaller_id(spark):
    check(spark, [(i, [1.0, 0.0, 0.5]) for i in range(40)], 10)


def test_many_passes(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(5)
    check(spark, [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(200)], 3)


def test_elimination_skips_candidates(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.floor(np.concatenate([rng.normal(size=(500, 4)) * 0.01 + c for c in rng.normal(size=(6, 4)) * 5]) * 1024)
    pivots = topk.choose_pivots(x[:1000], 16)
    import pyarrow as pa

    seen = []
    scores = topk.scores
    monkeypatch.setattr(topk, "scores", lambda a, q: seen.append(len(a)) or scores(a, q))

    class Sent:
        value = (np.array([0]), x[:1], topk.distances(x[:1], pivots), [None])

    far = topk.distances(x, pivots)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array((x / 1024).tolist()), pa.array(far.tolist())], ["vec_id", "embedding", "far"])
    list(topk.search(iter([batch]), Sent, 10, 4, 1024.0))
    assert sum(seen) < len(x) / 3


def test_bounds_hold_wherever_looking_ends(monkeypatch):
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(size=(400, 6)) * 1024)
    pivots = topk.choose_pivots(x[:200], 70)
    far = topk.distances(x, pivots)
    table = topk.Table(x, far)
    ruled_out = []
    for pays in (0.0, 1 / 16, 1.0):
        monkeypatch.setattr(topk, "PAYS", pays)
        for i in range(0, 400, 40):
            product = x @ x[i]
            least = np.sort(product)[-10]
            left, bound = table.bounds(x[i], far[i], least)
            assert (bound >= product[left]).all() and set(np.flatnonzero(product >= least)) <= set(left.tolist())
            ruled_out.append(len(x) - len(left))
    assert sum(ruled_out[:10]) >= sum(ruled_out[10:20]) >= sum(ruled_out[20:]) > 0
