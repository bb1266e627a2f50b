"""The gradients against a loop over pairs, and what the trees learn."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from lodestream.operators import evaluation, lambdarank, ranking


def pairwise(score, label):
    n = len(score)
    order = sorted(range(n), key=lambda i: (-score[i], i))
    disc = {i: 1 / math.log2(r + 2) for r, i in enumerate(order)}
    best = sum((2**y - 1) / math.log2(r + 2) for r, y in enumerate(sorted(label, reverse=True))) or 1
    g, h = [0.0] * n, [0.0] * n
    for i in range(n):
        for j in range(n):
            if label[i] > label[j]:
                change = abs((2 ** label[i] - 2 ** label[j]) * (disc[i] - disc[j])) / best
                rho = 1 / (1 + math.exp(score[i] - score[j]))
                g[i] -= change * rho
                g[j] += change * rho
                h[i] += change * rho * (1 - rho)
                h[j] += change * rho * (1 - rho)
    return g, h


def test_lambdas_against_pairs():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 9):
        score, label = rng.normal(size=(20, n)).round(1), rng.integers(0, 5, (20, n)).astype(float)
        g, h = lambdarank.lambdas(score, label)
        for r in range(20):
            a, b = pairwise(score[r], label[r])
            assert np.allclose(g[r], a) and np.allclose(h[r], b)
    g, h = lambdarank.lambdas(np.zeros((3, 4)), np.ones((3, 4)))
    assert not g.any() and not h.any()


def lists(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        m = int(rng.integers(2, 9))
        x, bias = rng.random((m, 3)), rng.random()
        y = np.clip(np.floor(4 * (x[:, 0] > 0.5) * x[:, 1] + rng.normal(scale=0.3, size=m)), 0, 4)
        rows += [(i, j, int(y[j]), float(x[j, 0]), float(x[j, 1]), float(x[j, 2]), bias) for j in range(m)]
    return spark.createDataFrame(rows, "recommendation_id long, item_id long, label int, a double, b double, c double, bias double").repartition(3)


def ndcg(scored):
    return evaluation.list_metrics(scored).agg(F.avg("ndcg")).first()[0]


def test_better_than_pointwise(spark):
    names = ["a", "b", "c", "bias"]
    train, valid = lists(spark), lists(spark, 200, 9)
    trees = lambdarank.fit(train, "recommendation_id", "label", names, trees=12, rate=0.3, leaves=8)
    mine = ndcg(ranking.tree_scores(valid, trees, names))
    model = ranking.fit_ranker(train, names, rounds=12, depth=3)
    other = ndcg(model.transform(valid).withColumn("score", F.col("prediction")))
    plain = ndcg(valid.withColumn("score", F.lit(0.0)))
    assert mine >= other - 0.005 and mine > plain + 0.05
    again = lambdarank.fit(train.repartition(5), "recommendation_id", "label", names, trees=12, rate=0.3, leaves=8)
    assert np.array_equal(trees.feature, again.feature) and np.allclose(trees.value, again.value)


def test_odd_lists(spark):
    kind = "recommendation_id long, label int, a double"
    for rows in ([], [(1, 0, 1.0), (1, 0, 2.0)], [(None, 3, 1.0)], [(1, 2, None), (1, None, 1.0), (2, 1, float("nan"))]):
        trees = lambdarank.fit(spark.createDataFrame(rows, kind), "recommendation_id", "label", ["a"], trees=2)
        assert len(trees.start) == 2 and not trees.value.any()
