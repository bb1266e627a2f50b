"""Whitened vectors against the eigenvectors of the covariance, and odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from odd import stored

from lodestream.llm import whitening

KIND = "vec_id long, embedding array<float>, label int, x string, n long, part int, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3, "c") for i, v in rows], KIND).repartition(3)


def plain(vectors, components=32):
    x = np.floor(64 * np.array(vectors, np.float64)) + 1_000_000
    n = len(x)
    sums = [sum(map(int, c)) for c in x.T]
    deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    y = (n * x - np.array(sums, np.float64)) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    return deviation, (y @ v / np.sqrt(np.maximum(e, 1e-300)))[:, :components], (e / e.sum())[:components]


def test_against_covariance(spark):
    rows = stored(spark, "/root/testdata/sf0.01", "embeddings")
    got = whitening.whiten(rows)
    kinds = dict(got.dtypes)
    assert (kinds["vec_id"], kinds["component"], kinds["n"], kinds["deviation"], kinds["whitened"]) == ("bigint", "int", "bigint", "bigint", "double")
    vectors = {r.vec_id: list(r.embedding) for r in rows.collect() if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)}
    out = got.toPandas()
    deviation, white, explained = plain(list(vectors.values()))
    assert len(out) == 32 * len(vectors) and set(out.n) == {len(vectors)}
    wide = out.pivot(index="vec_id", columns="component", values="whitened").loc[list(vectors)].to_numpy()
    assert max(min(np.abs(wide[:, k] - white[:, k]).max(), np.abs(wide[:, k] + white[:, k]).max()) for k in range(32)) < 1e-7
    assert out[out.component == 1].set_index("vec_id").loc[list(vectors)].deviation.tolist() == deviation
    assert np.allclose(out.groupby("component").explained.first(), explained, rtol=1e-9)
    centred = wide - wide.mean(axis=0)
    error = np.abs(centred.T @ centred / len(wide) - np.eye(32)).max()
    assert out.identity_error.nunique() == 1 and error < 1e-9 and out.identity_error.iloc[0] < 1e-9


def test_odd_rows(spark):
    good = [(1, [0.5, 0.25]), (2, [0.5, -1.0]), (2, [0.5, -1.0]), (None, [3.0, 2.0]), (4, [-1.0, 0.1])]
    bad = [(5, None), (6, [0.1, None]), (7, [float("nan"), 0.1]), (8, [float("inf"), 0.1]), (9, [1.0]), (10, []), (11, [-float("inf"), 0.0])]
    out = whitening.whiten(table(spark, good + bad)).collect()
    assert sorted((str(r.vec_id), r.component) for r in out) == sorted((str(i), k) for i, _ in good for k in (1, 2))
    deviation, white, _ = plain([v for _, v in good])
    assert sorted(r.deviation for r in out if r.component == 1) == sorted(deviation)
    assert np.allclose(sorted(abs(r.whitened) for r in out), np.sort(np.abs(white).ravel()))


def test_no_variance_and_no_rows(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    out = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])).collect()
    assert {r.component for r in out} == {1} and abs(out[0].explained - 1) < 1e-12


def test_far_numbers_are_exact(spark):
    far = [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [3e38, 2.0]), (4, [0.0, 3.0])]
    out = whitening.whiten(table(spark, far)).collect()
    assert {r.vec_id for r in out} == {1, 2, 3, 4} and all(r.deviation is None for r in out)
    assert whitening.squares(np.array([[3_037_000_500, 0], [3, 4]], object)) == [None, 25] and whitening.squares(np.array([[3, 4]])) == [25]
    assert whitening.deviations(np.array([[1 << 61]]), 8, [5]).tolist() == [[(1 << 64) - 5]]


@pytest.mark.parametrize("parts", [1, 7, 90])
def test_tree_of_factors(spark, parts, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 4)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, x array<double>").repartition(parts)
    whole = rows.selectExpr("vec_id", "transform(x, c -> floor(c * 64) + 1000000) AS x")
    n, sums = whitening.exact_sums(whole)
    r = whitening.triangular(whole, n, sums)
    x = np.array([row.x for row in whole.collect()], np.float64)
    y = x - x.mean(axis=0)
    assert n == 200 and np.allclose(r.T @ r, y.T @ y, rtol=1e-9)
