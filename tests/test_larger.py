"""Queries on tables whose keys and values go beyond those of the smallest ones."""

from __future__ import annotations

import os

import pytest
from compare import TABLES, connection, differences

from lodestream import catalog


@pytest.fixture
def changed(spark, sf_dir, tmp_path):
    """A folder of the tables in which some are replaced."""

    def make(**tables):
        for t in TABLES:
            if t in tables:
                tables[t].write.parquet(f"{tmp_path}/{t}.parquet")
            else:
                os.symlink(f"{sf_dir}/{t}.parquet", f"{tmp_path}/{t}.parquet")
        return str(tmp_path)

    return make


def agrees(spark, d, *names):
    con = connection(d)
    for name in names:
        assert differences(catalog.queries()[name](spark, d), con, catalog.oracle_sql()[name]) == "", name


def test_values_of_zero_or_none(spark, sf_dir, changed):
    """A value of zero has no sign to turn: the fault must be planted all the same."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    d = changed(events=e.selectExpr("event_id", "ts", "user_id", "event_type", "case when event_id % 100 = 7 then 0.0 when event_id % 150 != 57 then value end as value", "props"))
    agrees(spark, d, "event_validation_errors")


def test_part_keys_beyond_a_million(spark, sf_dir, changed):
    """Keys a million apart: a new item must not take the key of a stored one."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    d = changed(part=part.unionByName(part.withColumn("p_partkey", part["p_partkey"] + 1_000_000)))
    agrees(spark, d, "catalog_outcome", "catalog_merge")


def test_candidates_are_not_shuffled_as_rows(spark, sf_dir):
    """A request is one row with lists until its items are scored: no candidate is dealt by key after that."""
    from lodestream.plans.serving import Serving

    plan = Serving(spark, sf_dir).scored(blocked=True)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("explode(found")]
    assert "Aggregate" not in above and "Window" not in above
    joins = [line for line in above.splitlines() if " Join " in line or line.startswith("Join ")]
    assert joins and all("rightHint=(strategy=broadcast)" in line for line in joins)


def test_sums_of_vectors_over_batches(spark):
    """Rows of a key in any order, over several batches, with a null key; each key gives one row."""
    from lodestream.functions import vectors

    rows = [(None if i % 7 == 3 else i % 7, float(i % 3), [1.0, float(i)]) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, w double, vector array<double>").repartition(3, "k")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = [(r.k, r.w, r.w_v) for r in vectors.sums(df, ["k"], ["w"]).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = [(k, sum(w for a, w, _ in rows if a == k), [sum(w * v[i] for a, w, v in rows if a == k) for i in (0, 1)]) for k in {r[0] for r in rows}]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_lists_of_sources_as_one(spark):
    from lodestream.operators import retrieval

    rows = [(1, "a", [(5, 0.5), (7, 0.2), (5, 0.9)], None), (2, "b", [], [(7, 0.1)]), (3, "c", None, None), (4, "d", [(9, 1.0)], [(9, 0.0), (8, 0.3)])]
    df = spark.createDataFrame(rows, f"request_id long, region string, cf {retrieval.FOUND}, here {retrieval.FOUND}").coalesce(1)
    got = {r.request_id: (r.region, [tuple(x) for x in r.found]) for r in retrieval.merge(df, ["cf", "here"]).collect()}
    assert got == {1: ("a", [(5, 0.9, None), (7, 0.2, None)]), 2: ("b", [(7, None, 0.1)]), 3: ("c", []), 4: ("d", [(8, None, 0.3), (9, 1.0, 0.0)])}


def test_lists_are_dealt_once(spark, sf_dir):
    """Lines come to their order's task, and all that a list needs is done there: no shuffle by list, or by list and item."""
    from lodestream.plans import offline

    plan = offline.ltr(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(l_orderkey" in plan and "Exchange hashpartitioning(recommendation_id" not in plan


def test_events_are_dealt_once_for_what_requests_ask_with(spark, sf_dir, monkeypatch):
    """Also if the catalog is beyond the limit for a broadcast, as long as the items that users touched are not."""
    from lodestream.operators import retrieval
    from lodestream.plans import serving
    from lodestream.sources import views

    items = views.items(spark, sf_dir)
    more = items.unionByName(items.withColumn("item_id", items["item_id"] + 1_000_000))
    monkeypatch.setattr(retrieval, "SMALL", more.count() - 1)
    plan = serving.requests(serving._acts(spark, sf_dir), more)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(user_id" in plan


@pytest.mark.parametrize("most", [0, 30_000])
def test_requests_over_batches(spark, sf_dir, monkeypatch, most):
    """Users whose events come in several batches, with vectors that are broadcast and with ones that are not."""
    from lodestream.operators import retrieval

    monkeypatch.setattr(retrieval, "SMALL", most)
    monkeypatch.setattr(retrieval, "USERS", 3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        agrees(spark, sf_dir, "query_vector", "query_reasons")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_candidates_stay_where_they_are_beyond_the_limit(spark, sf_dir, monkeypatch):
    """A catalog beyond the limit for vectors, and liked items: what candidates meet is broadcast all the same."""
    from lodestream.operators import retrieval
    from lodestream.plans import serving
    from lodestream.sources import views

    monkeypatch.setattr(retrieval, "SMALL", views.items(spark, sf_dir).count() - 1)
    plan = serving.familiarity_cap(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan[: plan.index("explode(found")].splitlines() if " Join " in line or line.startswith("Join ")]
    assert joins and all("rightHint=(strategy=broadcast)" in line for line in joins)


def test_familiar_items_against_a_loop(spark):
    """More liked items than the list has places, few of them, or none; ties by item."""
    from pyspark.sql import functions as F

    from lodestream.operators import ranking

    rows = [(q, q, i, float(i * 7 % 5), i % 10 < many) for q, many in enumerate((10, 7, 3, 0)) for i in range(q * 6 + 3)]
    liked = {q: [i for r, _, i, _, yes in rows if r == q and yes] for q in range(4)}
    want = []
    for q in range(4):
        order = sorted(((-s, i) for r, _, i, s, _ in rows if r == q))
        familiar = [x for x in order if x[1] in liked[q]]
        want += [(q, n, i) for n, (_, i) in enumerate(([x for x in order if x not in familiar[3:]] + familiar[3:])[:10], 1)]
    df = spark.createDataFrame([(q, u, i, s, liked[q]) for q, u, i, s, _ in rows], "request_id long, user_id long, item_id long, score double, liked array<long>")
    pairs = df.select("user_id", F.explode("liked").alias("item_id"))
    for given in (F.col("liked"), pairs):
        assert sorted((r.request_id, r.place, r.item_id) for r in ranking.familiarity_cap(df, given, 10).collect()) == sorted(want)
