"""Golden rows and small cases of single operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lodestream.functions import signals, texts
from lodestream.operators import catalog, experiments, monitoring, ranking, retrieval, state
from lodestream.operators import events as ev_ops
from lodestream.sources import files
from lodestream.streaming import jobs

KIND = "domain string, event_type string, value double, position_ms long, duration_ms long, seek_from_ms long, seek_to_ms long, browsing boolean, expected double"
GOLDEN = [
    ("song", "PLAY_END", 190, 1.0), ("song", "PLAY_END", 45, 0.4), ("song", "PLAY_END", 12, 0.0), ("song", "SKIP", 5, -0.8), ("song", "SKIP", 20, -0.3),
    ("song", "SKIP", 60, 0.0), ("song", "SKIP", 150, 0.2), ("song", "NOT_INTERESTED", None, -3.0), ("song", "RATE", 5, 1.5), ("song", "IMPRESSION", None, 0.0),
    ("video", "PLAY_END", 190, 1.5), ("video", "PLAY_END", 60, 0.5), ("video", "PLAY_END", 10, -0.5), ("book", "RATE", 5, 2.0), ("book", "RATE", 1, -2.0),
    ("post", "DWELL", 0.4, -0.05), ("post", "DWELL", 12, 0.3), ("elsewhere", "LIKE", None, 1.5),
]


def test_signal_weights(spark):
    rows = [(d, t, None if v is None else float(v), None, 200_000, None, None, False, w) for d, t, v, w in GOLDEN]
    rows.append(("song", "SKIP", 5.0, None, 200_000, None, None, True, -0.4))
    out = spark.createDataFrame(rows, KIND).withColumn("weight", signals.weight(F.col("browsing"))).collect()
    for r in out:
        assert r.weight == pytest.approx(r.expected), r


def test_dedupe_keeps_the_first_arrival(spark):
    rows = [("a", 0, 0), ("a", 5, 1), ("a", 10**9, 2), ("b", 3, 3)]
    out = ev_ops.dedupe(spark.createDataFrame(rows, "event_id string, ts long, received_ts long")).collect()
    assert sorted((r.event_id, r.ts) for r in out) == [("a", 0), ("a", 10**9), ("b", 3)]
    day = 86_400_000
    rows = [("a", 0, 0, False), ("a", 2 * day, 1, False), ("a", 2 * day + 5, 2, False), ("a", 1, 3, True), ("a", 1, 4, True), ("a", 5 * day, 5, None), ("a", 5 * day, 6, None)]
    out = ev_ops.dedupe(spark.createDataFrame(rows, "event_id string, ts long, received_ts long, late boolean"), late="late").collect()
    assert sorted((r.ts, r.received_ts) for r in out) == [(0, 0), (1, 3), (1, 4), (2 * day, 1), (5 * day, 5)]
    assert ev_ops.dedupe(spark.createDataFrame([], "event_id string, ts long, received_ts long, late boolean"), late="late").count() == 0


def test_late_rows(spark):
    day = 86_400_000
    rows = [("e1", 1, 2 * day, 1), ("e2", 1, day // 2, 2), ("e3", 2, 0, 3)]
    out = ev_ops.mark_late(spark.createDataFrame(rows, "event_id string, user_id long, ts long, received_ts long")).collect()
    assert {r.event_id: r.late for r in out} == {"e1": False, "e2": True, "e3": False}


def test_compare_and_set(spark):
    kind = "k string, seq long, v string"
    old, new = spark.createDataFrame([("a", 5, "x"), ("b", 1, "x")], kind), spark.createDataFrame([("a", 5, "y"), ("a", 4, "z"), ("b", 2, "y"), ("c", 1, None)], kind)
    assert sorted(map(tuple, state.cas_upsert(old, new, "k").collect())) == [("a", 5, "x"), ("b", 2, "y"), ("c", 1, None)]


def test_enrichment_by_version(spark):
    kind = "k long, tags string, version int, seq long, deleted boolean"
    stored = spark.createDataFrame([(1, None, None, 1, False), (2, "t", 2, 1, False), (3, None, None, 1, True), (4, "u", 1, 1, False)], kind)
    new = spark.createDataFrame([(1, "n", 2), (2, "n", 2), (3, "n", 2)], "k long, tags string, version int")
    out = {r.k: (r.tags, r.version, r.seq) for r in state.enrich(stored, new, "k", ["tags"]).collect()}
    assert out == {1: ("n", 2, 2), 2: ("t", 2, 1), 3: (None, None, 1), 4: ("u", 1, 1)}


def test_outbox(spark):
    outbox = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "outbox_id long, k string")
    items = spark.createDataFrame([("a", 7, False), ("b", 2, True)], "k string, seq long, deleted boolean")
    assert {r.k: (r.outbox_id, r.tombstone) for r in state.relay_outbox(outbox, items, "k").collect()} == {"a": (2, False), "b": (3, True), "c": (4, True)}


def test_texts(spark):
    row = spark.createDataFrame([("mail a.b@c.de or call +1 (555) 123-4567, @handle, see https://x.y/z", [" Jazz ", "jazz", "http://a", "x", "r & b"], "hello")], "t string, g array<string>, h string")
    out = row.select(texts.scrubbed(F.col("t")).alias("t"), texts.clean_tags(F.col("g"), 5).alias("g"), texts.java_hash(F.col("h")).alias("h"), texts.clean_explanation(F.lit(" a \n b ")).alias("e")).first()
    assert out.t == "mail [email] or call [phone], [handle], see [url]"
    assert out.g == ["jazz", "r & b"] and out.h == 99162322 and out.e == "a b"


LINE = '{"event_id": "A1", "user_id": "u", "item_id": "i", "domain": "SONG", "event_type": "PLAY_START", "event_ts": "2026-01-01T00:0%d:00Z", "context": {"country": "US"}, "media": {"duration_ms": 1000}}'


def test_event_lines(spark):
    good, bad = files.event_lines(spark.createDataFrame([(LINE % 1,), ("not json",), (None,)], "value string"))
    row = good.first()
    assert (row.event_id, row.domain, row.country, row.duration_ms) == ("a1", "song", "US", 1000) and good.count() == 1 and bad.count() == 2


def test_missing_set_is_empty(spark, tmp_path):
    assert files.read_set(spark, f"{tmp_path}/none", "a long").count() == 0
    files.export(spark.createDataFrame([(1, 0), (2, 86_400_000)], "a long, ts long"), f"{tmp_path}/set", "ts")
    assert files.read_set(spark, f"{tmp_path}/set", "a long, ts long").count() == 2


def stream(spark, folder, rows, kind):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").json(folder)
    return spark.readStream.schema(kind).json(folder)


def run(writer, tmp_path):
    q = writer.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_streams_give_what_batches_give(spark, tmp_path):
    lines = [(LINE % (i % 3),) for i in range(3)] + [(LINE.replace("A1", f"B{i}") % i,) for i in range(5)]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(f"{tmp_path}/in")
    flat, _ = files.event_lines(spark.readStream.text(f"{tmp_path}/in"))
    seen = jobs.dedupe_stream(flat)
    run(seen.writeStream.format("parquet").option("path", f"{tmp_path}/out"), tmp_path)
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a1", "b0", "b1", "b2", "b3", "b4"]


def test_windows_as_a_stream(spark, tmp_path):
    spark.createDataFrame([(LINE.replace("A1", f"B{i}") % i,) for i in range(5)], "value string").coalesce(1).write.text(f"{tmp_path}/in")
    flat, _ = files.event_lines(spark.readStream.text(f"{tmp_path}/in"))
    run(jobs.window_counts_stream(flat).writeStream.format("memory").queryName("windows").outputMode("complete"), tmp_path)
    assert {r.region: r.n for r in spark.table("windows").collect()} == {"GLOBAL": 5, "US": 5}


def test_upserts_as_a_stream(spark, tmp_path):
    kind = "user_id string, seq long, v string"
    for n, rows in enumerate(([("a", 1, "x"), ("b", 1, "x")], [("a", 2, "y"), ("b", 0, "old"), ("c", 1, "z")])):
        df = stream(spark, f"{tmp_path}/in", rows, kind)
        gone = lambda: spark.createDataFrame([("c",)], "user_id string")
        run(jobs.upsert_stream(df, f"{tmp_path}/table", "user_id", gone), tmp_path)
        assert files.Versions(spark, f"{tmp_path}/table").current() == n
    out = files.Versions(spark, f"{tmp_path}/table").read(kind)
    assert sorted(map(tuple, out.collect())) == [("a", 2, "y"), ("b", 1, "x")]


def test_attribution_as_a_stream(spark, tmp_path):
    spark.sql("select 'r' recommendation_id, 'i' item_id, timestamp'2026-01-01 00:00:00' served_ts").write.parquet(f"{tmp_path}/s")
    spark.sql(
        "select 'r' recommendation_id, 'i' item_id, 'song' domain, 'PLAY_START' event_type, cast(null as double) value, cast(null as bigint) position_ms, 1000L duration_ms, "
        "cast(null as bigint) seek_from_ms, cast(null as bigint) seek_to_ms, timestamp'2026-01-01 00:00:03' + make_interval(0, 0, 0, 0, id) event_ts from range(2)"
    ).write.parquet(f"{tmp_path}/e")
    served = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/s").schema).parquet(f"{tmp_path}/s")
    engaged = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/e").schema).parquet(f"{tmp_path}/e")
    run(jobs.attributed_stream(served, engaged).writeStream.format("parquet").option("path", f"{tmp_path}/out"), tmp_path)
    assert [(r.outcome, str(r.outcome_ts)) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("PLAYED", "2026-01-01 00:00:03")]


HALF = 1000


def test_taste_of_likes_and_dislikes(spark):
    """By hand: sums over the mass of the likes, the dislikes scaled by min(1, 0.3 * likes / dislikes)."""
    rows = [
        ("u", 0, 1.0, [1.0, 0.0]), ("u", HALF, 2.0, [0.0, 1.0]), ("u", HALF, -3.0, [1.0, 0.0]),  # likes 2.5, dislikes 3
        ("v", 0, 1.0, [1.0, 0.0]), ("v", 0, -1e-12, [1.0, 0.0]),  # next to no dislike
        ("w", 0, -1.0, [1.0, 0.0]), ("x", 0, 1.0, None),
    ]
    out = {r.user_id: r.vector for r in retrieval.taste_vectors(spark.createDataFrame(rows, "user_id string, ts long, weight double, vector array<float>"), ["user_id"], {"vector": HALF}).collect()}
    x, y = 0.5 / 2.5 - (0.3 * 2.5 / 3) * 3 / 2.5, 2 / 2.5
    n = math.hypot(x, y)
    assert set(out) == {"u", "v"} and out["u"] == pytest.approx([x / n, y / n]) and out["v"] == pytest.approx([1.0, 0.0])


def test_what_a_request_asks_with(spark):
    rows = [(1, [1.0, 0.0], [0.0, 1.0], [0.0, 1.0], None), (2, None, [0.0, 1.0], None, [1.0, 0.0]), (3, None, None, [0.0, 1.0], [1.0, 0.0]), (4, None, None, [0.0, 1.0], None), (5, None, None, None, [1.0, 0.0]), (6, None, None, None, None)]
    kind = "id long, " + ", ".join(f"{c} array<double>" for c in ("short", "long", "cross", "seed"))
    vector, reason = retrieval.context(*(F.col(c) for c in ("short", "long", "cross", "seed")))
    out = {r.id: (r.v, r.reason) for r in spark.createDataFrame(rows, kind).select("id", vector.alias("v"), reason.alias("reason")).collect()}
    n, h = math.hypot(0.6, 0.4), math.sqrt(0.5)
    want = {1: ([0.6 / n, 0.4 / n], "SIMILAR_TO_RECENT"), 2: ([0.0, 1.0], "SIMILAR_TO_TASTE"), 3: ([h, h], "CROSS_DOMAIN"), 4: ([0.0, 1.0], "CROSS_DOMAIN"), 5: ([1.0, 0.0], "ONBOARDING_MATCH")}
    assert out.pop(6)[0] is None and set(out) == set(want)
    assert all(out[i][0] == pytest.approx(v) and out[i][1] == r for i, (v, r) in want.items())


def test_only_what_may_be_shown_is_searched_and_the_rest_is_rescored(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0], False, ["DE"]), (2, [1.0, 0.1], False, ["US"]), (3, [1.0, 0.2], True, []), (4, [0.0, 1.0], None, None), (5, [1.0, 1.0], False, ["ALL", "US"]), (6, None, False, [])], "item_id long, vector array<double>, explicit boolean, regions array<string>")
    fit = retrieval.eligible(items, ["DE", "US"])
    assert sorted((r.item_id, r.region) for r in fit.collect()) == [(1, "DE"), (2, "US"), (4, "DE"), (4, "US"), (5, "DE"), (5, "US"), (6, "DE"), (6, "US")]
    asked = spark.createDataFrame([(1, [1.0, 0.0], "DE"), (2, [1.0, 0.0], "US"), (3, [1.0, 0.0], "KR")], "query_id long, vector array<double>, region string")
    got = retrieval.knn(asked, fit, 2, ("region",), itself=True).collect()
    assert sorted((r.query_id, r.rank, r.item_id) for r in got) == [(1, 1, 1), (1, 2, 5), (2, 1, 2), (2, 2, 5)]
    merged = spark.createDataFrame([(1, 1, 0.5, 0.4), (1, 2, None, None), (1, 4, None, 0.3), (1, 6, None, None), (1, 9, None, None)], "request_id long, item_id long, semantic double, fresh double")
    out = retrieval.rescored(merged, asked.withColumnRenamed("query_id", "request_id"), items).collect()
    assert {r.item_id: r.cosine for r in out} == {1: 0.5, 2: pytest.approx(0.995, abs=1e-3), 4: 0.3, 6: None, 9: None}


def test_tiles_of_a_frequent_value(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERIES", 7)
    monkeypatch.setattr(retrieval, "ITEMS", 10)
    monkeypatch.setattr(retrieval, "KEYS", 0)
    rows = [(i, [float(i % 13), float(i % 7) - 3, 1.0], "hot" if i % 5 else "cold") for i in range(90)]
    items = spark.createDataFrame(rows, "item_id long, vector array<double>, kind string")
    many = {(r.query_id, r.rank): (r.item_id, r.score) for r in retrieval.knn(items.withColumnRenamed("item_id", "query_id"), items, 4, ("kind",)).collect()}
    monkeypatch.undo()
    one = {(r.query_id, r.rank): (r.item_id, r.score) for r in retrieval.knn(items.withColumnRenamed("item_id", "query_id"), items, 4, ("kind",)).collect()}
    assert many == one and len(one) == 90 * 4


def test_nearest_items(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (120, 4)).astype(float)
    rows = [(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)] + [(500, None, "a")]
    items = spark.createDataFrame(rows, "item_id long, vector array<double>, domain string").repartition(3)
    unit = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 1e-9)
    score = np.floor(unit @ unit.T * 1e4 + 0.5) / 1e4
    for k in (3, 200):
        got = retrieval.knn(items.withColumnRenamed("item_id", "query_id"), items, k, ("domain",)).collect()
        want = [(q, r + 1, i, s) for q in range(120) for r, (s, i) in enumerate(sorted(((-score[q, i], i) for i in range(120) if i != q and i % 2 == q % 2))[:k])]
        assert sorted((r.query_id, r.rank, r.item_id, -r.score) for r in got) == want


def test_rejected_creators_and_hard_filter(spark):
    recent = spark.createDataFrame([("u", "song", "c1", -1.0, 9_000_000), ("u", "song", "c2", -1.0, 1), ("u", "song", "c3", 1.0, 9_000_000)], "user_id string, domain string, creator_id string, weight double, ts long")
    now = spark.createDataFrame([("u", "song", 9_100_000)], "user_id string, domain string, now long")
    assert [r.creator_id for r in ranking.rejected_creators(recent, now).collect()] == ["c1"]
    kind = "request_id long, user_id string, domain string, item_id string, creator_id string, popular double, seed string"
    scored = spark.createDataFrame([(1, "u", "song", i, c, p, "seed") for i, c, p in (("ok", "c3", None), ("used", "c3", None), ("by c1", "c1", None), ("unknown", None, None), ("listed", None, 0.5), ("rude", "c3", None), ("away", "c3", None), ("seed", "c3", None), ("anywhere", None, None))], kind)
    meta = spark.createDataFrame([("ok", False, ["DE"]), ("used", False, []), ("by c1", False, []), ("rude", True, []), ("away", False, ["US"]), ("seed", False, []), ("anywhere", None, None)], "item_id string, explicit boolean, regions array<string>")
    blocked = spark.createDataFrame([("u", "song", "used"), ("u", "video", "ok")], "user_id string, domain string, item_id string")
    left = ranking.hard_filter(scored, blocked, recent.where("creator_id = 'c1'"), meta, F.lit("DE"), seed="seed")
    assert sorted(r.item_id for r in left.collect()) == ["anywhere", "listed", "ok"]
    left = ranking.hard_filter(scored, blocked, recent.where("creator_id = 'c1'"), meta, F.lit("DE"), explicit=True)
    assert sorted(r.item_id for r in left.collect()) == ["anywhere", "listed", "ok", "rude", "seed"]


def test_reasons(spark):
    names = ("semantic", "cf", "next", "affinity", "trending")
    rows = [
        (0.9, 0.0, 0.0, 0.0, 0.0, True, None, None, None, "SIMILAR_TO_RECENT"), (0.9, 0.0, 0.0, 0.0, 0.0, True, 0.9, None, None, "NEW_FOR_YOU"), (0.0, 1.0, 0.0, 0.0, 1.0, False, None, "TRENDING", None, "LISTENED_TOGETHER"),
        (0.0, 0.0, 1.0, 0.0, 0.1, False, None, "TRENDING", None, "OFTEN_PLAYED_NEXT"), (0.0, 0.0, 0.0, 0.0, 1.0, False, None, "POPULAR_IN_REGION", None, "POPULAR_IN_REGION"), (0.0, 0.0, 0.0, 0.0, 1.0, False, None, None, 1.0, "POPULAR_FALLBACK"),
        (0.0, 0.0, 0.0, 0.0, 0.0, False, None, None, None, "as it came"),
    ]
    kind = ", ".join(f"f_{n} double" for n in names) + ", near boolean, fresh double, trending_reason string, popular double, want string"
    out = spark.createDataFrame(rows, kind).withColumn("reason", F.lit("as it came")).withColumn("semantic_reason", F.lit("SIMILAR_TO_RECENT")).withColumn("only_new", F.col("fresh").isNotNull()).withColumn("got", ranking.reason()).collect()
    assert [r.got for r in out] == [r.want for r in out]


def placed(spark, rows):
    return spark.createDataFrame(rows, "request_id long, item_id long, creator_id string, score double, fresh double, plays double, impressions double, place int")


def test_exploration(spark):
    head = [(1, i, f"c{i}", 1.0, None, 5.0, 99.0, i + 1) for i in range(10)]
    rest = [(1, 20, "c1", 0.5, None, 0.0, 5.0, 11), (1, 21, "new", 0.5, None, None, None, 12), (1, 22, "new", 0.5, 0.7, None, None, 13), (1, 23, "other", 0.5, None, 1.0, 19.0, 14), (1, 24, "more", 0.5, None, 1.0, 20.0, 15)]
    for strategy in ("epsilon", "thompson"):
        out = ranking.explore_rerank(placed(spark, head + rest), 10, strategy=strategy).orderBy("place").collect()
        new = [r for r in out if r.explore]
        assert len(out) == 10 and len(new) == 1 and new[0].item_id in (22, 23) and new[0].place >= 3 and 9 not in [r.item_id for r in out]
        assert [r.item_id for r in out if not r.explore] == list(range(9))
        assert new[0].propensity == 0.5 if strategy == "epsilon" else 0 < new[0].propensity <= 1
    only = head + [(1, 21, "new", 0.5, None, None, None, 11)]  # no figures are no evidence
    assert not any(r.explore for r in ranking.explore_rerank(placed(spark, only), 10).collect())


def spread(rows, limit, window, per_ten, keep):
    """The greedy walk, said once more: item by item, over (score, item, creator, genre)."""
    left, out = sorted(rows, key=lambda r: (-r[0], r[1])), []
    while left and len(out) < limit + 10:
        tens = [r[2] for r in out[len(out) - len(out) % 10 :]]
        last = [r[2] for r in out[-(window - 1) :]] if window > 1 else []
        fit = [r for r in left[:50] if r[2] is None or (r[2] not in last and tens.count(r[2]) < per_ten)]
        worth = lambda r: r[0] - ((1 - keep) * sum(x[3] == r[3] for x in out) / len(out) if out else 0)
        best = max(fit, key=worth) if fit else left[0]
        left.remove(best)
        out.append(best)
    return [r[1] for r in out + left]


def test_diversity_against_a_plain_walk(spark):
    import random

    draw = random.Random(3)
    lists = {q: [(draw.randrange(40) / 40, i, draw.choice([None, "a", "b", "c", "d"]), draw.randrange(3)) for i in range(draw.randrange(1, 80))] for q in range(25)}
    df = spark.createDataFrame([(q, i, c, g, s) for q, rows in lists.items() for s, i, c, g in rows], "request_id long, item_id long, creator_id string, genre long, score double")
    got = {}
    for r in ranking.diversity_rerank(df, 10).orderBy("request_id", "place").collect():
        got.setdefault(r.request_id, []).append(r.item_id)
    assert got == {q: spread(rows, 10, 2, 3, 0.8) for q, rows in lists.items()}


def test_requests_that_go_over_batches(spark):
    """A batch of Arrow rows may end anywhere in a request; many requests are walked at once."""
    import random

    draw = random.Random(5)
    lists = {q: [(draw.randrange(40) / 40, i, draw.choice([None, "a", "b", "c", "d"]), draw.randrange(3)) for i in range(draw.randrange(1, 120))] for q in range(40)}
    df = spark.createDataFrame([(q, i, c, g, s) for q, rows in lists.items() for s, i, c, g in rows], "request_id long, item_id long, creator_id string, genre long, score double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {}
        for r in ranking.diversity_rerank(df, 10).orderBy("request_id", "place").collect():
            got.setdefault(r.request_id, []).append(r.item_id)
        assert got == {q: spread(rows, 10, 2, 3, 0.8) for q, rows in lists.items()}
        rows = [(q, i, f"c{i}", 1.0, None if i < 10 else 0.5, 1.0, 99.0, i + 1) for q in range(30) for i in range(25)]
        out = ranking.explore_rerank(placed(spark, rows), 10).collect()
        assert len(out) == 300 and sum(r.explore for r in out) == 30 and {r.propensity for r in out if r.explore} == {1 / 15}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_many_requests_are_walked_at_once():
    """Lists of one call stay apart from each other, and cost no Python loop each."""
    import time

    import numpy as np

    rng, n, size = np.random.default_rng(3), 4000, 80
    score = -np.sort(-rng.integers(0, 1000, (n, size)) / 1000.0, axis=1).ravel()
    creator, genre = rng.integers(-1, 9, n * size), rng.integers(0, 4, n * size)
    began = time.process_time()
    place = ranking.diversify(score, creator, genre, np.arange(n) * size, 10, 2, 3, 0.8)
    assert time.process_time() - began < 10
    alone = [ranking.diversify(score[a : a + size], creator[a : a + size], genre[a : a + size], np.zeros(1, int), 10, 2, 3, 0.8) for a in range(0, 20 * size, size)]
    assert (np.concatenate(alone) == place[: 20 * size]).all() and (np.sort(place.reshape(n, size), axis=1) == np.arange(1, size + 1)).all()


def test_dumped_trees(spark):
    import numpy as np

    leaf = lambda v: {"leaf_value": v}
    split = lambda f, t, a, b, **more: {"split_feature": f, "threshold": t, "decision_type": "<=", "left_child": a, "right_child": b, **more}
    dump = {"feature_names": ["a", "b"], "tree_info": [{"tree_structure": split(0, 0.5, leaf(1), split(1, 0.0, leaf(2), leaf(4)), missing_type="NaN", default_left=False)}, {"tree_structure": split(1, -1.0, leaf(10), leaf(20), missing_type="Zero", default_left=True)}]}
    names, trees = ranking.read_trees(dump)
    x = np.array([[0.4, 5], [0.6, -2], [np.nan, 0.0], [0.6, np.nan]])
    assert names == ["a", "b"] and trees.score(x).tolist() == [1 + 20, 2 + 10, 2 + 10, 2 + 10]
    with pytest.raises(ValueError):
        ranking.read_trees({"tree_info": []})


def test_hash_buckets(spark):
    def reference(data):  # the published algorithm, byte by byte
        m, h, rest = 0x5BD1E995, (0x9747B28C ^ len(data)) % 2**32, list(data)
        while len(rest) >= 4:
            k = sum(b << 8 * i for i, b in enumerate(rest[:4])) * m % 2**32
            h, rest = h * m % 2**32 ^ (k ^ k >> 24) * m % 2**32, rest[4:]
        if rest:
            h = (h ^ sum(b << 8 * i for i, b in enumerate(rest))) * m % 2**32
        h = (h ^ h >> 13) * m % 2**32
        return h ^ h >> 15

    users = spark.createDataFrame([(str(i) * (1 + i % 4),) for i in range(50)], "user_id string")
    out = experiments.assign(users, "salt", [("control", 0, 500), ("treatment", 500, 1000)]).collect()
    for r in out:
        bucket = (reference(f"salt:{r.user_id}".encode()) & 0x7FFFFFFF) % 1000
        assert (r.bucket, r.variant_id) == (bucket, "control" if bucket < 500 else "treatment")
    z = spark.createDataFrame([(0.0,), (1.96,), (-2.5758293,)], "z double").select(experiments.p_value(F.col("z")).alias("p")).collect()
    assert [r.p for r in z] == pytest.approx([1.0, 0.0499958, 0.01], abs=1e-6)


def test_scrubbed_numbers_and_links(spark):
    rows = [("id 123456 or 12345", "id [number] or 12345"), ("HTTPS://A.B/c x", "[url] x"), ("a@b", "a@b"), ("@@ab @cd", "@@ab [handle]"), ("  x@y.org ", "[email]"), (None, None)]
    out = spark.createDataFrame(rows, "t string, want string").withColumn("got", texts.scrubbed(F.col("t"))).collect()
    assert [r.got for r in out] == [r.want for r in out]


def test_percentiles_and_running_counts(spark):
    import random

    draw = random.Random(5)
    rows = [(draw.choice([None, "a", "b"]), draw.randrange(50)) for _ in range(700)] + [("c", None), ("d", 3)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    got = sorted(((r.k is None, r.k or "", r.share, r.value) for r in monitoring.percentiles(df, "v", (0.5, 0.99, 1.0), ["k"]).collect()))
    want = []
    for k in {k for k, _ in rows}:
        values = sorted(v for x, v in rows if x == k and v is not None)
        want += [(k is None, k or "", q, values[min(len(values) - 1, math.floor(q * len(values)))]) for q in (0.5, 0.99, 1.0) if values]
    assert got == sorted(want)
    assert monitoring.percentiles(df.where("false"), "v", (0.5,), ["k"]).count() == 0


def test_picks_texts_and_pseudonyms(spark):
    import hashlib
    import hmac

    rows = [(["ok", "a b", None] + [f"i{i}" for i in range(60)], [f"g{i}" for i in range(30)], "x" * 501), (None, None, None)]
    out = catalog.onboarding_picks(spark.createDataFrame(rows, "item_ids array<string>, genres array<string>, free_text string")).collect()
    assert [(len(r.item_ids), len(r.genres), r.error) for r in out] == [(50, 20, "FREE_TEXT_TOO_LONG"), (0, 0, None)] and out[0].item_ids[:2] == ["ok", "i0"]
    secret = b"k" * 70
    row = spark.createDataFrame([("user-1",), (None,)], "u string").select(texts.pseudonym(F.col("u"), secret).alias("p"), texts.pseudonym(F.col("u"), b"short").alias("q")).collect()
    assert row[0].p == hmac.new(secret, b"user-1", hashlib.sha256).hexdigest()[:32] and row[0].q == hmac.new(b"short", b"user-1", hashlib.sha256).hexdigest()[:32] and row[1].p is None


def test_clamped_times_and_tombstones(spark):
    rows = [(100_000, 0), (50_000, 0), (0, 100_000)]
    out = ev_ops.clamp_skew(spark.createDataFrame(rows, "ts long, received_ts long")).collect()
    assert [r.ts for r in out] == [0, 50_000, 0]
    changes = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 2, True), ("b", 3, None)], "k string, seq long, gone boolean")
    assert [r.k for r in ev_ops.latest_per_key(changes, "k", "seq", "gone").collect()] == ["b"]
    nothing = spark.createDataFrame([(None,) * 11], "event_id string, user_id string, domain string, event_type string, item_id string, session_id string, ts long, value double, position int, recommendation_id string, country string")
    assert ev_ops.validate(nothing).first().error == "NULL_EVENT"
