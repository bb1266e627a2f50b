"""Streams with state: replays end with the batch operators' rows."""

from __future__ import annotations

import json
import math
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestream.operators import features
from lodestream.streaming import keyed

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "user_id string, domain string, ts long, event_id long, item_id string, creator_id string, weight double, event_type string"


@pytest.fixture
def rocks(spark):
    conf = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": "1"}
    before = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def files(folder, batches):
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i:03}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(folder / f"{i:03}.json", (10**9 + i, 10**9 + i))  # files are taken in order of time
    return str(folder)


def run(df, target, empty_batches=False):
    df.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(empty_batches).lower())
    query = df.writeStream.format("parquet").option("path", f"{target}/out").option("checkpointLocation", f"{target}/log").trigger(availableNow=True).start()
    df.sparkSession.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert query.awaitTermination(120) and query.exception() is None
    return df.sparkSession.read.parquet(f"{target}/out")


def events(n, users=3):
    return [{"user_id": f"u{i % users}", "domain": ["song", "book"][i % 5 == 0], "ts": 1000 * i, "event_id": i, "item_id": f"i{i % 11}", "creator_id": None if i % 6 == 0 else f"c{i % 4}", "weight": [1.0, -0.5, 0.0, 0.3][i % 4], "event_type": "LIKE"} for i in range(n)]


def test_profiles_end_as_in_batch_and_deletions_clear_them(rocks, tmp_path):
    every = events(90)
    cut = 60_500
    path = files(tmp_path / "in", [every[:45], every[45:]])
    gone = files(tmp_path / "gone", [[], [{"user_id": "u1", "ts": cut}]])
    stream = rocks.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(path)
    deleted = rocks.readStream.schema("user_id string, ts long").json(gone)
    out = run(keyed.user_profiles(keyed.with_deletions(stream, deleted), recent=20, half_life=20_000), tmp_path).collect()
    assert any(r.kind == "tombstone" and r.user_id == "u1" for r in out)
    last = defaultdict(int)
    for r in out:
        if r.domain:
            last[r.user_id, r.domain] = max(last[r.user_id, r.domain], r.seq)
    final = [r for r in out if r.domain and r.seq == last[r.user_id, r.domain]]
    assert len({(r.user_id, r.domain, r.seq, r.kind, r.place) for r in out}) == len(out)
    batch = rocks.createDataFrame([tuple(e.values()) for e in every if e["user_id"] != "u1"], EVENT)
    recent = sorted((r.user_id, r.domain, r.rank, r.item_id, r.weight, r.ts) for r in features.recent_interactions(batch, 20).collect())
    assert sorted((r.user_id, r.domain, r.place, r.name, r.value, r.ts) for r in final if r.kind == "recent" and r.user_id != "u1") == recent
    want = {(r.user_id, r.domain, r.creator_id): r.affinity for r in features.affinities(batch, "creator_id", 20_000).collect()}
    got = {(r.user_id, r.domain, r.name): math.floor(r.value * 1e4 + 0.5) / 1e4 for r in final if r.kind == "creator" and r.user_id != "u1"}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-4 for k in want)


def test_deletion_after_everything_leaves_nothing(rocks, tmp_path):
    path = files(tmp_path / "in", [events(20)])
    gone = files(tmp_path / "gone", [[{"user_id": "u0", "ts": 10**9}]])
    stream, deleted = rocks.readStream.schema(EVENT).json(path), rocks.readStream.schema("user_id string, ts long").json(gone)
    out = run(keyed.user_profiles(keyed.with_deletions(stream, deleted)), tmp_path).collect()
    assert [r.kind for r in out if r.user_id == "u0"] == ["tombstone"] and any(r.user_id == "u1" for r in out)


def test_counts_are_emitted_once_an_interval(rocks, tmp_path):
    rows = [[{"item": f"i{i % 2}", "kind": "ab"[i % 3 == 0], "at": f"2026-01-01T00:{b:02}:{i:02}Z"} for i in range(20)] for b in (0, 2)]
    path = files(tmp_path / "in", [*rows, [{"item": "end", "kind": "a", "at": "2026-01-01T01:00:00Z"}], [{"item": "end", "kind": "a", "at": "2026-01-01T02:00:00Z"}]])
    stream = rocks.readStream.schema("item string, kind string, at timestamp").option("maxFilesPerTrigger", 1).json(path).withWatermark("at", "1 second")
    out = run(keyed.throttled_counts(stream, "item", "kind", "at", half_life=3_600_000, interval=60_000, event_time=True), tmp_path, empty_batches=True).where("key != 'end'").collect()
    assert out and len({(r.key, r.kind, r.emitted) for r in out}) == len(out) and all(r.emitted % 60_000 == 0 for r in out)
    flat = [r for some in rows for r in some]
    for key, kind in {(r["item"], r["kind"]) for r in flat}:
        times = [60_000 * int(r["at"][14:16]) + 1000 * int(r["at"][17:19]) for r in flat if (r["item"], r["kind"]) == (key, kind)]
        last = max((r for r in out if (r.key, r.kind) == (key, kind)), key=lambda r: r.emitted)
        assert last.value == pytest.approx(sum(2 ** (-(max(times) - t) / 3_600_000) for t in times))
        assert sum((r.key, r.kind) == (key, kind) for r in out) <= len(rows)


def test_side_outputs_lose_nothing(spark, tmp_path):
    day = 86_400_000
    columns = ["event_id", "user_id", "domain", "event_type", "item_id", "session_id", "ts", "received_ts", "value", "position", "recommendation_id", "country"]
    uuid = lambda i: f"00000000-0000-7000-8000-{i:012}"
    base = lambda i, user, ts: dict(zip(columns, [uuid(i), user, "song", "LIKE", "i1", "s1", ts, i, None, None, None, "DE"]))
    batches = [
        [base(1, "a", 5 * day), base(2, "a", 5 * day - day), base(3, "a", 4 * day - 1), base(4, "b", 1)],
        [base(5, "a", 3 * day), base(6, "a", 9 * day), base(7, "a", 7 * day), base(8, "b", 2), base(9, "b", 3) | {"user_id": "not an id"}],
        [base(10, "a", 8 * day), base(11, "a", 7 * day)],
    ]
    path = files(tmp_path / "in", batches)
    kind = "event_id string, user_id string, domain string, event_type string, item_id string, session_id string, ts long, received_ts long, value double, position int, recommendation_id string, country string"
    root = str(tmp_path / "out")

    def start():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(path)
        query = keyed.side_outputs(stream, root).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        return {n: sorted(int(r.event_id[-4:]) for r in spark.read.parquet(f"{root}/{n}").collect()) for n in ("bad", "late", "on_time")}

    want = {"bad": [9], "late": [3, 5, 7, 11], "on_time": [1, 2, 4, 6, 8, 10]}
    assert start() == want
    # the last batch runs again, as after a loss between its writes and its log
    import shutil

    for name in ("2", ".2.crc"):
        (tmp_path / "log" / "commits" / name).unlink()
    shutil.rmtree(f"{root}/newest/v=2")
    shutil.rmtree(f"{root}/late/batch=2")
    assert start() == want
