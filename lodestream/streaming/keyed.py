"""Streams with a state of their own a key: profiles of users, throttled counts, and side outputs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from .. import config
from ..operators import events as ev_ops
from ..sources.files import Versions
from ..sources.shared import once

PROFILE = "user_id string, domain string, kind string, place int, name string, value double, ts long, seq long"


def with_deletions(events: DataFrame, deletions: DataFrame) -> DataFrame:
    """Both as one stream: a row of `deletions` (user_id, ts) has `gone`, and null for all that it lacks."""
    return events.withColumn("gone", F.lit(False)).unionByName(deletions.withColumn("gone", F.lit(True)), allowMissingColumns=True)


def _aged(value: float, at: int, now: int, half_life: int) -> float:
    return value * 2.0 ** (-max(now - at, 0) / half_life)


class UserProfile(StatefulProcessor):
    """A user's latest interactions and affinities in each domain, as the batch operators give them.

    The state has a list of the latest interactions, of which a domain keeps `recent`, and a map of decayed weights by
    domain and creator, which forgets what was not touched for `ttl` milliseconds. A deletion drops both, emits a tombstone,
    and what comes after it begins anew. Each emission has the next seq, which a deletion does not reset.
    """

    def __init__(self, recent: int = config.RECENT_MAX, most: int = config.AFFINITY_MAX, half_life: int = config.AFFINITY_HALF_LIFE, ttl: int = 90 * config.DAY_MS):
        self.limits = recent, most, half_life, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getListState("latest", "domain string, ts long, event_id long, item_id string, weight double")
        self.liking = handle.getMapState("liking", "domain string, creator string", "value double, at long", self.limits[3])
        self.newest = handle.getMapState("newest", "domain string", "ts long")
        self.seq = handle.getValueState("seq", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """The state is read once and what changed is written once: each call of it is a message to the executor."""
        recent, most, half_life, _ = self.limits
        some = pd.concat(list(rows)).sort_values(["ts", "gone", "event_id"], kind="stable")
        out, touched, changed = [], set(), set()
        seq = self.seq.get()[0] if self.seq.exists() else 0
        by: dict[str, list] = {}
        for e in self.latest.get():
            by.setdefault(e[0], []).append(tuple(e))
        likes = {tuple(k): tuple(v) for k, v in self.liking.iterator()}
        newest = {k[0]: v[0] for k, v in self.newest.iterator()}
        for r in some.itertuples():
            if r.gone:
                for state in (self.latest, self.liking, self.newest):
                    state.clear()
                by, likes, newest, touched, changed = {}, {}, {}, set(), set()
                seq += 1
                out = [(key[0], None, "tombstone", 0, None, None, int(r.ts), seq)]
                continue
            at = int(r.ts)
            by.setdefault(r.domain, []).append((r.domain, at, int(r.event_id), str(r.item_id), float(r.weight)))
            newest[r.domain] = max(at, newest.get(r.domain, at))
            touched.add(r.domain)
            if isinstance(r.creator_id, str) and r.weight:
                value, then = likes.get((r.domain, r.creator_id), (0.0, at))
                now = max(at, then)
                likes[r.domain, r.creator_id] = (_aged(value, then, now, half_life) + _aged(float(r.weight), at, now, half_life), now)
                changed.add((r.domain, r.creator_id))
        if touched:
            seq += 1
            by = {d: sorted(es, key=lambda e: (e[1], e[2]), reverse=True)[:recent] for d, es in by.items()}
            self.latest.put([e for es in by.values() for e in reversed(es)])
            for k in sorted(changed):
                self.liking.updateValue(k, likes[k])
            for domain in sorted(touched):
                self.newest.updateValue((domain,), (newest[domain],))
                out += [(key[0], domain, "recent", i + 1, e[3], e[4], e[1], seq) for i, e in enumerate(by[domain])]
                held = [(_aged(value, at, newest[domain], half_life), creator) for (d, creator), (value, at) in likes.items() if d == domain]
                best = sorted(held, key=lambda x: (-abs(x[0]), x[1]))[:most]
                out += [(key[0], domain, "creator", i + 1, creator, value, None, seq) for i, (value, creator) in enumerate(best)]
        self.seq.update((seq,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PROFILE.split(", ")]).astype({"ts": "Int64"})

    def close(self) -> None:
        pass


def user_profiles(tagged: DataFrame, **limits) -> DataFrame:
    """The profiles of users whose rows came in: user_id, domain, kind, place, name, value, ts, seq; see UserProfile.

    tagged: user_id, domain, ts, event_id, item_id, creator_id, weight, gone, of `with_deletions`. A reader takes the
    rows of the largest seq of a user and domain; a tombstone says that all before it are gone. Needs RocksDB as the state's store. Spark runs batches without data for ever where a state
    goes by the clock; a run that is to end (availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled false.
    """
    rows = tagged.where("user_id is not null").select(F.col("user_id").cast("string"), "domain", "ts", "event_id", F.col("item_id").cast("string"), F.col("creator_id").cast("string"), "weight", "gone")
    return rows.groupBy("user_id").transformWithStateInPandas(UserProfile(**limits), PROFILE, "append", "ProcessingTime")


COUNTS = "key string, kind string, value double, at long, emitted long"


class ThrottledCounts(StatefulProcessor):
    """Decayed counts of a key by kind, emitted at most once an interval, and only if they changed."""

    def __init__(self, half_life: int, interval: int):
        self.half_life, self.interval = half_life, interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "kind string", "value double, at long")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        some = pd.concat(list(rows))
        first = int(some["ms"].min())
        for kind, times in some.groupby("kind")["ms"]:
            value, then = self.counts.getValue((kind,)) or (0.0, int(times.max()))
            now = max(then, int(times.max()))
            self.counts.updateValue((kind,), (_aged(value, then, now, self.half_life) + float((2.0 ** ((times - now) / self.half_life)).sum()), now))
        if not self.due.exists():  # the first change since the last emission sets the time of the next
            now = max(timerValues.getCurrentWatermarkInMs(), first) if self.of_events else timerValues.getCurrentProcessingTimeInMs()
            at = (now // self.interval + 1) * self.interval
            self.handle.registerTimer(at)
            self.due.update((at,))
        yield pd.DataFrame(columns=[c.split()[0] for c in COUNTS.split(", ")])

    of_events = False

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        rows = [(key[0], kind[0], value, at, expiredTimerInfo.getExpiryTimeInMs()) for kind, (value, at) in self.counts.iterator()]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in COUNTS.split(", ")])

    def close(self) -> None:
        pass


class _ByEventTime(ThrottledCounts):
    of_events = True


def throttled_counts(events: DataFrame, key: str, kind: str, ts: str, half_life: int, interval: int = 30_000, event_time: bool = False) -> DataFrame:
    """key, kind, value, at, emitted: at most one emission of a key in each `interval` of milliseconds, of all its kinds.

    ts: a timestamp. A value is decayed to `at`, the newest event of its kind. Intervals are those of the clock, or, with
    `event_time`, of the watermark that `events` must then have: a replay emits what the stream did. Needs RocksDB.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(kind).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(kind).cast("string").alias("kind"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), F.col(ts).alias("event_time"))
    made = (_ByEventTime if event_time else ThrottledCounts)(half_life, interval)
    return rows.groupBy("key").transformWithStateInPandas(made, COUNTS, "append", "EventTime" if event_time else "ProcessingTime")


def side_outputs(events: DataFrame, root: str, lateness_ms: int = config.MAX_LATENESS) -> DataStreamWriter:
    """Writes each micro-batch to three sinks below `root`: bad (with its error), late, and on_time.

    An event is late if it is older than the newest one of its user that came before it, in this batch or an earlier one, less
    the lateness allowed; late and bad ones don't make others late. The newest time of each user is a table of versions,
    one a batch, written last: a batch that runs again begins at the version before, and overwrites the folders it wrote.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        newest = Versions(batch.sparkSession, f"{root}/newest")
        if newest.current() >= batch_id:
            return
        checked = once(ev_ops.validate(batch))
        known = newest.read("user_id string, known long")
        good = checked.where("error is null").join(known, "user_id", "left")
        before = Window.partitionBy("user_id").orderBy("received_ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
        seen = F.greatest(F.max("ts").over(before), F.col("known"))
        marked = once(good.withColumn("late", F.coalesce(F.col("ts") < seen - lateness_ms, F.lit(False))).drop("known", "error"))
        parts = {"bad": checked.where("error is not null"), "late": marked.where("late").drop("late"), "on_time": marked.where("not late").drop("late")}
        for name, rows in parts.items():
            rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        both = known.unionByName(marked.select("user_id", F.col("ts").alias("known")))
        newest.write(both.groupBy("user_id").agg(F.max("known").alias("known")), batch_id)

    return events.writeStream.foreachBatch(apply)
