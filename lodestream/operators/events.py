"""Events: validation, normalising, de-duplication, late rows, latest rows of changelogs, sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import signals
from ..functions.scalars import is_blank, is_id

UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def first_error(checks: list[tuple[str, Column]]) -> Column:
    """The code of the first check that fails (is true), or null."""
    return reduce(lambda chain, c: F.when(F.coalesce(c[1], F.lit(False)), c[0]) if chain is None else chain.when(F.coalesce(c[1], F.lit(False)), c[0]), checks, None)


def validate(events: DataFrame) -> DataFrame:
    """Adds `error`: the first of thirteen codes that applies to an event as it came in, else null.

    An event without anything in it is NULL_EVENT.
    """
    bad_number = F.col("value").isNotNull() & (F.isnan("value") | (F.abs("value") == float("inf")) | (F.col("value") < 0))
    checks = [
        ("NULL_EVENT", reduce(lambda a, b: a & b, [F.col(c).isNull() for c in events.columns])),
        ("INVALID_EVENT_ID", F.col("event_id").isNull() | ~F.col("event_id").rlike(UUID)),
        ("INVALID_USER_ID", F.col("user_id").isNull() | ~is_id(F.col("user_id"))),
        ("INVALID_DOMAIN", F.col("domain").isNull() | ~F.lower("domain").isin(*config.DOMAINS)),
        ("INVALID_EVENT_TYPE", F.col("event_type").isNull() | ~F.upper("event_type").isin(*config.EVENT_TYPES)),
        ("INVALID_ITEM_ID", (F.upper("event_type") != "SEARCH") & (F.col("item_id").isNull() | ~is_id(F.col("item_id")))),
        ("MISSING_SESSION_ID", F.col("session_id").isNull() | is_blank(F.col("session_id")) | (F.length("session_id") > 128)),
        ("MISSING_EVENT_TS", F.col("ts").isNull()),
        ("INVALID_VALUE", bad_number),
        ("INVALID_RATING", (F.upper("event_type") == "RATE") & (F.col("value").isNull() | ~F.col("value").between(1, 5))),
        ("INVALID_POSITION", F.col("position") < 0),
        ("INVALID_RECOMMENDATION_ID", F.length("recommendation_id") > 64),
        ("INVALID_COUNTRY", F.col("country").isNotNull() & ~F.col("country").rlike("^[A-Z]{2}$")),
    ]
    return events.withColumn("error", first_error(checks))


def clamp_skew(events: DataFrame, tolerance_ms: int = 60_000) -> DataFrame:
    """An event more than the tolerance ahead of its receipt gets the time of receipt."""
    return events.withColumn("ts", F.when(F.col("ts") > F.col("received_ts") + tolerance_ms, F.col("received_ts")).otherwise(F.col("ts")))


def dedupe(events: DataFrame, window_ms: int = config.DEDUPE_WINDOW, late: str | None = None) -> DataFrame:
    """Arrivals of an event id whose time is further than the window from all of its arrivals that were let through.

    Arrivals go by time of receipt. Rows that the column `late` marks pass as they are and are not remembered. Of
    arrivals with one event time only the first can pass, which is settled before the others meet: what a task holds of
    an id is its distinct times. Rows whose id is null pass as they are: nothing tells that they are one event.
    """
    rest = [c for c in events.columns if c not in ("event_id", "ts", "received_ts")]
    free = F.col("event_id").isNull() if late is None else F.col("event_id").isNull() | F.coalesce(F.col(late), F.lit(False))
    due = events.where(~free)
    first = due.groupBy("event_id", "ts").agg(F.min(F.struct("received_ts", *rest)).alias("x"))
    arrivals = first.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct(F.col("x.received_ts").alias("received_ts"), "ts", "x"))).alias("all"))
    none = F.slice("all", 1, 0)
    kept = F.aggregate("all", none, lambda done, a: F.when(F.exists(done, lambda d: F.abs(d["ts"] - a["ts"]) <= window_ms), done).otherwise(F.concat(done, F.array(a))))
    passed = arrivals.select("event_id", F.explode(kept).alias("a")).select("event_id", F.col("a.ts").alias("ts"), "a.x.*").select(events.columns)
    return passed.unionByName(events.where(free))


def mark_late(events: DataFrame, lateness_ms: int = config.MAX_LATENESS) -> DataFrame:
    """Adds `late`: older than the newest event of the same user that came before, less the lateness allowed."""
    before = Window.partitionBy("user_id").orderBy("received_ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("late", F.coalesce(F.col("ts") < F.max("ts").over(before) - lateness_ms, F.lit(False)))


def latest_per_key(changes: DataFrame, key: str, seq: str, tombstone: str | None = None) -> DataFrame:
    """The row of each key with the highest seq; keys whose latest row is a tombstone go.

    One pre-aggregated maximum, so no key's rows meet in one task.
    """
    rest = [c for c in changes.columns if c not in (key, seq)]
    best = changes.groupBy(key).agg(F.max(F.struct(seq, *rest)).alias("x")).select(key, "x.*")
    return best.where(~F.coalesce(F.col(tombstone), F.lit(False))) if tombstone else best


def session_islands(events: DataFrame) -> DataFrame:
    """user_id, domain, island, session_id, first_ts, last_ts, events: runs of one session id in order of arrival."""
    order = Window.partitionBy("user_id", "domain").orderBy("ts", "event_id")
    new = F.coalesce((F.col("session_id") != F.lag("session_id").over(order)).cast("int"), F.lit(0))
    runs = events.withColumn("_new", new).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("user_id", "domain", "island", "session_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events"))


def mark_browsing(events: DataFrame, window_ms: int = config.BROWSE_WINDOW_MS, skips: int = config.BROWSE_SKIPS) -> DataFrame:
    """Adds `browsing`: an early skip with autoplay off that is at least the n-th of its session within the window."""
    recent = Window.partitionBy("user_id", "domain", "session_id").orderBy("ts").rangeBetween(-window_ms, 0)
    marked = events.withColumn("_early", signals.early_skip())
    quick = F.sum(F.col("_early").cast("int")).over(recent) >= skips
    return marked.withColumn("browsing", F.coalesce(F.col("_early") & ~F.col("autoplay") & quick, F.lit(False))).drop("_early")


def explode_regions(events: DataFrame) -> DataFrame:
    """A row for the whole world and one for the event's country, where it has one."""
    return events.withColumn("region", F.explode(F.array_compact(F.array(F.lit("GLOBAL"), F.col("country")))))
