"""Features of items and users: decayed counts, rates, affinities, lists."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import signals
from ..functions.scalars import decay, round4


def newest(events: DataFrame) -> int:
    """The stream's time: the largest event time."""
    return events.agg(F.max("ts")).first()[0] or 0


def item_stats(events: DataFrame, half_life_ms: int = config.ITEM_HALF_LIFE, hour_ms: int = config.HOUR_MS, now: int | None = None) -> DataFrame:
    """item_id, impressions, plays, ctr, completion_rate, skip_rate, plays1h, velocity: one pre-aggregated pass.

    Counts decay to `now`. Rates are smoothed by priors: one start in ten impressions, one in two for what ends.
    Velocity compares the plays of the short half-life with the base rate, both an hour.
    """
    now = newest(events) if now is None else now
    age = F.lit(now) - F.col("ts")
    kind = F.col("kind")
    one, short = decay(F.lit(1.0), age, half_life_ms), decay(F.lit(1.0), age, hour_ms)
    total = lambda test, w: F.sum(F.when(test, w).otherwise(0.0))
    sums = (
        events.withColumn("kind", signals.event_class())
        .where("item_id is not null and kind != 'OTHER'")
        .groupBy("item_id")
        .agg(
            total(kind == "IMPRESSION", one).alias("impressions"), total(kind == "START", one).alias("plays"), total(kind == "COMPLETE", one).alias("completes"),
            total(kind.isin("COMPLETE", "EARLY_SKIP", "SKIP", "END"), one).alias("ends"), total(kind == "EARLY_SKIP", one).alias("early"), total(kind == "START", short).alias("plays1h"),
        )
    )
    (a, n), (b, m) = config.CTR_PRIOR, config.RATE_PRIOR
    ln2 = math.log(2)
    velocity = (F.col("plays1h") * ln2 + 1) / (F.col("plays") * ln2 / (half_life_ms / hour_ms) + 1)
    rates = {
        "impressions": F.col("impressions"), "plays": F.col("plays"), "ctr": F.least(F.lit(1.0), (F.col("plays") + a) / (F.col("impressions") + n)),
        "completion_rate": (F.col("completes") + b) / (F.col("ends") + m), "skip_rate": (F.col("early") + b) / (F.col("ends") + m), "plays1h": F.col("plays1h"), "velocity": velocity,
    }
    return sums.select("item_id", *[round4(x).alias(name) for name, x in rates.items()])


def affinities(weighted: DataFrame, by: str, half_life_ms: int = config.AFFINITY_HALF_LIFE, most: int = config.AFFINITY_MAX) -> DataFrame:
    """user_id, domain, `by`, affinity: decayed weights to the newest event of user and domain, the largest `most`."""
    last = weighted.groupBy("user_id", "domain").agg(F.max("ts").alias("now"))
    sums = (
        weighted.where(F.col(by).isNotNull() & (F.col("weight") != 0))
        .join(last, ["user_id", "domain"])
        .groupBy("user_id", "domain", by)
        .agg(F.sum(decay(F.col("weight"), F.col("now") - F.col("ts"), half_life_ms)).alias("affinity"))
    )
    best = Window.partitionBy("user_id", "domain").orderBy(F.abs(round4(F.col("affinity"))).desc(), by)
    return sums.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= most).select("user_id", "domain", by, round4(F.col("affinity")).alias("affinity"))


def recent_interactions(weighted: DataFrame, most: int = config.RECENT_MAX) -> DataFrame:
    """The latest interactions of each user and domain, by time and then event id."""
    order = Window.partitionBy("user_id", "domain").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    ranked = weighted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("user_id", "domain", "rank", "item_id", "event_type", round4(F.col("weight")).alias("weight"), "ts")


def consumed_items(events: DataFrame, windows: dict[str, int] | None = None, most: int = config.CONSUMED_MAX) -> DataFrame:
    """user_id, domain, item_id, ts: what was consumed within the domain's window before the user's newest event."""
    windows = windows or config.CONSUMED_WINDOWS
    last = events.groupBy("user_id", "domain").agg(F.max("ts").alias("now"))
    used = events.where(F.col("event_type").isin(*config.CONSUMING) | signals.engaged_dwell()).groupBy("user_id", "domain", "item_id").agg(F.max("ts").alias("ts"))
    window = F.create_map(*[F.lit(x) for pair in windows.items() for x in pair])[F.col("domain")]
    kept = used.join(last, ["user_id", "domain"]).where(F.col("ts") >= F.col("now") - window)
    order = Window.partitionBy("user_id", "domain").orderBy(F.col("ts").desc(), "item_id")
    return kept.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).select("user_id", "domain", "item_id", "ts")


def recent_set(events: DataFrame, types: tuple[str, ...], most: int) -> DataFrame:
    """A move-to-front list: user_id, domain, place, item_id of the items last touched by such events."""
    last = events.where(F.col("event_type").isin(*types)).groupBy("user_id", "domain", "item_id").agg(F.max(F.struct("ts", "event_id")).alias("at"))
    order = Window.partitionBy("user_id", "domain").orderBy(F.col("at").desc())
    return last.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("user_id", "domain", "place", "item_id")


def session_genres(weighted: DataFrame) -> DataFrame:
    """user_id, domain, session_id, genre, weight: positive weights within each session."""
    sums = weighted.where("weight > 0 and genre is not null").groupBy("user_id", "domain", "session_id", "genre").agg(F.sum("weight").alias("weight"))
    return sums.withColumn("weight", round4(F.col("weight")))
