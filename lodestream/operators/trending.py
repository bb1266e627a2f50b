"""Trending lists: counts in windows, rolling hours, top items of each region."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import signals
from ..functions.scalars import round4
from .events import explode_regions


def window_counts(events: DataFrame, window_ms: int = config.TRENDING_WINDOW) -> DataFrame:
    """domain, region, item_id, window_start, n: starts in tumbling windows, for the world and each country."""
    starts = events.withColumn("kind", signals.event_class()).where("kind = 'START' and item_id is not null")
    at = F.col("ts") - F.pmod(F.col("ts"), F.lit(window_ms))
    return explode_regions(starts).groupBy("domain", "region", "item_id", at.alias("window_start")).agg(F.count("*").alias("n"))


def trending(counts: DataFrame, now: int, hour_ms: int = config.HOUR_MS, top: int = config.TRENDING_TOP) -> DataFrame:
    """domain, region, rank, item_id, score: the last hour's starts times the root of their growth, at most twofold.

    All scores are of one `now`. Spark limits the ranking within each partition before it merges.
    """
    recent = counts.where(F.col("window_start") >= now - 2 * hour_ms)
    last, before = F.col("window_start") >= now - hour_ms, F.col("window_start") < now - hour_ms
    sums = recent.groupBy("domain", "region", "item_id").agg(F.sum(F.when(last, F.col("n")).otherwise(0)).alias("last"), F.sum(F.when(before, F.col("n")).otherwise(0)).alias("previous"))
    score = round4(F.col("last") * F.sqrt(F.least((F.col("last") + 2.0) / (F.col("previous") + 2.0), F.lit(4.0))))
    order = Window.partitionBy("domain", "region").orderBy(F.col("score").desc(), "item_id")
    ranked = sums.withColumn("score", score).where("score > 0").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).select("domain", "region", "rank", "item_id", "score")


def region_then_global(lists: DataFrame, regions: list[str], most: int) -> DataFrame:
    """domain, region, item_id, place: of each region its list, followed by the world's, each item once."""
    own = lists.where(F.col("region").isin(*regions)).withColumn("part", F.lit(0))
    world = lists.where("region = 'GLOBAL'").withColumn("region", F.explode(F.array(*map(F.lit, regions)))).withColumn("part", F.lit(1))
    first = own.unionByName(world).groupBy("domain", "region", "item_id").agg(F.min(F.struct("part", "rank")).alias("at"))
    order = Window.partitionBy("domain", "region").orderBy("at")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("domain", "region", "item_id", "place")
