"""Items engaged together, and next, within sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.scalars import decay, round4

SESSION = ["user_id", "domain", "session_id"]


def positives(weighted: DataFrame, least: float = config.CO_MIN_WEIGHT, most: int = config.CO_EMITS_MAX) -> DataFrame:
    """The session's positive engagements in order, without immediate repeats: `at` counts them from 1.

    Every one but the first gives at least one pair, so no more than one beyond the cap on pairs can matter:
    that bounds a session.
    """
    order = Window.partitionBy(*SESSION).orderBy("ts", "event_id")
    good = weighted.where((F.col("weight") >= least) & F.col("event_type").isin(*config.ENGAGING) & F.col("item_id").isNotNull())
    fresh = good.withColumn("_last", F.lag("item_id").over(order)).where("_last is null or _last != item_id")
    return fresh.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most + 1).select(*SESSION, "item_id", "ts", "at")


def pairs(engaged: DataFrame, items: int = config.SESSION_POSITIVES, most: int = config.CO_EMITS_MAX) -> DataFrame:
    """from_item, to_item, kind, ts: `next` from the item before, `co` both ways with the last few distinct items.

    A session gives at most `most` pairs, in their order.
    """
    e = engaged
    before = e.select(*SESSION, F.col("item_id").alias("other"), F.col("at").alias("other_at"))
    joined = e.join(before, SESSION).where((F.col("other_at") < F.col("at")) & (F.col("other") != F.col("item_id")))
    latest = joined.groupBy(*SESSION, "item_id", "ts", "at", "other").agg(F.max("other_at").alias("other_at"))
    order = Window.partitionBy(*SESSION, "at").orderBy(F.col("other_at").desc())
    near = latest.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= items)
    co = near.select(*SESSION, "ts", "at", F.explode(F.array(F.struct(F.col("other").alias("from_item"), F.col("item_id").alias("to_item"), F.lit(0).alias("way")), F.struct(F.col("item_id").alias("from_item"), F.col("other").alias("to_item"), F.lit(1).alias("way")))).alias("p"), "other_at")
    co = co.select(*SESSION, "ts", "at", "p.from_item", "p.to_item", F.lit("co").alias("kind"), "other_at", "p.way")
    step = Window.partitionBy(*SESSION).orderBy("at")
    after = e.withColumn("from_item", F.lag("item_id").over(step)).where("from_item is not null")
    after = after.select(*SESSION, "ts", "at", "from_item", F.col("item_id").alias("to_item"), F.lit("next").alias("kind"), F.lit(0).alias("other_at"), F.lit(0).alias("way"))
    every = Window.partitionBy(*SESSION).orderBy("at", F.col("kind").desc(), "other_at", "way")
    return co.unionByName(after).withColumn("_n", F.row_number().over(every)).where(F.col("_n") <= most).select("from_item", "to_item", "kind", "ts")


def neighbor_lists(found: DataFrame, now: int, half_life_ms: int = config.NEIGHBOR_HALF_LIFE, support: float = config.NEIGHBOR_SUPPORT, top: int = config.NEIGHBOR_TOP) -> DataFrame:
    """item_id, kind, rank, neighbor_id, score: decayed counts with enough support, over the list's largest."""
    sums = found.groupBy("from_item", "kind", "to_item").agg(F.sum(decay(F.lit(1.0), F.lit(now) - F.col("ts"), half_life_ms)).alias("n"))
    sums = sums.withColumn("n", round4(F.col("n"))).where(F.col("n") >= support)
    by = Window.partitionBy("from_item", "kind")
    ranked = sums.withColumn("rank", F.row_number().over(by.orderBy(F.col("n").desc(), "to_item"))).withColumn("most", F.max("n").over(by))
    return ranked.where(F.col("rank") <= top).select(F.col("from_item").alias("item_id"), "kind", "rank", F.col("to_item").alias("neighbor_id"), round4(F.col("n") / F.col("most")).alias("score"))
