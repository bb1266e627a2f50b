"""Attribution of engagement to served lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import signals


def explode_served(lists: DataFrame) -> DataFrame:
    """One row an item of each served list."""
    item = F.col("item")
    rows = lists.withColumn("item", F.explode("items"))
    return rows.select("recommendation_id", "user_id", "domain", "variant_id", "served_ts", item["item_id"].alias("item_id"), item["position"].alias("position"))


def attribute(served: DataFrame, engaged: DataFrame, window_ms: int = config.ATTRIBUTION_WINDOW) -> DataFrame:
    """Engagements within the window of the serving of the same item in the same list, either way round.

    An equi-join on list and item with a range on time: it also runs on two streams with watermarks.
    """
    e = engaged.withColumn("outcome", signals.outcome()).where("outcome is not null and recommendation_id is not null and item_id is not null")
    e = e.select("recommendation_id", "item_id", "outcome", F.col("ts").alias("outcome_ts"))
    joined = served.join(e, ["recommendation_id", "item_id"])
    return joined.where((F.col("outcome_ts") >= F.col("served_ts") - window_ms) & (F.col("outcome_ts") <= F.col("served_ts") + window_ms))


def outcome_rates(attributed: DataFrame) -> DataFrame:
    """domain, variant_id, outcome, n: the online counters."""
    return attributed.groupBy("domain", "variant_id", "outcome").agg(F.count("*").alias("n"))
