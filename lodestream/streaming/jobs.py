"""The write path as streams: de-duplication, windows, attribution, and the upsert of features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import signals
from ..operators import events as ev_ops
from ..operators import state
from ..sources.files import Versions


def dedupe_stream(events: DataFrame, ts: str = "event_ts", window: str = "24 hours") -> DataFrame:
    """The first arrival of each event id; ids are remembered for the watermark's length."""
    return events.withWatermark(ts, window).dropDuplicatesWithinWatermark(["event_id"])


def window_counts_stream(events: DataFrame, ts: str = "event_ts", width: str = "15 minutes", grace: str = "10 minutes") -> DataFrame:
    """Starts a domain, region and item in tumbling windows; absolute counts, so writing one again changes nothing."""
    starts = events.withColumn("kind", signals.event_class()).where("kind = 'START' and item_id is not null")
    counts = ev_ops.explode_regions(starts.withWatermark(ts, grace)).groupBy(F.window(ts, width).alias("w"), "domain", "region", "item_id").count()
    return counts.select("domain", "region", "item_id", F.col("w.start").alias("window_start"), F.col("count").alias("n"))


def attributed_stream(served: DataFrame, engaged: DataFrame, window: str = "30 minutes", grace: str = "5 minutes") -> DataFrame:
    """Engagements within the window of a serving, either way round; both sides forget what is older."""
    s = served.withWatermark("served_ts", grace)
    e = engaged.withColumn("outcome", signals.outcome()).where("outcome is not null and recommendation_id is not null and item_id is not null")
    e = e.select(F.col("recommendation_id").alias("_rec"), F.col("item_id").alias("_item"), "outcome", F.col("event_ts").alias("outcome_ts")).withWatermark("outcome_ts", grace)
    near = F.expr(f"outcome_ts between served_ts - interval {window} and served_ts + interval {window}")
    return s.join(e, (F.col("recommendation_id") == F.col("_rec")) & (F.col("item_id") == F.col("_item")) & near).drop("_rec", "_item")


def upsert_stream(rows: DataFrame, root: str, key: str, deletions: Callable[[], DataFrame] | None = None, user: str = "user_id") -> DataStreamWriter:
    """Writes each micro-batch into the table of versions at `root`, by compare-and-set on seq.

    A batch becomes version batch_id: one that runs again starts from the version before and gives the same.
    """
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def apply(batch: DataFrame, batch_id: int) -> None:
        table = Versions(batch.sparkSession, root)
        at = table.current()
        if at >= batch_id:
            return
        after = state.cas_upsert(table.read(kind), batch, key)
        table.write(after if deletions is None else state.erase_users(after, deletions(), user), batch_id)

    return rows.writeStream.foreachBatch(apply)
