"""Tables that change: compare-and-set upserts, erasure, catalog merges, the outbox.

All take the stored state and a batch of changes as DataFrames and return the new state; a caller writes it to a
new place and moves on (see `streaming.jobs`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .events import latest_per_key

MARKER_DAYS = 30


def cas_upsert(stored: DataFrame, incoming: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The row of each key with the highest seq; at a tie the stored one stays."""
    both = stored.withColumn("_old", F.lit(1)).unionByName(incoming.withColumn("_old", F.lit(0)))
    rest = [c for c in stored.columns if c not in (key, seq)]
    best = both.groupBy(key).agg(F.max(F.struct(seq, "_old", *rest)).alias("x"))
    return best.select(key, "x.*").select(stored.columns)


def cas_results(stored: DataFrame, incoming: DataFrame, deleted: DataFrame, key: str, user: str, seq: str = "seq") -> DataFrame:
    """Adds `result` to the incoming rows: APPLIED, STALE, or USER_DELETED for users in `deleted`."""
    marked = deleted.select(F.col(user).alias("_user")).distinct()
    known = stored.select(F.col(key).alias("_key"), F.col(seq).alias("_seq"))
    joined = incoming.join(marked, F.col(user) == F.col("_user"), "left").join(known, F.col(key) == F.col("_key"), "left")
    result = F.when(F.col("_user").isNotNull(), "USER_DELETED").when(F.col("_seq").isNull() | (F.col(seq) > F.col("_seq")), "APPLIED").otherwise("STALE")
    return joined.withColumn("result", result).drop("_user", "_key", "_seq")


def erase_users(state: DataFrame, deletions: DataFrame, user: str, now: int | None = None) -> DataFrame:
    """The state without the users whose deletion was asked for; with `now` (ms) only markers of 30 days count."""
    alive = deletions if now is None else deletions.where(F.col("requested_ts") > now - MARKER_DAYS * 86_400_000)
    return state.join(alive.select(user).distinct(), user, "left_anti")


def merge_catalog(stored: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Stored and incoming rows as one catalog: key, the columns, seq, deleted, status.

    An incoming row that differs in any column (nulls are equal), or revives a deleted one, replaces it and
    takes the next seq; an equal one changes nothing. status: inserted, changed, unchanged, or kept.
    """
    s = stored.select(F.col(key).alias("_key"), F.struct(*columns).alias("_old"), "seq", "deleted")
    i = incoming.select(F.col(key).alias("_new_key"), F.struct(*columns).alias("_new"))
    j = s.join(i, F.col("_key") == F.col("_new_key"), "full")
    same = F.col("_old").eqNullSafe(F.col("_new")) & ~F.col("deleted")
    status = F.when(F.col("_key").isNull(), "inserted").when(F.col("_new_key").isNull(), "kept").when(same, "unchanged").otherwise("changed")
    j = j.withColumn("status", status).withColumn("x", F.coalesce("_new", "_old"))
    seq = F.coalesce("seq", F.lit(0)) + F.col("status").isin("inserted", "changed").cast("int")
    gone = F.when(F.col("status").isin("inserted", "changed"), False).otherwise(F.col("deleted"))
    return j.select(F.coalesce("_key", "_new_key").alias(key), "x.*", seq.cast("long").alias("seq"), gone.alias("deleted"), "status")


def enrich(stored: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows that aren't deleted and whose version is lower, or null, take the update's columns and version."""
    u = updates.select(F.col(key).alias("_key"), F.col("version").alias("_version"), *[F.col(c).alias(f"_{c}") for c in columns])
    j = stored.join(u, F.col(key) == F.col("_key"), "left")
    take = F.coalesce(~F.col("deleted") & F.col("_key").isNotNull() & (F.col("version").isNull() | (F.col("version") < F.col("_version"))), F.lit(False))
    new = {c: F.when(take, F.col(f"_{c}")).otherwise(F.col(c)) for c in [*columns, "version"]}
    return j.withColumn("seq", F.col("seq") + take.cast("int")).withColumns(new).select(stored.columns)


def soft_delete(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Marks the keys' rows as deleted, with the next seq, unless they are already."""
    j = stored.join(keys.select(F.col(key).alias("_key")).distinct(), F.col(key) == F.col("_key"), "left")
    hit = F.col("_key").isNotNull() & ~F.col("deleted")
    return j.withColumn("seq", F.col("seq") + hit.cast("int")).withColumn("deleted", F.col("deleted") | hit).select(stored.columns)


def relay_outbox(outbox: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """What is to be published of changed items: one row an item in its newest version, `tombstone` if deleted."""
    last = latest_per_key(outbox.select(key, "outbox_id"), key, "outbox_id")
    return last.join(items, key, "left").withColumn("tombstone", F.coalesce("deleted", F.lit(True)))
