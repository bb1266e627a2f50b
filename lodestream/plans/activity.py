"""Queries over events: signals, items, users, trending, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import signals
from ..functions.scalars import round4
from ..operators import events as ev_ops
from ..operators import features, neighbors, trending
from ..sources import views
from . import sql

DAY = config.DAY_MS
#: The driver's events are sparse: its days stand for the engine's quarter-hours, its weeks for hours.
WINDOW, HOUR = DAY, 7 * DAY
WEIGHTED_SQL = f"w AS (SELECT ev.*, {sql.weight()} AS weight FROM ev)"
NOW = "(SELECT max(ts) FROM ev)"


def weighted(spark, d):
    return views.events(spark, d).withColumn("weight", signals.weight())


def with_items(spark, d):
    e = weighted(spark, d)
    return e.join(views.items(spark, d).select("item_id", "creator_id", "genre"), "item_id", "left")


def item_stats(spark, d):
    return features.item_stats(views.events(spark, d))


_C = "CASE WHEN kind {} THEN pow(2.0::DOUBLE, -greatest(now - ts, 0) / {}::DOUBLE) ELSE 0.0::DOUBLE END"
_H = float(config.ITEM_HALF_LIFE)
ITEM_STATS_CTE = f"""ik AS (SELECT ev.*, {sql.CLASS} AS kind, {NOW} AS now FROM ev),
 isum AS (SELECT item_id, sum({_C.format("= 'IMPRESSION'", _H)}) AS impressions, sum({_C.format("= 'START'", _H)}) AS plays, sum({_C.format("= 'COMPLETE'", _H)}) AS completes,
   sum({_C.format("IN ('COMPLETE', 'EARLY_SKIP', 'SKIP', 'END')", _H)}) AS ends, sum({_C.format("= 'EARLY_SKIP'", _H)}) AS early, sum({_C.format("= 'START'", float(config.HOUR_MS))}) AS plays1h
   FROM ik WHERE kind <> 'OTHER' AND item_id IS NOT NULL GROUP BY item_id),
 item_stats AS (SELECT item_id, {sql.round4('impressions')} AS impressions, {sql.round4('plays')} AS plays, {sql.round4('least(1.0, (plays + 1.0) / (impressions + 10.0))')} AS ctr,
   {sql.round4('(completes + 1.0) / (ends + 2.0)')} AS completion_rate, {sql.round4('(early + 1.0) / (ends + 2.0)')} AS skip_rate, {sql.round4('plays1h')} AS plays1h,
   {sql.round4('(plays1h * ln(2.0::DOUBLE) + 1) / (plays * ln(2.0::DOUBLE) / 24.0 + 1)')} AS velocity FROM isum)"""


def signal_weights(spark, d):
    e = ev_ops.mark_browsing(views.events(spark, d), window_ms=DAY, skips=2).withColumn("weight", signals.weight(F.col("browsing")))
    return e.select("event_id", "domain", "event_type", "browsing", round4(F.col("weight")).alias("weight"))


_BROWSE = f"""b0 AS (SELECT ev.*, {sql.EARLY} AS early FROM ev),
 b AS (SELECT * EXCLUDE (early), coalesce(early AND NOT autoplay AND sum(early::INT) OVER (PARTITION BY user_id, domain, session_id ORDER BY ts RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) >= 2, false) AS browsing FROM b0)"""


def event_classes(spark, d):
    e = views.events(spark, d).withColumn("kind", signals.event_class()).withColumn("outcome", signals.outcome())
    return e.groupBy("domain", "event_type", "kind", "outcome").agg(F.count("*").alias("n"))


_OUT = f"""CASE WHEN event_type = 'IMPRESSION' THEN 'IMPRESSED' WHEN event_type IN ('PLAY_START', 'CLICK') OR {sql.DWELT} THEN 'PLAYED' WHEN event_type = 'RATE' AND value >= 4 THEN 'LIKED'
  WHEN event_type = 'RATE' AND value <= 2 THEN 'DISLIKED' WHEN event_type = 'PLAY_END' AND {sql.COMPLETE} THEN 'COMPLETED' WHEN {sql.EARLY} THEN 'SKIPPED_EARLY' WHEN event_type = 'LIKE' THEN 'LIKED'
  WHEN event_type = 'SAVE' THEN 'SAVED' WHEN event_type IN ('DISLIKE', 'NOT_INTERESTED') THEN 'DISLIKED' END"""


def dedupe_events(spark, d):
    e = views.events(spark, d)
    again = e.where("event_id % 10 = 0").withColumns({"received_ts": F.col("received_ts") + 1000, "ts": F.col("ts") + F.when(F.col("event_id") % 20 == 0, 2 * DAY).otherwise(5)})
    third = again.withColumns({"received_ts": F.col("received_ts") + 1000, "ts": F.col("ts") + 5})
    return ev_ops.dedupe(e.unionByName(again).unionByName(third)).select("event_id", "user_id", "ts", "received_ts")


def late_events(spark, d):
    e = views.events(spark, d).withColumn("received_ts", F.col("ts") + F.when(F.col("event_id") % 7 == 0, 3 * DAY).otherwise(0))
    return ev_ops.mark_late(e).where("late").select("event_id", "user_id", "ts", "received_ts")


def event_validation_errors(spark, d):
    e = views.events(spark, d)
    uuid = F.concat(F.lit("00000000-0000-7000-8000-"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    raw = e.select(
        F.when(F.col("event_id") % 50 == 0, F.lit("x")).otherwise(uuid).alias("event_id"), F.when(F.col("event_id") % 50 == 1, F.lit("a b")).otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(F.col("event_id") % 50 == 2, F.lit("radio")).otherwise(F.col("domain")).alias("domain"), F.when(F.col("event_id") % 50 == 3, F.lit("HUM")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 50 != 4, F.col("item_id").cast("string")).alias("item_id"), F.when(F.col("event_id") % 100 == 5, F.lit(" \t\u2003")).when(F.col("event_id") % 50 == 5, F.lit("\n")).otherwise(F.col("session_id")).alias("session_id"),
        F.when(F.col("event_id") % 50 != 6, F.col("ts")).alias("ts"), F.when(F.col("event_id") % 50 == 7, -1 - F.abs(F.coalesce("value", F.lit(0.0)))).otherwise(F.col("value")).alias("value"),
        F.when(F.col("event_id") % 50 == 8, -1).otherwise(1).alias("position"), F.when(F.col("event_id") % 50 == 9, F.repeat(F.lit("r"), 65)).otherwise("r").alias("recommendation_id"),
        F.when(F.col("event_id") % 50 == 10, F.lit("usa")).otherwise(F.col("country")).alias("country"),
    )
    return ev_ops.validate(raw).groupBy("error").agg(F.count("*").alias("n"))


VALIDATION_SQL = """SELECT error, count(*) AS n FROM (SELECT CASE event_id % 50 WHEN 0 THEN 'INVALID_EVENT_ID' WHEN 1 THEN 'INVALID_USER_ID' WHEN 2 THEN 'INVALID_DOMAIN' WHEN 3 THEN 'INVALID_EVENT_TYPE'
  WHEN 4 THEN 'INVALID_ITEM_ID' WHEN 5 THEN 'MISSING_SESSION_ID' WHEN 6 THEN 'MISSING_EVENT_TS' WHEN 7 THEN 'INVALID_VALUE' WHEN 8 THEN 'INVALID_POSITION' WHEN 9 THEN 'INVALID_RECOMMENDATION_ID'
  WHEN 10 THEN 'INVALID_COUNTRY' END AS error FROM events) GROUP BY error"""


def trending_windows(spark, d):
    return trending.window_counts(views.events(spark, d), WINDOW)


TREND_CTE = f"""counts AS (SELECT domain, region, item_id, ts - ts % {WINDOW} AS window_start, count(*) AS n
   FROM (SELECT *, unnest(['GLOBAL', country]) AS region FROM ev WHERE {sql.CLASS} = 'START' AND item_id IS NOT NULL) GROUP BY ALL),
 tsum AS (SELECT domain, region, item_id, CAST(sum(CASE WHEN window_start >= {NOW} - {HOUR} THEN n ELSE 0 END) AS BIGINT) AS last, CAST(sum(CASE WHEN window_start < {NOW} - {HOUR} THEN n ELSE 0 END) AS BIGINT) AS previous
   FROM counts WHERE window_start >= {NOW} - {2 * HOUR} GROUP BY ALL),
 tscore AS (SELECT *, {sql.round4('last * sqrt(least((last + 2.0::DOUBLE) / (previous + 2.0::DOUBLE), 4.0::DOUBLE))')} AS score FROM tsum),
 trend AS (SELECT domain, region, CAST(row_number() OVER (PARTITION BY domain, region ORDER BY score DESC, item_id) AS INTEGER) AS rank, item_id, score FROM tscore WHERE score > 0)"""

_WORLD = ", ".join(f"'{c}'" for c in views.COUNTRIES)
POPULAR_CTE = f"""pu AS (SELECT domain, region, item_id, min((part, rank)) AS pos FROM (SELECT domain, region, item_id, 0 AS part, rank FROM trend WHERE region <> 'GLOBAL' AND rank <= {config.TRENDING_TOP}
   UNION ALL SELECT domain, unnest([{_WORLD}]), item_id, 1, rank FROM trend WHERE region = 'GLOBAL' AND rank <= {config.TRENDING_TOP}) GROUP BY ALL),
 popular AS (SELECT domain, region, item_id, row_number() OVER (PARTITION BY domain, region ORDER BY pos) AS place FROM pu)"""


def trending_lists(spark, d, top=10):
    e = views.events(spark, d)
    return trending.trending(trending.window_counts(e, WINDOW), features.newest(e), HOUR, top)


def popular_fallback(spark, d):
    return trending.region_then_global(trending_lists(spark, d, config.TRENDING_TOP), list(views.COUNTRIES), 20)


def affinity_creator(spark, d):
    return features.affinities(with_items(spark, d), "creator_id")


def affinity_genre(spark, d):
    return features.affinities(with_items(spark, d), "genre")


def _affinity_sql(by):
    return f"""{sql.cte(sql.EV, sql.ITEM, WEIGHTED_SQL)}, wi AS (SELECT w.*, item.creator_id, item.genre FROM w LEFT JOIN item USING (item_id)),
 last AS (SELECT user_id, domain, max(ts) AS now FROM wi GROUP BY ALL),
 s AS (SELECT user_id, domain, {by}, {sql.round4('sum(' + sql.decay('weight', 'now - ts', config.AFFINITY_HALF_LIFE) + ')')} AS affinity FROM wi JOIN last USING (user_id, domain) WHERE {by} IS NOT NULL AND weight <> 0 GROUP BY ALL)
 SELECT user_id, domain, {by}, affinity FROM s QUALIFY row_number() OVER (PARTITION BY user_id, domain ORDER BY abs(affinity) DESC, {by}) <= {config.AFFINITY_MAX}"""


def recent_interactions(spark, d):
    return features.recent_interactions(weighted(spark, d))


def consumed_items(spark, d):
    return features.consumed_items(views.events(spark, d))


_WINDOWS = "CASE domain " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in config.CONSUMED_WINDOWS.items()) + " END"
CONSUMED_CTE = f"""used AS (SELECT user_id, domain, item_id, max(ts) AS ts FROM ev WHERE event_type IN {config.CONSUMING!r} OR {sql.DWELT} GROUP BY ALL),
 cnow AS (SELECT user_id, domain, max(ts) AS now FROM ev GROUP BY ALL),
 consumed AS (SELECT user_id, domain, item_id, ts FROM used JOIN cnow USING (user_id, domain) WHERE ts >= now - {_WINDOWS}
   QUALIFY row_number() OVER (PARTITION BY user_id, domain ORDER BY ts DESC, item_id) <= {config.CONSUMED_MAX})"""


def liked_lru(spark, d):
    return features.recent_set(views.events(spark, d), ("LIKE", "SAVE"), config.LIKED_MAX)


def session_genres(spark, d):
    return features.session_genres(with_items(spark, d))


def session_islands(spark, d):
    return ev_ops.session_islands(views.events(spark, d))


def browsing_skips(spark, d):
    return ev_ops.mark_browsing(views.events(spark, d), window_ms=DAY, skips=2).where("browsing").select("event_id", "user_id", "session_id")


def pairs_of(weighted):
    """Pairs within sessions. A session is what falls into one hour of the engine, a week of the driver's data."""
    e = weighted.withColumn("session_id", F.floor(F.col("ts") / HOUR)).withColumn("weight", F.when(F.col("event_type") == "SAVE", 1.2).otherwise(F.col("weight")))
    return neighbors.pairs(neighbors.positives(e))


def neighbor_pairs(spark, d):
    return pairs_of(weighted(spark, d))


def _neighbors(kind):
    def run(spark, d):
        found = neighbor_pairs(spark, d)
        return neighbors.neighbor_lists(found, features.newest(views.events(spark, d)), support=0.5).where(F.col("kind") == kind)

    return run


PAIRS_CTE = f"""pw AS (SELECT * REPLACE (CASE WHEN event_type = 'SAVE' THEN 1.2::DOUBLE ELSE weight END AS weight, ts // {HOUR} AS session_id) FROM w),
 p0 AS (SELECT user_id, domain, session_id, item_id, ts, event_id, lag(item_id) OVER (PARTITION BY user_id, domain, session_id ORDER BY ts, event_id) AS prev FROM pw WHERE weight >= 0.4 AND event_type IN {config.ENGAGING!r} AND item_id IS NOT NULL),
 p AS (SELECT user_id, domain, session_id, item_id, ts, pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id, domain, session_id ORDER BY ts, event_id) AS pos FROM p0 WHERE prev IS NULL OR prev <> item_id) WHERE pos <= 201),
 pj AS (SELECT a.user_id, a.domain, a.session_id, a.item_id, a.ts, a.pos, b.item_id AS other, max(b.pos) AS other_at FROM p a JOIN p b USING (user_id, domain, session_id) WHERE b.pos < a.pos AND b.item_id <> a.item_id GROUP BY ALL),
 near AS (SELECT * FROM pj QUALIFY row_number() OVER (PARTITION BY user_id, domain, session_id, pos ORDER BY other_at DESC) <= 5),
 raw AS (SELECT user_id, domain, session_id, ts, pos, other AS from_item, item_id AS to_item, 'co' AS kind, other_at, 0 AS way FROM near UNION ALL SELECT user_id, domain, session_id, ts, pos, item_id, other, 'co', other_at, 1 FROM near
   UNION ALL SELECT * FROM (SELECT user_id, domain, session_id, ts, pos, lag(item_id) OVER (PARTITION BY user_id, domain, session_id ORDER BY pos) AS from_item, item_id AS to_item, 'next' AS kind, 0 AS other_at, 0 AS way FROM p) WHERE from_item IS NOT NULL),
 pairs AS (SELECT from_item, to_item, kind, ts FROM raw QUALIFY row_number() OVER (PARTITION BY user_id, domain, session_id ORDER BY pos, kind DESC, other_at, way) <= 200),
 nsum AS (SELECT from_item, kind, to_item, {sql.round4('sum(' + sql.decay('1.0', f'{NOW} - ts', config.NEIGHBOR_HALF_LIFE) + ')')} AS n FROM pairs GROUP BY ALL),
 nrank AS (SELECT *, row_number() OVER (PARTITION BY from_item, kind ORDER BY n DESC, to_item) AS rank, max(n) OVER (PARTITION BY from_item, kind) AS most FROM nsum WHERE n >= 0.5),
 neighbors AS (SELECT from_item AS item_id, kind, CAST(rank AS INTEGER) AS rank, to_item AS neighbor_id, {sql.round4('n / most')} AS score FROM nrank WHERE rank <= {config.NEIGHBOR_TOP})"""

_EV = sql.cte(sql.EV)
_W = sql.cte(sql.EV, WEIGHTED_SQL)
QUERIES = {
    "item_stats": (item_stats, f"{_EV}, {ITEM_STATS_CTE} SELECT * FROM item_stats"),
    "signal_weights": (signal_weights, f"{_EV}, {_BROWSE} SELECT event_id, domain, event_type, browsing, {sql.round4(sql.weight('browsing'))} AS weight FROM b"),
    "event_classes": (event_classes, f"{_EV} SELECT domain, event_type, {sql.CLASS} AS kind, {_OUT} AS outcome, count(*) AS n FROM ev GROUP BY ALL"),
    "dedupe_events": (dedupe_events, f"{_EV} SELECT event_id, user_id, ts, received_ts FROM ev UNION ALL SELECT event_id, user_id, ts + {2 * DAY}, received_ts + 1000 FROM ev WHERE event_id % 20 = 0"),
    "late_events": (
        late_events,
        f"{_EV}, a AS (SELECT event_id, user_id, ts, ts + CASE WHEN event_id % 7 = 0 THEN {3 * DAY} ELSE 0 END AS received_ts FROM ev), b AS (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY received_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a) SELECT event_id, user_id, ts, received_ts FROM b WHERE ts < newest - {config.MAX_LATENESS}",
    ),
    "event_validation_errors": (event_validation_errors, VALIDATION_SQL),
    "trending_windows": (trending_windows, f"{_EV}, {TREND_CTE} SELECT * FROM counts"),
    "trending_top": (trending_lists, f"{_EV}, {TREND_CTE} SELECT * FROM trend WHERE rank <= 10"),
    "popular_fallback": (
        popular_fallback,
        f"{_EV}, {TREND_CTE}, {POPULAR_CTE} SELECT domain, region, item_id, CAST(place AS INTEGER) AS place FROM popular WHERE place <= 20",
    ),
    "affinity_creator": (affinity_creator, _affinity_sql("creator_id")),
    "affinity_genre": (affinity_genre, _affinity_sql("genre")),
    "recent_interactions": (
        recent_interactions,
        f"{_W} SELECT user_id, domain, CAST(row_number() OVER (PARTITION BY user_id, domain ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank, item_id, event_type, {sql.round4('weight')} AS weight, ts FROM w QUALIFY rank <= {config.RECENT_MAX}",
    ),
    "consumed_items": (consumed_items, f"{_EV}, {CONSUMED_CTE} SELECT * FROM consumed"),
    "liked_lru": (
        liked_lru,
        f"{_EV}, l AS (SELECT user_id, domain, item_id, max((ts, event_id)) AS pos FROM ev WHERE event_type IN ('LIKE', 'SAVE') GROUP BY ALL) SELECT user_id, domain, CAST(row_number() OVER (PARTITION BY user_id, domain ORDER BY pos DESC) AS INTEGER) AS place, item_id FROM l QUALIFY place <= {config.LIKED_MAX}",
    ),
    "session_genres": (
        session_genres,
        f"{_W}, {sql.ITEM} SELECT user_id, w.domain, session_id, genre, {sql.round4('sum(weight)')} AS weight FROM w JOIN item USING (item_id) WHERE weight > 0 AND genre IS NOT NULL GROUP BY ALL",
    ),
    "session_islands": (
        session_islands,
        f"{_EV}, a AS (SELECT *, coalesce((session_id <> lag(session_id) OVER o)::INT, 0) AS new FROM ev WINDOW o AS (PARTITION BY user_id, domain ORDER BY ts, event_id)), b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id, domain ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM a) SELECT user_id, domain, island, session_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM b GROUP BY ALL",
    ),
    "browsing_skips": (browsing_skips, f"{_EV}, {_BROWSE} SELECT event_id, user_id, session_id FROM b WHERE browsing"),
    "neighbors_cf": (_neighbors("co"), f"{_W}, {PAIRS_CTE} SELECT * FROM neighbors WHERE kind = 'co'"),
    "neighbors_next": (_neighbors("next"), f"{_W}, {PAIRS_CTE} SELECT * FROM neighbors WHERE kind = 'next'"),
}
