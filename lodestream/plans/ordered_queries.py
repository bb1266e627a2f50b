"""Queries that go through rows in order, the trained ranker, and vectors of texts and in bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import embedding
from ..functions.scalars import epoch_ms, round4
from ..operators import catalog, evaluation, lambdarank, ordered, ranking
from ..sources import views
from ..sources.shared import once
from . import catalog_queries, offline, sql

#: The driver's events are sparse: a day stands for a second, a bucket holds three.
PER_DAY, BURST = 1.0, 3
DIMENSION = 64


def profiles_as_of(spark, d):
    """Each event with the latest order that its user had placed by then; orders stand for changes of a profile."""
    orders = views.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), epoch_ms("o_orderdate").alias("updated"), F.col("o_orderkey").alias("profile"), F.col("o_orderstatus").alias("status"))
    e = views.events(spark, d).select("event_id", "user_id", "ts")
    moved = e.withColumn("ts", F.col("ts") - F.pmod("event_id", F.lit(9)) * (365 * config.DAY_MS))  # events are younger than all orders
    return ordered.as_of_join(moved, orders, ["user_id"], "ts", "updated", "profile", ["profile", "status"])


def rate_limited(spark, d):
    e = views.events(spark, d).select("event_id", "user_id", "ts")
    return ordered.token_bucket(e, "user_id", "ts", "event_id", PER_DAY / 86_400, BURST).where("not allowed").select("event_id", "user_id", "ts")


def lambdarank_ranker(spark, d):
    """NDCG@5 of later lists under the model of the earlier ones; the position is a feature, and is 0 when scoring."""
    names = [*(f"f_{f}" for f in config.FEATURES), "position"]
    rows = offline.ltr(spark, d).select("recommendation_id", "item_id", "served_ts", "label", *names)
    parts = once(evaluation.time_split(rows).select("recommendation_id", "item_id", "part", "label", *names))
    trees = lambdarank.fit(parts.where("part = 'train'"), "recommendation_id", "label", names, trees=5)
    scored = ranking.tree_scores(parts.where("part = 'valid'").withColumn("position", F.lit(0)), trees, names)
    m = evaluation.list_metrics(scored)
    return m.agg(F.count("*").alias("lists"), round4(F.avg("ndcg")).alias("ndcg"))


def hashed_embeddings(spark, d):
    """A vector for each item of the catalog, of the text that it is embedded by."""
    return catalog_queries.embedding_texts(spark, d).select("item_id", embedding.hashed_text(F.col("text"), DIMENSION).alias("vector"))


def half_vectors(spark, d):
    """What is left of each number of the vectors that are stored in 16 bits."""
    stored = views.items(spark, d).where("vector is not null").select("item_id", embedding.encoded(F.col("vector")).alias("code"))
    return stored.select("item_id", F.posexplode(embedding.decoded(F.col("code"))).alias("i", "x")).select("item_id", "i", F.col("x").cast("double").alias("x"))


_MOVED = "SELECT event_id, user_id, epoch_us(ts) // 1000 - (event_id % 9) * 31536000000 AS ts FROM events"
QUERIES = {
    "profiles_as_of": (
        profiles_as_of,
        f"WITH e AS ({_MOVED}), o AS (SELECT o_custkey AS user_id, epoch_us(o_orderdate) // 1000 AS updated, max(o_orderkey) AS profile, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY ALL) SELECT e.event_id, e.user_id, e.ts, o.profile, o.status FROM e ASOF LEFT JOIN o ON e.user_id = o.user_id AND e.ts >= o.updated",
    ),
    "rate_limited": (
        rate_limited,
        f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 b AS (SELECT event_id, user_id, ts, n, {float(BURST)}::DOUBLE - 1 AS left_, true AS allowed FROM e WHERE n = 1
   UNION ALL SELECT event_id, user_id, ts, n, CASE WHEN have >= 1 THEN have - 1 ELSE have END, have >= 1 FROM (SELECT e.event_id, e.user_id, e.ts, e.n, least({float(BURST)}::DOUBLE, b.left_ + (e.ts - b.ts) * ({PER_DAY!r}::DOUBLE / 86400 / 1000)) AS have FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1))
 SELECT event_id, user_id, ts FROM b WHERE NOT allowed""",
    ),
    "lambdarank_ranker": (lambdarank_ranker, None),
    "hashed_embeddings": (hashed_embeddings, None),
    "half_vectors": (
        half_vectors,
        f"{sql.cte(sql.ITEM)}, v AS (SELECT item_id, CAST(unnest(vector) AS DOUBLE) AS x, CAST(generate_subscripts(vector, 1) - 1 AS INTEGER) AS i FROM item), s AS (SELECT *, pow(2.0, greatest(floor(log2(abs(x))), -14) - 10) AS step FROM v) SELECT item_id, i, CASE WHEN x = 0 THEN 0.0 ELSE round_even(x / step, 0) * step END AS x FROM s",
    ),
}
