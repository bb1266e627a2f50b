"""The engine's tables over the star schema's, as the queries use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.scalars import epoch_ms

# The mapping of the star schema's codes.
TYPES = {"view": "IMPRESSION", "click": "CLICK", "purchase": "PLAY_END", "signup": "SAVE", "error": "SKIP"}
COUNTRIES = ("US", "GB", "DE", "IN", "BR", "KR")
OUTCOMES = {("A", "F"): "COMPLETED", ("A", "O"): "PLAYED", ("N", "F"): "LIKED", ("N", "O"): "IMPRESSED", ("R", "F"): "SKIPPED_EARLY", ("R", "O"): "SAVED"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def country(user):
    return _pick(COUNTRIES, user % 6)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engagement events: one row each, with the item, domain, session and times in milliseconds."""
    e = table(spark, sf_dir, "events")
    item = F.get_json_object("props", "$.k").cast("long")
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[F.col("event_type")]
    return e.select(
        "event_id", "user_id", item.alias("item_id"), _pick(config.DOMAINS, item % 4).alias("domain"), kind.alias("event_type"), "value",
        epoch_ms("ts").alias("ts"), epoch_ms("ts").alias("received_ts"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session_id"),
        _pick(COUNTRIES, F.col("user_id") % 6).alias("country"), (F.col("event_id") % 2 == 0).alias("autoplay"),
        (F.lit(30000) * (1 + item % 5)).cast("long").alias("duration_ms"), F.lit(None).cast("long").alias("position_ms"),
        F.lit(None).cast("long").alias("seek_from_ms"), F.lit(None).cast("long").alias("seek_to_ms"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog: vector, genre, creator, release, with what `part` has of the item."""
    e, p = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "part")
    joined = e.join(p, e["vec_id"] == p["p_partkey"], "left")
    return joined.select(
        F.col("vec_id").alias("item_id"), _pick(config.DOMAINS, F.col("vec_id") % 4).alias("domain"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("genre"),
        F.col("p_brand").alias("creator_id"), F.col("p_type").alias("mood"), F.col("p_name").alias("title"), F.date_add(F.lit("2023-11-01").cast("date"), F.col("p_size")).alias("release_date"),
        F.coalesce(F.col("p_size") % 7 == 0, F.lit(False)).alias("explicit"), F.array(_pick(COUNTRIES, F.col("vec_id") % 6), F.lit("US")).alias("regions"),
    )


_LINE = ("l_linenumber", "l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line an order and part: the first by line number, supplier and ship date.

    Lines are dealt by order, as lists are: the join with orders, labels and all that is asked of a list find its rows in one
    task, and views of the same lines share one shuffle.
    """
    order = F.struct(*_LINE)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", *_LINE).repartition("l_orderkey")
    return lines.groupBy("l_orderkey", "l_partkey").agg(F.min(order).alias("x")).select("l_orderkey", "l_partkey", "x.*")


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served items, one a row, with the nine ranking features."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = _lines(spark, sf_dir).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    f = {
        "semantic": F.col("l_quantity") / 50, "cf": F.col("l_discount") * 10, "next": F.col("l_suppkey") % 5 / 5, "affinity": F.col("l_suppkey") % 7 / 7, "trending": F.col("l_suppkey") % 3 / 3,
        "ctr": F.col("l_tax"), "completion": F.col("l_suppkey") % 11 / 11, "freshness": F.col("l_suppkey") % 13 / 13, "penalty": F.col("l_suppkey") % 2 * 1.0,
    }
    return j.select(
        F.col("o_orderkey").alias("recommendation_id"), F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), (F.col("l_linenumber") - 1).alias("position"),
        F.when(F.expr("o_custkey div 4 % 2") == 0, "control").otherwise("treatment").alias("variant_id"), _pick(config.DOMAINS, F.col("o_custkey") % 4).alias("domain"),
        epoch_ms("o_orderdate").alias("served_ts"), F.col("l_discount").alias("score"), *[x.cast("double").alias(f"f_{n}") for n, x in f.items()],
    )


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of served items; each also has an impression."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = _lines(spark, sf_dir).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.create_map(*[F.lit(x) for (a, b), v in OUTCOMES.items() for x in (a + b, v)])[F.concat("l_returnflag", "l_linestatus")]
    base = j.select(
        F.col("o_orderkey").alias("recommendation_id"), F.col("l_partkey").alias("item_id"), F.col("o_custkey").alias("user_id"), (F.col("l_linenumber") - 1).alias("position"),
        F.when(F.expr("o_custkey div 4 % 2") == 0, "control").otherwise("treatment").alias("variant_id"), _pick(config.DOMAINS, F.col("o_custkey") % 4).alias("domain"),
        F.explode(F.array_distinct(F.array(kind, F.lit("IMPRESSED")))).alias("outcome"), epoch_ms("o_orderdate").alias("served_ts"), epoch_ms("l_shipdate").alias("outcome_ts"),
    )
    return base
