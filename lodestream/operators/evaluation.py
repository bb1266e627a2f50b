"""Offline evaluation of rankings: labels, splits, and metrics of lists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..sources.shared import once
from .monitoring import running

LIST = "recommendation_id"


def labels(attributed: DataFrame) -> DataFrame:
    """recommendation_id, item_id, label: the best grade among an item's outcomes."""
    grade = F.create_map(*[F.lit(x) for pair in config.GRADES.items() for x in pair])[F.col("outcome")]
    return attributed.groupBy(LIST, "item_id").agg(F.max(F.coalesce(grade, F.lit(0))).alias("label"))


def ltr_dataset(served: DataFrame, attributed: DataFrame, visible: int = 5) -> DataFrame:
    """Served items that were seen, with their label; lists without a positive or of one item go.

    If any impression was logged, what has an outcome was seen; otherwise the first `visible` places were.
    """
    # asked for in the same query, which reads and deals the outcomes once
    logged = attributed.agg(F.coalesce(F.max(F.col("outcome") == "IMPRESSED"), F.lit(False)).alias("_logged"))
    # a list's labels as one map: the join is by list alone, by which both sides may be dealt already
    known = labels(attributed).where(F.col("item_id").isNotNull()).groupBy(LIST).agg(F.map_from_entries(F.collect_list(F.struct("item_id", "label"))).alias("_labels"))
    joined = served.join(known, LIST, "left").withColumn("label", F.col("_labels")[F.col("item_id")]).drop("_labels").crossJoin(F.broadcast(logged))  # one row
    seen = joined.where(F.when(F.col("_logged"), F.col("label").isNotNull()).otherwise(F.col("position") < visible)).drop("_logged")
    by = Window.partitionBy(LIST)
    seen = seen.withColumn("label", F.coalesce("label", F.lit(0)))
    marked = seen.withColumn("_best", F.max("label").over(by)).withColumn("_n", F.count("*").over(by))
    return marked.where("_best > 0 and _n >= 2").drop("_best", "_n")


def time_split(rows: DataFrame, train: float = 0.8) -> DataFrame:
    """Adds `part`: the earliest lists are `train`, the rest `valid`; no list is in both.

    The cut is the smallest time by which that share of the lists was served, found from counts a time, and by
    list id within it.
    """
    rows = once(rows)
    lists = rows.groupBy(LIST).agg(F.min("served_ts").alias("at"))
    counts = lists.groupBy("at").agg(F.count("*").alias("n"))
    # counts of distinct times: a running sum over them gives each time's first place
    total = lists.count()
    placed = running(counts, [], "at", "n", "before").select("at", "before", F.lit(math.floor(total * train + 1e-9)).alias("cut"))
    within = F.row_number().over(Window.partitionBy("at").orderBy(LIST))
    parts = lists.join(placed, "at").select(LIST, F.when(F.col("before") + within <= F.col("cut"), "train").otherwise("valid").alias("part"))
    return rows.join(parts, LIST)


def ranked(rows: DataFrame, score: str = "score") -> DataFrame:
    """Adds `rank` from 1 within each list: by score, then item."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(LIST).orderBy(F.col(score).desc(), "item_id")))


def list_metrics(rows: DataFrame, k: int = 5, score: str = "score", weight: Column | None = None) -> DataFrame:
    """recommendation_id, ndcg, precision1, precision3, recall3 of each list; `weight` multiplies gains."""
    w = F.lit(1.0) if weight is None else weight
    gain = (F.pow(F.lit(2.0), F.col("label")) - 1) * w
    with_gain = ranked(rows, score).withColumn("gain", gain)
    ideal = F.row_number().over(Window.partitionBy(LIST).orderBy(F.col("gain").desc(), "item_id"))
    with_gain = with_gain.withColumn("ideal", ideal)
    at = lambda place: F.sum(F.when(F.col(place) <= k, F.col("gain") / F.log2(F.col(place) + 1.0)).otherwise(0.0))
    hits = lambda n: F.sum(((F.col("rank") <= n) & (F.col("label") > 0)).cast("int"))
    sums = with_gain.groupBy(LIST).agg(at("rank").alias("dcg"), at("ideal").alias("best"), hits(1).alias("h1"), hits(3).alias("h3"), F.sum((F.col("label") > 0).cast("int")).alias("relevant"))
    return sums.select(
        LIST, F.when(F.col("best") == 0, 0.0).otherwise(F.col("dcg") / F.col("best")).alias("ndcg"), (F.col("h1") / 1.0).alias("precision1"), (F.col("h3") / 3.0).alias("precision3"),
        F.when(F.col("relevant") == 0, 0.0).otherwise(F.col("h3") / F.col("relevant")).alias("recall3"),
    )


def position_propensities(rows: DataFrame, most: float = 10.0) -> DataFrame:
    """position, propensity: the share of positives relative to the first place's, within [1 / most, 1]."""
    rates = rows.groupBy("position").agg(F.avg((F.col("label") > 0).cast("double")).alias("rate"))
    first = F.coalesce(F.max(F.when(F.col("position") == 0, F.col("rate"))).over(Window.partitionBy()), F.max("rate").over(Window.partitionBy()))
    top = F.when(first == 0, 1.0).otherwise(first)
    return rates.select("position", F.greatest(F.least(F.col("rate") / top, F.lit(1.0)), F.lit(1.0 / most)).alias("propensity"))


def auc(rows: DataFrame, score: str = "score", by: str | None = None) -> DataFrame:
    """auc of `label > 0` against the score, ties by average rank; 0.5 without both classes.

    Works on counts of equal scores in ranges, so no task orders them all.
    """
    keys = [by] if by else []
    counts = rows.groupBy(*keys, F.col(score).alias("s")).agg(F.sum((F.col("label") > 0).cast("long")).alias("pos"), F.count("*").alias("n"))
    placed = running(counts, keys, "s", "n", "before")
    sums = placed.withColumn("rank", F.col("before") + (F.col("n") + 1) / 2.0).groupBy(*keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return sums.select(*keys, F.when((F.col("p") == 0) | (F.col("q") == 0), 0.5).otherwise((F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p").cast("double") * F.col("q"))).alias("auc"))


def coverage(rows: DataFrame, catalog_size: int, k: int = 3) -> DataFrame:
    """items, coverage: the share of the catalog that the lists' first k places show."""
    shown = ranked(rows).where(F.col("rank") <= k).agg(F.countDistinct("item_id").alias("items"))
    return shown.withColumn("coverage", F.col("items") / float(catalog_size) if catalog_size else F.lit(0.0))


def intra_list_diversity(rows: DataFrame, creators: DataFrame, k: int = 3) -> DataFrame:
    """diversity: the mean share of a list's pairs by different creators; an unknown creator differs from all.

    A list's equal pairs follow from its counts by creator: no pairs are made.
    """
    top = ranked(rows).where(F.col("rank") <= k).join(creators, "item_id", "left")
    same = top.groupBy(LIST, "creator_id").agg(F.count("*").alias("n")).withColumn("same", F.when(F.col("creator_id").isNull(), 0).otherwise(F.col("n") * (F.col("n") - 1) / 2))
    lists = same.groupBy(LIST).agg(F.sum("n").alias("n"), F.sum("same").alias("same")).where("n >= 2")
    return lists.agg(F.avg(1 - F.col("same") / (F.col("n") * (F.col("n") - 1) / 2)).alias("diversity"))


def novelty(rows: DataFrame, popularity: DataFrame, k: int = 3) -> DataFrame:
    """novelty: the mean of -log2 of the shown items' share of all popularity, at least 0.5 each."""
    top = ranked(rows).where(F.col("rank") <= k).join(popularity, "item_id", "left")
    total = popularity.agg(F.sum("n").alias("total"))
    p = F.greatest(F.coalesce(F.col("n").cast("double"), F.lit(0.5)), F.lit(0.5))
    return top.crossJoin(F.broadcast(total)).agg(F.avg(-F.log2(p / F.col("total"))).alias("novelty"))
