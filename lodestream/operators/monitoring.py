"""Running counts over sorted values, percentiles, costs of tokens, and the gate of a new model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import round4
from ..sources.shared import once

# Shares of the monthly budget at which a warning is due.
THRESHOLDS = (0.5, 0.8, 1.0)


def running(counts: DataFrame, keys: list[str], order: str, n: str, name: str) -> DataFrame:
    """Adds `name`: the sum of `n` over the rows before, by `order`, within the keys.

    Rows are dealt by ranges of keys and order; a range adds up its own rows, and what the ranges before it sum up to
    comes from one row a range. No task holds all rows of a key. Rows of equal order stand in any order.
    """
    ranged = once(counts.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()))
    each = ranged.groupBy(*keys, "_range").agg(F.sum(n).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_at"), before.alias("_before"))
    same = F.col("_range") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = F.coalesce(F.sum(n).over(Window.partitionBy("_range", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = ranged.withColumn("_inside", inside).join(each, same)
    return joined.withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_at", "_before", "_inside", *[f"_k{i}" for i in range(len(keys))])


def percentiles(rows: DataFrame, value: str, shares: tuple[float, ...], keys: list[str] | None = None) -> DataFrame:
    """keys, share, value: the value at place floor(share * n), from 0, of the sorted values; the last if that is beyond.

    Nulls take no part; a key without values gives no row.
    """
    keys = keys or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    placed = running(counts, keys, "value", "n", "before")
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    if keys:
        for i, k in enumerate(keys):
            total = total.withColumnRenamed(k, f"_t{i}")
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_t{i}"))
        placed = placed.join(total, same)
    else:
        placed = placed.withColumn("total", F.lit(total.first()[0]).cast("long"))
    at = F.least(F.floor(F.col("share") * F.col("total")), F.col("total") - 1)
    picked = placed.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).where((F.col("before") <= at) & (at < F.col("before") + F.col("n")))
    return picked.select(*keys, "share", "value")


def token_costs(calls: DataFrame, prices: dict[str, float]) -> DataFrame:
    """model, job, tokens, usd: calls (model, job, input_tokens, output_tokens) by model, output of chats as a model of
    its own, `<model>:output`. A model without a price costs nothing; calls without output have none there."""
    price = F.create_map(*[F.lit(x) for pair in prices.items() for x in pair]) if prices else F.create_map().cast("map<string,double>")
    kinds = F.array(F.struct(F.col("model").alias("model"), F.col("input_tokens").alias("tokens")), F.struct(F.concat("model", F.lit(":output")).alias("model"), F.col("output_tokens").alias("tokens")))
    rows = calls.select("job", F.explode(kinds).alias("x")).where("x.tokens is not null")
    sums = rows.groupBy(F.col("x.model").alias("model"), "job").agg(F.sum("x.tokens").alias("tokens"))
    return sums.withColumn("usd", F.col("tokens") / 1e6 * F.coalesce(price[F.col("model")], F.lit(0.0)))


def spend_warnings(spend: DataFrame, budget: float) -> DataFrame:
    """month, threshold, at: when the month's running spend (month, ts, usd) reached each share of the budget.

    Equal times are one step; a share that is not reached has no row.
    """
    steps = spend.groupBy("month", "ts").agg(F.sum("usd").alias("usd"))
    total = running(steps, ["month"], "ts", "usd", "before").withColumn("sum", F.col("before") + F.col("usd"))
    hit = total.withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS)))).where(round4(F.col("sum")) >= F.col("threshold") * budget)
    return hit.groupBy("month", "threshold").agg(F.min("ts").alias("at"))


def gate(model: DataFrame, baseline: DataFrame, least_gain: float, least_groups: int, least_engaged: int = 100) -> DataFrame:
    """candidate, promoted: whether a new model may be tried, and whether it takes over.

    model and baseline: one row with groups, engaged_rows, ips_ndcg, quality_auc. Both need enough groups (at most 50 are
    asked for); a candidate needs enough engaged rows and no worse quality, a promotion the gain in ips_ndcg.
    """
    b = baseline.select(F.col("ips_ndcg").alias("_ndcg"), F.col("quality_auc").alias("_auc"))
    j = model.join(F.broadcast(b))  # one row each
    enough: Column = F.col("groups") >= min(least_groups, 50)
    candidate = enough & (F.col("engaged_rows") >= least_engaged) & (F.col("quality_auc") - F.col("_auc") >= 0)
    return j.select(candidate.alias("candidate"), (enough & (F.col("ips_ndcg") - F.col("_ndcg") >= least_gain)).alias("promoted"))
