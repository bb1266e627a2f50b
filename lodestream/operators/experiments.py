"""A/B tests: assignment, counts a user, tests with users as clusters, sample ratio."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..sources.shared import once


@F.pandas_udf(T.DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc, na_action="ignore")


def murmur2(data: bytes, seed: int = 0x9747B28C) -> int:
    """The 32-bit MurmurHash2 of the log's partitioner."""
    m, mask = 0x5BD1E995, 0xFFFFFFFF
    h = (seed ^ len(data)) & mask
    whole = len(data) - len(data) % 4
    for k in np.frombuffer(data[:whole], "<u4").tolist():
        k = k * m & mask
        h = (h * m & mask) ^ ((k ^ k >> 24) * m & mask)
    if tail := data[whole:]:
        h = (h ^ int.from_bytes(tail, "little")) * m & mask
    h = (h ^ h >> 13) * m & mask
    return h ^ h >> 15


@F.pandas_udf(T.IntegerType())
def bucket(keys: pd.Series) -> pd.Series:
    """The bucket, 0 to 999, of a salted user id."""
    return keys.map(lambda k: (murmur2(k.encode()) & 0x7FFFFFFF) % 1000).astype("int32")


def assign(users: DataFrame, salt: str, ranges: list[tuple[str, int, int]]) -> DataFrame:
    """Adds `bucket` and `variant_id`: the variant whose range [from, to) holds the bucket, else the first."""
    with_bucket = users.withColumn("bucket", bucket(F.concat(F.lit(f"{salt}:"), F.col("user_id").cast("string"))))
    chain: Column | None = None
    for name, low, high in ranges:
        test = (F.col("bucket") >= low) & (F.col("bucket") < high)
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return with_bucket.withColumn("variant_id", chain.otherwise(ranges[0][0]))


def variant_pivot(attributed: DataFrame, by: list[str]) -> DataFrame:
    """A column an outcome: how many items of lists had it."""
    distinct = attributed.select(*dict.fromkeys(["recommendation_id", "item_id", "outcome", *by])).dropDuplicates(["recommendation_id", "item_id", "outcome"])
    return distinct.groupBy(*by).pivot("outcome", list(config.OUTCOMES[:6])).count().fillna(0)


def clustered_ratio(per_user: DataFrame, num: str, den: str, by: list[str]) -> DataFrame:
    """by, variant_id, users, ratio, variance: sum(num) / sum(den) with users as clusters (delta method)."""
    some = per_user.where(F.col(den) > 0)
    keys = [*by, "variant_id"]
    ratio = some.groupBy(*keys).agg((F.sum(num) / F.sum(den)).alias("ratio"), F.avg(den).alias("mean"), F.count("*").alias("users"))
    rest = some.join(ratio, keys).withColumn("off", F.col(num) - F.col("ratio") * F.col(den))
    return (
        rest.groupBy(*keys)
        .agg(F.first("users").alias("users"), F.first("ratio").alias("ratio"), (F.var_samp("off") / (F.first("users") * F.first("mean") * F.first("mean"))).alias("variance"))
        .where("users >= 2")
    )


def ratio_test(stats: DataFrame, by: list[str], control: str = "control", treatment: str = "treatment") -> DataFrame:
    """by, diff, z: treatment less control, over the standard error."""
    a = stats.where(F.col("variant_id") == control).select(*by, F.col("ratio").alias("r1"), F.col("variance").alias("v1"))
    b = stats.where(F.col("variant_id") == treatment).select(*by, F.col("ratio").alias("r2"), F.col("variance").alias("v2"))
    diff = F.col("r2") - F.col("r1")
    return a.join(b, by).select(*by, diff.alias("diff"), (diff / F.sqrt(F.greatest(F.col("v1") + F.col("v2"), F.lit(1e-18)))).alias("z"))


def proportion_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    p = (x1 + x2) / (n1 + n2)
    return (x2 / n2 - x1 / n1) / F.sqrt(F.greatest(p * (1 - p) * (1 / n1 + 1 / n2), F.lit(1e-12)))


def p_value(z: Column) -> Column:
    """Two-sided, of a normal statistic."""
    return erfc(F.abs(z) / math.sqrt(2))


def sample_ratio(counts: DataFrame, shares: dict[str, float], by: list[str]) -> DataFrame:
    """by, chi2, z: whether the variants' counts (variant_id, n) fit the split; z by Wilson and Hilferty."""
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("variant_id")]
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    expected = F.col("total") * share
    k = max(len(shares) - 1, 1)
    found = counts.join(total, by).groupBy(*by).agg(F.sum(F.pow(F.col("n") - expected, F.lit(2.0)) / expected).alias("chi2"))
    return found.withColumn("z", (F.pow(F.col("chi2") / k, F.lit(1.0 / 3)) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


#: The rates that a report tests, as (name, outcome counted, outcome it is a share of).
RATES = (("ctr", "PLAYED", "IMPRESSED"), ("completion", "COMPLETED", "PLAYED"), ("early_skip", "SKIPPED_EARLY", "PLAYED"))


def report(served: DataFrame, attributed: DataFrame, control: str, shares: dict[str, dict[str, float]], since: int | None = None) -> DataFrame:
    """A row for each domain and variant: users, lists, impressions, rates, each rate against the control, and the split.

    served: recommendation_id, user_id, domain, variant_id, served_ts; attributed: these, item_id and outcome. `since` leaves
    out earlier lists. Rates are null where nothing can be shared; `<rate>_diff`, `_low`, `_high` (95 %), `_p` are null for the
    control, and where a side has fewer than two users. srm_chi2 and srm_p compare the domain's users with `shares` (domain, variant,
    any positive numbers); null if the domain has no shares, or shows a variant without one. Rows without a domain or variant
    are left out; those without a user count as shown but stand in no test.
    """
    keys = ["domain", "variant_id"]
    some = [df.where("domain is not null and variant_id is not null") for df in (served, attributed)]
    shown, engaged = some if since is None else [df.where(F.col("served_ts") >= since) for df in some]
    lists = shown.groupBy(*keys).agg(F.countDistinct("user_id").alias("users"), F.countDistinct("recommendation_id").alias("lists"))
    per_user = once(variant_pivot(engaged, [*keys, "user_id"]))  # every rate asks for it twice
    counts = per_user.groupBy(*keys).agg(*(F.sum(o).alias(o) for o in config.OUTCOMES[:6]))
    stats = once(lists.join(counts, keys, "full").fillna(0))
    rate = lambda x, n: F.when(F.col(n) > 0, x / F.col(n))
    rates = [rate(F.col(num), den).alias(name) for name, num, den in RATES] + [rate(F.col("LIKED") + F.col("SAVED"), "IMPRESSED").alias("like")]
    out = stats.select(*keys, "users", "lists", F.col("IMPRESSED").alias("impressions"), *rates)
    for name, num, den in RATES:
        sides = once(clustered_ratio(per_user.where("user_id is not null"), num, den, ["domain"]))
        base = sides.where(F.col("variant_id") == control).select("domain", F.col("ratio").alias("_r"), F.col("variance").alias("_v"))
        other = sides.where(F.col("variant_id") != control).join(base, "domain")
        diff, error = F.col("ratio") - F.col("_r"), F.sqrt(F.greatest(F.col("variance") + F.col("_v"), F.lit(1e-18)))
        tested = other.select(*keys, diff.alias(f"{name}_diff"), (diff - 1.96 * error).alias(f"{name}_low"), (diff + 1.96 * error).alias(f"{name}_high"), p_value(diff / error).alias(f"{name}_p"))
        out = out.join(tested, keys, "left")
    return out.join(_split(stats.select(*keys, "users"), shares), "domain", "left")


def _split(stats: DataFrame, shares: dict[str, dict[str, float]]) -> DataFrame:
    """domain, srm_chi2, srm_p; a variant that nobody has counts with none."""
    spark = stats.sparkSession
    rows = [(d, v, s / sum(by.values()), len(by)) for d, by in shares.items() for v, s in by.items()]
    expected = F.broadcast(spark.createDataFrame(rows, "domain string, variant_id string, share double, variants int"))  # a row a configured variant
    total = stats.groupBy("domain").agg(F.sum("users").alias("total"))
    j = stats.join(expected.select("domain", "variant_id", "share"), ["domain", "variant_id"], "left")
    unknown = j.groupBy("domain").agg(F.max(F.col("share").isNull()).alias("unknown"))
    full = total.join(expected, "domain").join(stats, ["domain", "variant_id"], "left")
    wanted = F.col("total") * F.col("share")
    part = F.when(wanted > 0, F.pow(F.coalesce("users", F.lit(0)) - wanted, F.lit(2.0)) / wanted)
    chi2 = full.groupBy("domain").agg(F.sum(part).alias("srm_chi2"), F.greatest(F.max("variants") - 1, F.lit(1)).alias("_k"))
    fit = chi2.join(unknown.where("not unknown"), "domain")
    z = (F.pow(F.col("srm_chi2") / F.col("_k"), F.lit(1.0 / 3)) - (1 - 2 / (9 * F.col("_k")))) / F.sqrt(2 / (9 * F.col("_k")))
    return fit.select("domain", "srm_chi2", (0.5 * erfc(z / math.sqrt(2))).alias("srm_p"))
