"""Queries over served lists and their outcomes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import config
from ..functions.scalars import round4
from ..operators import attribution, evaluation, experiments
from ..sources import views
from ..sources.shared import once
from . import sql

WEEK = 7 * config.DAY_MS
_GRADE = "CASE outcome " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in config.GRADES.items()) + " ELSE 0 END"
LTR = f"""lab AS (SELECT recommendation_id, item_id, max({_GRADE}) AS label FROM attributed GROUP BY ALL),
 ltr AS (SELECT served.*, label FROM served JOIN lab USING (recommendation_id, item_id) QUALIFY max(label) OVER (PARTITION BY recommendation_id) > 0 AND count(*) OVER (PARTITION BY recommendation_id) >= 2),
 rk AS (SELECT *, row_number() OVER (PARTITION BY recommendation_id ORDER BY score DESC, item_id) AS rank FROM ltr)"""
_BASE = f"WITH {sql.SERVED}, {sql.ATTRIBUTED}"
_LTR = f"{_BASE}, {LTR}"


def ltr(spark, d):
    return evaluation.ltr_dataset(views.served(spark, d), views.attributed(spark, d))


def ltr_dataset(spark, d):
    return ltr(spark, d).select("recommendation_id", "item_id", "position", "domain", "label", "served_ts", *[round4(F.col(f"f_{f}")).alias(f"f_{f}") for f in config.FEATURES])


def time_split(spark, d):
    rows = ltr(spark, d).select("recommendation_id", "domain", "served_ts")
    return evaluation.time_split(rows).groupBy("part", "domain").agg(F.countDistinct("recommendation_id").alias("lists"), F.count("*").alias("n"), F.min("served_ts").alias("first_ts"), F.max("served_ts").alias("last_ts"))


def ndcg_at_5(spark, d):
    m = evaluation.list_metrics(ltr(spark, d))
    return m.select("recommendation_id", *[round4(F.col(c)).alias(c) for c in ("ndcg", "precision1", "precision3", "recall3")])


_METRIC = """g AS (SELECT *, (pow(2.0::DOUBLE, label) - 1) * {w} AS gain FROM {t}),
 gi AS (SELECT *, row_number() OVER (PARTITION BY recommendation_id ORDER BY gain DESC, item_id) AS ideal FROM g),
 m AS (SELECT recommendation_id, sum(CASE WHEN rank <= 5 THEN gain / log2(rank + 1.0::DOUBLE) ELSE 0.0 END) AS dcg, sum(CASE WHEN ideal <= 5 THEN gain / log2(ideal + 1.0::DOUBLE) ELSE 0.0 END) AS best,
   count(*) FILTER (rank <= 1 AND label > 0) AS h1, count(*) FILTER (rank <= 3 AND label > 0) AS h3, count(*) FILTER (label > 0) AS relevant FROM gi GROUP BY ALL)"""


def position_propensity(spark, d):
    return evaluation.position_propensities(ltr(spark, d)).select("position", round4(F.col("propensity")).alias("propensity"))


_PROP = """pr AS (SELECT position, avg(CASE WHEN label > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate FROM ltr GROUP BY ALL),
 pt AS (SELECT coalesce(max(rate) FILTER (position = 0), max(rate)) AS top FROM pr),
 prop AS (SELECT position, greatest(least(rate / CASE WHEN top = 0 THEN 1.0 ELSE top END, 1.0::DOUBLE), 0.1::DOUBLE) AS propensity FROM pr, pt)"""


def ips_ndcg(spark, d):
    rows = once(ltr(spark, d).select("recommendation_id", "item_id", "position", "label", "score"))
    with_p = rows.join(F.broadcast(evaluation.position_propensities(rows)), "position")  # one row a position
    m = evaluation.list_metrics(with_p, weight=1 / F.col("propensity"))
    return m.select("recommendation_id", round4(F.col("ndcg")).alias("ips_ndcg"))


def auc_quality(spark, d):
    return evaluation.auc(ltr(spark, d), "f_semantic", by="domain").select("domain", round4(F.col("auc")).alias("auc"))


def coverage(spark, d):
    size = views.table(spark, d, "part").count()
    return evaluation.coverage(ltr(spark, d), size).select("items", round4(F.col("coverage")).alias("coverage"))


def intra_list_diversity(spark, d):
    creators = views.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("creator_id"))
    return evaluation.intra_list_diversity(ltr(spark, d), creators).select(round4(F.col("diversity")).alias("diversity"))


def novelty(spark, d):
    popular = views.served(spark, d).groupBy("item_id").agg(F.count("*").alias("n"))
    return evaluation.novelty(ltr(spark, d), popular).select(round4(F.col("novelty")).alias("novelty"))


def offline_report(spark, d):
    rows = ltr(spark, d)
    m = evaluation.list_metrics(rows).join(rows.groupBy("recommendation_id").agg(F.first("domain").alias("domain")), "recommendation_id")
    return m.groupBy("domain").agg(*[round4(F.avg(c)).alias(c) for c in ("ndcg", "precision1", "precision3", "recall3")], F.count("*").alias("lists"))


def ab_variant_pivot(spark, d):
    return experiments.variant_pivot(views.attributed(spark, d), ["domain", "variant_id"])


def _per_user(spark, d):
    return experiments.variant_pivot(views.attributed(spark, d), ["domain", "variant_id", "user_id"])


def ab_clustered_ratio(spark, d):
    stats = experiments.clustered_ratio(_per_user(spark, d), "COMPLETED", "IMPRESSED", ["domain"])
    return experiments.ratio_test(stats, ["domain"]).select("domain", F.round("diff", 8).alias("diff"), round4(F.col("z")).alias("z"))


_PIVOT = "SELECT {by}, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS \"{o}\"" for o in config.OUTCOMES[:6]) + " FROM (SELECT DISTINCT recommendation_id, item_id, outcome, domain, variant_id, user_id FROM attributed) GROUP BY ALL"
_RATIO = f"""u AS ({_PIVOT.format(by='domain, variant_id, user_id')}), r AS (SELECT domain, variant_id, sum("COMPLETED") / sum("IMPRESSED") AS ratio, avg("IMPRESSED") AS mean, count(*) AS users FROM u WHERE "IMPRESSED" > 0 GROUP BY ALL),
 v AS (SELECT domain, variant_id, any_value(ratio) AS ratio, var_samp("COMPLETED" - ratio * "IMPRESSED") / (any_value(users) * any_value(mean) * any_value(mean)) AS variance FROM u JOIN r USING (domain, variant_id) WHERE "IMPRESSED" > 0 GROUP BY ALL)"""


def ab_two_proportion_z(spark, d):
    p = ab_variant_pivot(spark, d)
    side = lambda v, n: p.where(F.col("variant_id") == v).select("domain", F.col("COMPLETED").alias(f"x{n}"), F.col("IMPRESSED").alias(f"n{n}"))
    j = side("control", 1).join(side("treatment", 2), "domain")
    return j.select("domain", round4(experiments.proportion_z(F.col("x1"), F.col("n1"), F.col("x2"), F.col("n2"))).alias("z"))


def ab_p_values(spark, d):
    return ab_two_proportion_z(spark, d).withColumn("p_value", experiments.p_value(F.col("z")))


def srm_chi2(spark, d):
    counts = views.served(spark, d).groupBy("domain", "variant_id").agg(F.countDistinct("user_id").alias("n"))
    return experiments.sample_ratio(counts, {"control": 0.5, "treatment": 0.5}, ["domain"]).select("domain", round4(F.col("chi2")).alias("chi2"), round4(F.col("z")).alias("z"))


def bucket_assignment(spark, d):
    users = views.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return experiments.assign(users, "song-ranker", [("control", 0, 500), ("treatment", 500, 1000)])


def served_exploded(spark, d):
    item = F.struct("item_id", "position")
    lists = views.served(spark, d).groupBy("recommendation_id", "user_id", "domain", "variant_id", "served_ts").agg(F.collect_list(item).alias("items"))
    return attribution.explode_served(lists)


def attribution_interval(spark, d):
    e = views.events(spark, d)
    shown = e.where("event_type = 'IMPRESSION'").select(F.concat_ws("-", "user_id", "item_id").alias("recommendation_id"), "item_id", F.col("ts").alias("served_ts"), F.col("event_id").alias("served_id"))
    engaged = e.where("event_type != 'IMPRESSION'").withColumn("recommendation_id", F.concat_ws("-", "user_id", "item_id"))
    return attribution.attribute(shown, engaged, WEEK).select("served_id", "recommendation_id", "item_id", "outcome", "served_ts", "outcome_ts")


def online_rates(spark, d):
    return attribution.outcome_rates(views.attributed(spark, d))


def _outcome_sql():
    from .activity import _OUT

    return _OUT


QUERIES = {
    "ltr_dataset": (ltr_dataset, f"{_LTR} SELECT recommendation_id, item_id, position, domain, label, served_ts, " + ", ".join(f"{sql.round4(f'f_{f}')} AS f_{f}" for f in config.FEATURES) + " FROM ltr"),
    "time_split": (
        time_split,
        f"{_LTR}, ls AS (SELECT recommendation_id, min(served_ts) AS t FROM ltr GROUP BY ALL), lr AS (SELECT recommendation_id, CASE WHEN row_number() OVER (ORDER BY t, recommendation_id) <= floor(count(*) OVER () * 0.8::DOUBLE + 1e-9) THEN 'train' ELSE 'valid' END AS part FROM ls) SELECT part, domain, count(DISTINCT recommendation_id) AS lists, count(*) AS n, min(served_ts) AS first_ts, max(served_ts) AS last_ts FROM ltr JOIN lr USING (recommendation_id) GROUP BY ALL",
    ),
    "ndcg_at_5": (
        ndcg_at_5,
        f"{_LTR}, {_METRIC.format(w='1.0::DOUBLE', t='rk')} SELECT recommendation_id, {sql.round4('CASE WHEN best = 0 THEN 0.0 ELSE dcg / best END')} AS ndcg, {sql.round4('h1 / 1.0::DOUBLE')} AS precision1, {sql.round4('h3 / 3.0::DOUBLE')} AS precision3, {sql.round4('CASE WHEN relevant = 0 THEN 0.0 ELSE h3 / relevant::DOUBLE END')} AS recall3 FROM m",
    ),
    "position_propensity": (position_propensity, f"{_LTR}, {_PROP} SELECT position, {sql.round4('propensity')} AS propensity FROM prop"),
    "ips_ndcg": (ips_ndcg, f"{_LTR}, {_PROP}, rp AS (SELECT rk.*, propensity FROM rk JOIN prop USING (position)), {_METRIC.format(w='(1 / propensity)', t='rp')} SELECT recommendation_id, {sql.round4('CASE WHEN best = 0 THEN 0.0 ELSE dcg / best END')} AS ips_ndcg FROM m"),
    "auc_quality": (
        auc_quality,
        f"{_LTR}, ar AS (SELECT domain, label, rank() OVER (PARTITION BY domain ORDER BY f_semantic) + (count(*) OVER (PARTITION BY domain, f_semantic) - 1) / 2.0::DOUBLE AS r FROM ltr), s AS (SELECT domain, sum(r) FILTER (label > 0) AS r, count(*) FILTER (label > 0) AS p, count(*) FILTER (label <= 0) AS q FROM ar GROUP BY ALL) SELECT domain, {sql.round4('CASE WHEN p = 0 OR q = 0 THEN 0.5 ELSE (r - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * q) END')} AS auc FROM s",
    ),
    "coverage": (coverage, f"{_LTR} SELECT count(DISTINCT item_id) AS items, {sql.round4('count(DISTINCT item_id) / (SELECT count(*) FROM part)::DOUBLE')} AS coverage FROM rk WHERE rank <= 3"),
    "intra_list_diversity": (
        intra_list_diversity,
        f"{_LTR}, t AS (SELECT recommendation_id, rank, p_brand AS c FROM rk LEFT JOIN part ON item_id = p_partkey WHERE rank <= 3), p AS (SELECT a.recommendation_id, avg(CASE WHEN a.c <> b.c OR a.c IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v FROM t a JOIN t b ON a.recommendation_id = b.recommendation_id AND a.rank < b.rank GROUP BY ALL) SELECT {sql.round4('avg(v)')} AS diversity FROM p",
    ),
    "novelty": (
        novelty,
        f"{_LTR}, pop AS (SELECT item_id, count(*) AS n FROM served GROUP BY ALL) SELECT {sql.round4('avg(-log2(greatest(coalesce(n::DOUBLE, 0.5), 0.5::DOUBLE) / (SELECT sum(n) FROM pop)::DOUBLE))')} AS novelty FROM rk LEFT JOIN pop USING (item_id) WHERE rank <= 3",
    ),
    "offline_report": (
        offline_report,
        f"{_LTR}, {_METRIC.format(w='1.0::DOUBLE', t='rk')}, dm AS (SELECT recommendation_id, any_value(domain) AS domain FROM ltr GROUP BY ALL) SELECT domain, {sql.round4('avg(CASE WHEN best = 0 THEN 0.0 ELSE dcg / best END)')} AS ndcg, {sql.round4('avg(h1 / 1.0::DOUBLE)')} AS precision1, {sql.round4('avg(h3 / 3.0::DOUBLE)')} AS precision3, {sql.round4('avg(CASE WHEN relevant = 0 THEN 0.0 ELSE h3 / relevant::DOUBLE END)')} AS recall3, count(*) AS lists FROM m JOIN dm USING (recommendation_id) GROUP BY ALL",
    ),
    "ab_variant_pivot": (ab_variant_pivot, f"{_BASE} {_PIVOT.format(by='domain, variant_id')}"),
    "ab_clustered_ratio": (
        ab_clustered_ratio,
        f"{_BASE}, {_RATIO} SELECT domain, round(b.ratio - a.ratio, 8) AS diff, {sql.round4('(b.ratio - a.ratio) / sqrt(greatest(a.variance + b.variance, 1e-18))')} AS z FROM v a JOIN v b USING (domain) WHERE a.variant_id = 'control' AND b.variant_id = 'treatment'",
    ),
    "ab_two_proportion_z": (
        ab_two_proportion_z,
        f"{_BASE}, p AS ({_PIVOT.format(by='domain, variant_id')}), j AS (SELECT domain, a.\"COMPLETED\"::DOUBLE AS x1, a.\"IMPRESSED\"::DOUBLE AS n1, b.\"COMPLETED\"::DOUBLE AS x2, b.\"IMPRESSED\"::DOUBLE AS n2 FROM p a JOIN p b USING (domain) WHERE a.variant_id = 'control' AND b.variant_id = 'treatment'), q AS (SELECT *, (x1 + x2) / (n1 + n2) AS pp FROM j) SELECT domain, {sql.round4('(x2 / n2 - x1 / n1) / sqrt(greatest(pp * (1 - pp) * (1 / n1 + 1 / n2), 1e-12))')} AS z FROM q",
    ),
    "ab_p_values": (ab_p_values, None),
    "srm_chi2": (
        srm_chi2,
        f"{_BASE}, c AS (SELECT domain, variant_id, count(DISTINCT user_id) AS n FROM served GROUP BY ALL), t AS (SELECT domain, sum(n)::DOUBLE AS total FROM c GROUP BY ALL), x AS (SELECT domain, sum(pow(n - total * 0.5, 2.0::DOUBLE) / (total * 0.5)) AS chi2 FROM c JOIN t USING (domain) GROUP BY ALL) SELECT domain, {sql.round4('chi2')} AS chi2, {sql.round4(f'(pow(chi2, {1.0 / 3!r}::DOUBLE) - {1 - 2 / 9!r}::DOUBLE) / {math.sqrt(2 / 9)!r}::DOUBLE')} AS z FROM x",
    ),
    "bucket_assignment": (bucket_assignment, None),
    "served_exploded": (served_exploded, f"{_BASE} SELECT recommendation_id, user_id, domain, variant_id, served_ts, item_id, position FROM served"),
    "attribution_interval": (
        attribution_interval,
        f"{sql.cte(sql.EV)}, o AS (SELECT *, {_outcome_sql()} AS outcome FROM ev WHERE event_type <> 'IMPRESSION') SELECT s.event_id AS served_id, s.user_id::VARCHAR || '-' || s.item_id::VARCHAR AS recommendation_id, s.item_id, o.outcome, s.ts AS served_ts, o.ts AS outcome_ts FROM ev s JOIN o ON s.user_id = o.user_id AND s.item_id = o.item_id AND s.event_type = 'IMPRESSION' AND o.outcome IS NOT NULL AND o.ts BETWEEN s.ts - {WEEK} AND s.ts + {WEEK}",
    ),
    "online_rates": (online_rates, f"{_BASE} SELECT domain, variant_id, outcome, count(*) AS n FROM attributed GROUP BY ALL"),
}
