"""Queries over logs and the views they rebuild, versions of index and model, and the report of a test."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import embedding, texts
from ..functions.scalars import round4
from ..operators import catalog, experiments, ranking
from ..sources import shared, views
from ..sources.indexes import VectorIndexes
from ..sources.models import Models
from ..streaming import changelog
from . import catalog_queries, offline, ordered_queries, serving, sql

#: Users of both variants are to be as many.
SHARES = {d: {"control": 1.0, "treatment": 1.0} for d in config.DOMAINS}


def rebuilt_view(spark, d):
    """Orders as changes of a user's row, in three batches: the view is lost after two, and rebuilt; a fourth comes too late."""
    orders = views.table(spark, d, "orders").select(
        F.col("o_custkey").alias("user_id"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("seq"), F.col("o_orderkey").alias("order_id"), (F.col("o_orderstatus") == "P").alias("deleted")
    )
    root = shared.folder(spark)
    log = changelog.Changelog(spark, f"{root}/log", "user_id long, seq long, order_id long, deleted boolean")
    part = lambda n: orders.where(F.col("order_id") % 4 == n)
    for n in range(2):
        log.append(part(n))
        changelog.follow(log, f"{root}/lost", "user_id")
    log.append(part(2))
    changelog.follow(log, f"{root}/view", "user_id")
    log.append(part(3))
    return changelog.live(log, f"{root}/view").select("user_id", "seq", "order_id")


def index_backfill(spark, d):
    """The index after a backfill that failed for some items, a switch that was refused, a second backfill and a switch."""
    text = shared.once(catalog_queries.embedding_texts(spark, d).select("item_id", "text"))
    items = text.withColumn("hash", texts.content_hash(F.lit("v2"), F.lit("words"), F.lit(ordered_queries.DIMENSION), F.col("text")))
    index = VectorIndexes(spark, shared.folder(spark))
    embed = lambda rows: rows.withColumn("vector", embedding.hashed_text(F.col("text"), ordered_queries.DIMENSION))
    broken = lambda rows: embed(rows).withColumn("vector", F.when(F.col("item_id").cast("long") % 20 != 0, F.col("vector")))
    index.backfill("words-2", items, broken)
    early = index.switch("serving", "words-2", items)
    index.backfill("words-2", items, embed)
    index.switch("serving", "words-2", items)
    return index.read("serving").select("item_id", "hash", "run", F.lit(early).alias("early"))


def registry_scores(spark, d):
    """Served items under the model of their domain and variant: songs have a candidate, books a current model only, the
    candidate of videos was trained on other features, posts have none."""
    names, trees = serving._trees()
    dump = ranking.dump_trees(trees, names)
    few = dump | {"tree_info": dump["tree_info"][:3]}
    models = Models(spark, shared.folder(spark))
    models.publish("song", "v1", dump, names, {}, candidate=False, promoted=True)
    models.publish("song", "v2", few, names, {}, candidate=True, promoted=False)
    models.publish("book", "v1", few, names, {}, candidate=False, promoted=True)
    models.publish("video", "v1", dump, names[:3], {}, candidate=True, promoted=False)
    rankers = {"control": "model", "treatment": "model:candidate"}
    chosen = {(domain, variant): models.choose(domain, ranker, names) for domain in config.DOMAINS for variant, ranker in rankers.items()}
    model = F.lit(None).cast("string")
    for (domain, variant), found in chosen.items():
        model = F.when((F.col("domain") == domain) & (F.col("variant_id") == variant), found and found[0]).otherwise(model)
    rows = views.served(spark, d).withColumn("model", model)
    scored = ranking.scores_by_model(rows, dict(filter(None, chosen.values())), F.col("model"), names, ranking.heuristic_score())
    return scored.select("recommendation_id", "item_id", "model", round4(F.col("score")).alias("score"))


def ab_report(spark, d):
    out = experiments.report(views.served(spark, d), views.attributed(spark, d), "control", SHARES)
    rates = ["ctr", "completion", "early_skip", "like"]
    tests = [f"{name}_{x}" for name, _, _ in experiments.RATES for x in ("diff", "low", "high")]
    return out.select("domain", "variant_id", "users", "lists", "impressions", *[round4(F.col(c)).alias(c) for c in [*rates, *tests, "srm_chi2"]])


def explanation_plan(spark, d):
    shown = views.served(spark, d).select("recommendation_id", "position", "item_id", "domain", F.when(F.col("position") == 0, "POPULAR_FALLBACK").otherwise("TRENDING").alias("reason"), F.lit(None).cast("string").alias("seed"))
    key = texts.explanation_key(F.col("domain"), F.lit("TRENDING"), F.lit(None), F.col("item_id"))
    existing = shown.where("item_id % 3 = 0").select(key.alias("key"))
    known = views.table(spark, d, "part").where("p_partkey % 5 != 0").select(F.col("p_partkey").alias("item_id"))
    return catalog.explanation_plan(shown, existing, known, percent=10, top=3).select("key", "domain", "reason", "item_id")


_W = config.RANK_WEIGHTS
_PLAIN = " + ".join(f"({w!r}::DOUBLE) * ({'0.5 * f_trending + 0.5 * least(1.0::DOUBLE, f_ctr / 0.3)' if n == 'popular' else f'f_{n}'})" for n, w in _W.items())
_FEW = " + ".join(serving._GBDT.split(" + ")[:3])
_CHANGES = "SELECT o_custkey AS user_id, CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) AS seq, o_orderkey AS order_id, o_orderstatus = 'P' AS deleted, o_orderkey % 4 AS part FROM orders"
_SIDES = ", ".join(
    f"""{n}_r AS (SELECT domain, variant_id, sum("{num}") / sum("{den}") AS ratio, avg("{den}") AS mean, count(*) AS users FROM u WHERE "{den}" > 0 GROUP BY ALL),
 {n}_v AS (SELECT domain, variant_id, any_value(ratio) AS ratio, var_samp("{num}" - ratio * "{den}") / (any_value(users) * any_value(mean) * any_value(mean)) AS variance FROM u JOIN {n}_r USING (domain, variant_id) WHERE "{den}" > 0 GROUP BY ALL HAVING any_value(users) >= 2),
 {n} AS (SELECT domain, b.variant_id, b.ratio - a.ratio AS diff, 1.96 * sqrt(greatest(a.variance + b.variance, 1e-18)) AS half FROM {n}_v a JOIN {n}_v b USING (domain) WHERE a.variant_id = 'control' AND b.variant_id <> 'control')"""
    for n, num, den in experiments.RATES
)
_TESTED = ", ".join(f"{sql.round4(f'{n}.diff')} AS {n}_diff, {sql.round4(f'{n}.diff - {n}.half')} AS {n}_low, {sql.round4(f'{n}.diff + {n}.half')} AS {n}_high" for n, _, _ in experiments.RATES)
_SHARE = lambda x, n: sql.round4(f"CASE WHEN {n} > 0 THEN {x} / {n}::DOUBLE END")
QUERIES = {
    "rebuilt_view": (rebuilt_view, f"WITH c AS ({_CHANGES}), n AS (SELECT * FROM c WHERE part < 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC, part, order_id DESC) = 1) SELECT user_id, seq, order_id FROM n WHERE NOT deleted"),
    "index_backfill": (
        index_backfill,
        f"WITH {catalog_queries._TEXTS} SELECT item_id, sha256(concat_ws('|', 'v2', 'words', {ordered_queries.DIMENSION}, text)) AS hash, CAST(CASE WHEN CAST(item_id AS BIGINT) % 20 = 0 THEN 1 ELSE 0 END AS INTEGER) AS run, false AS early FROM et",
    ),
    "registry_scores": (
        registry_scores,
        f"WITH {sql.SERVED}, m AS (SELECT *, CASE WHEN domain = 'song' THEN CASE variant_id WHEN 'control' THEN 'song/v1' ELSE 'song/v2' END WHEN domain = 'book' THEN 'book/v1' END AS model FROM served) SELECT recommendation_id, item_id, model, {sql.round4(f'''CASE WHEN model = 'song/v1' THEN {serving._GBDT} WHEN model IS NOT NULL THEN {_FEW} ELSE {_PLAIN} END''')} AS score FROM m",
    ),
    "ab_report": (
        ab_report,
        f"""{offline._BASE}, u AS ({offline._PIVOT.format(by='domain, variant_id, user_id')}), {_SIDES},
 l AS (SELECT domain, variant_id, count(DISTINCT user_id) AS users, count(DISTINCT recommendation_id) AS lists FROM served GROUP BY ALL), o AS ({offline._PIVOT.format(by='domain, variant_id')}),
 t AS (SELECT domain, sum(users)::DOUBLE / 2 AS e FROM l GROUP BY ALL), s AS (SELECT domain, sum(pow(coalesce(users, 0) - e, 2.0::DOUBLE) / e) AS chi2 FROM t CROSS JOIN (VALUES ('control'), ('treatment')) v(variant_id) LEFT JOIN l USING (domain, variant_id) GROUP BY ALL)
 SELECT l.domain, l.variant_id, l.users, l.lists, o."IMPRESSED" AS impressions, {_SHARE('o."PLAYED"', 'o."IMPRESSED"')} AS ctr, {_SHARE('o."COMPLETED"', 'o."PLAYED"')} AS completion, {_SHARE('o."SKIPPED_EARLY"', 'o."PLAYED"')} AS early_skip, {_SHARE('(o."LIKED" + o."SAVED")', 'o."IMPRESSED"')} AS "like",
 {_TESTED}, {sql.round4('chi2')} AS srm_chi2
 FROM l JOIN o USING (domain, variant_id) JOIN s USING (domain) LEFT JOIN ctr USING (domain, variant_id) LEFT JOIN completion USING (domain, variant_id) LEFT JOIN early_skip USING (domain, variant_id)""",
    ),
    "explanation_plan": (
        explanation_plan,
        f"WITH {sql.SERVED}, s AS ({catalog_queries.QUERIES['sampled_lists'][1]}) SELECT DISTINCT substr(sha256(domain || '|TRENDING|null|' || item_id), 1, 24) AS key, domain, 'TRENDING' AS reason, item_id FROM served JOIN s ON recommendation_id = o_orderkey WHERE position IN (1, 2) AND item_id % 3 <> 0 AND item_id % 5 <> 0 AND item_id IN (SELECT p_partkey FROM part)",
    ),
}
