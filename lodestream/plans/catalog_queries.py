"""Queries over the catalog, onboarding, exports and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import texts
from ..functions.scalars import round4
from ..operators import catalog, evaluation, monitoring
from ..sources import views
from ..sources.shared import once
from . import offline, sql

SECRET = b"a secret for tests"
PRICES = {"small": 0.02, "large": 0.13, "large:output": 0.6}
BUDGET = 0.02


def _items(spark, d):
    """Catalog items from `part`, with some of everything that can be wrong."""
    k = F.col("p_partkey")
    listed = lambda n, word: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit(word), i.cast("string")))
    p = views.table(spark, d, "part")
    return p.select(
        F.when(k % 50 == 1, "a b").otherwise(k.cast("string")).alias("item_id"), F.when(k % 50 == 2, "radio").otherwise(F.element_at(F.array(*map(F.lit, config.DOMAINS)), (k % 4 + 1).cast("int"))).alias("domain"),
        F.when(k % 50 == 3, "\t \x1f\u3000").when(k % 50 == 4, F.repeat(F.lit("t"), 501)).otherwise(F.col("p_name")).alias("title"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_").alias("creator_id"),
        F.when(k % 50 != 5, F.col("p_brand")).alias("creator_name"), F.when(k % 50 == 6, listed(21, "g")).when(k % 3 == 0, F.array("p_type")).alias("genres"),
        F.when(k % 7 == 0, F.array(F.lit("calm"), F.lit("warm"))).alias("moods"), F.when(k % 6 == 0, F.array(F.lit("sea"))).alias("themes"), F.when(k % 2 == 0, F.array("p_type", F.lit("news"))).alias("topics"),
        F.when(k % 50 == 8, F.repeat(F.lit("d"), 10_001)).when(k % 5 == 0, F.concat(F.lit(" "), F.col("p_name"), F.lit(" at large "))).alias("description"),
        F.when(k % 50 == 9, F.repeat(F.lit("s"), 4_001)).alias("transcript_summary"), F.when(k % 9 == 0, F.lit("dry")).alias("tone"), F.when(k % 8 != 0, k % 4).alias("enrichment_version"),
        F.array(F.lit("bright")).alias("enriched_moods"),
    )


def catalog_errors(spark, d):
    return catalog.validate_items(_items(spark, d)).groupBy("error").agg(F.count("*").alias("n"))


def enrichment_errors(spark, d):
    k = F.col("p_partkey")
    rows = views.table(spark, d, "part").select(
        F.when(k % 10 == 0, 0).when(k % 10 == 1, F.lit(None)).otherwise(2).alias("version"), F.when(k % 10 == 2, F.array_repeat(F.lit("m"), 6)).alias("moods"),
        F.when(k % 10 == 3, F.array(F.lit("ok"), F.lit("\t"))).when(k % 10 == 4, F.array(F.lit(None).cast("string"))).alias("themes"), F.when(k % 10 == 5, F.array(F.repeat(F.lit("x"), 41))).alias("topics"),
        F.when(k % 10 == 6, F.repeat(F.lit("x"), 31)).alias("tone"), F.lit(None).cast("string").alias("reading_level"),
    )
    return catalog.validate_enrichment(rows).groupBy("error").agg(F.count("*").alias("n"))


def catalog_outcome(spark, d):
    from . import tables

    return catalog.batch_outcome(tables.merged_with_new(spark, d))


def embedding_texts(spark, d):
    items = catalog.validate_items(_items(spark, d)).where("error is null")
    moods = catalog.published_moods(F.col("moods"), F.col("enriched_moods"))
    due = items.select("item_id", catalog.needs_enrichment(3).alias("due"))
    return items.withColumn("moods", moods).select("item_id", catalog.embedding_text().alias("text")).join(due, "item_id")


def embedding_changes(spark, d):
    now = embedding_texts(spark, d).select("item_id", "text")
    old = now.where("item_id % 3 != 0").withColumn("text", F.when(F.col("item_id") % 4 == 0, F.lit("old")).otherwise(F.col("text")))
    gone = spark.createDataFrame([("gone", "x")], "item_id string, hash string")
    indexed = old.select("item_id", texts.content_hash(F.lit("v2"), F.lit("m"), F.lit(64), F.col("text")).alias("hash")).unionByName(gone)
    return catalog.embedding_changes(now, indexed, "v2", "m", 64).groupBy("action").agg(F.count("*").alias("n"))


def onboarding_seeds(spark, d):
    e = views.events(spark, d).where("event_type = 'CLICK'")
    seeds = catalog.onboarding_seeds(e, views.items(spark, d).select("item_id", "vector"))
    return seeds.select("user_id", "domain", F.posexplode("vector").alias("i", "x")).withColumn("x", round4(F.col("x")))


def pseudonymised_export(spark, d):
    rows = views.attributed(spark, d).select("user_id", "domain", "recommendation_id", "item_id", "position", "outcome")
    return catalog.pseudonymised(rows, SECRET)


def explanation_lookup(spark, d):
    shown = views.served(spark, d).select("recommendation_id", "item_id", "domain", F.when(F.col("position") == 0, "POPULAR_FALLBACK").otherwise("TRENDING").alias("reason"), F.lit(None).cast("string").alias("seed"))
    key = texts.explanation_key(F.col("domain"), F.lit("TRENDING"), F.lit(None), F.col("item_id"))
    cached = shown.where("item_id % 2 = 0").select("domain", "item_id").distinct().select(key.alias("key"), F.concat(F.lit("about "), F.col("item_id").cast("string")).alias("text"))
    return catalog.attach_explanations(shown, cached).select("recommendation_id", "item_id", "explanation")


def sampled_lists(spark, d):
    return views.table(spark, d, "orders").where(catalog.sampled(F.col("o_orderkey").cast("string"), 10)).select("o_orderkey")


def value_percentiles(spark, d):
    return monitoring.percentiles(views.events(spark, d), "value", (0.5, 0.95, 0.99), ["domain"]).select("domain", "share", round4(F.col("value")).alias("value"))


def token_costs(spark, d):
    docs = views.table(spark, d, "documents")
    calls = docs.select(F.when(F.col("doc_id") % 2 == 0, "small").otherwise("large").alias("model"), F.col("lang").alias("job"), F.col("n_chars").cast("long").alias("input_tokens"), F.when(F.col("doc_id") % 2 == 1, F.lit(100).cast("long")).alias("output_tokens"))
    return monitoring.token_costs(calls, PRICES).select("model", "job", "tokens", F.round("usd", 6).alias("usd"))


def spend_warnings(spark, d):
    e = views.events(spark, d)
    spend = e.select(F.lit("2024-01").alias("month"), "ts", (F.col("item_id") % 10 / 1e4).alias("usd"))
    return monitoring.spend_warnings(spend, BUDGET)


def model_gate(spark, d):
    rows = once(offline.ltr(spark, d).select("recommendation_id", "item_id", "label", "f_semantic", "f_cf")).withColumn("score", F.col("f_semantic"))
    old = rows.withColumn("score", F.col("f_cf"))

    def report(r):
        engaged = r.agg(F.countDistinct("recommendation_id").alias("groups"), F.sum((F.col("label") > 0).cast("long")).alias("engaged_rows"))
        m = evaluation.list_metrics(r).agg(F.avg("ndcg").alias("ips_ndcg"))
        a = evaluation.auc(r, "score").select(F.col("auc").alias("quality_auc"))
        return engaged.join(m).join(a)  # one row each

    return monitoring.gate(report(rows), report(old), 0.0, 20)


_KEY = SECRET.ljust(64, b"\0")
_ERR = f"""SELECT CASE WHEN p_partkey % 50 = 1 THEN 'INVALID_ITEM_ID' WHEN p_partkey % 50 = 2 THEN 'INVALID_DOMAIN' WHEN p_partkey % 50 IN (3, 4) THEN 'INVALID_TITLE' WHEN p_partkey % 50 = 5 THEN 'INVALID_ARTIST'
  WHEN p_partkey % 50 = 6 THEN 'TOO_MANY_TAGS' WHEN p_partkey % 50 = 8 THEN 'DESCRIPTION_TOO_LONG' WHEN p_partkey % 50 = 9 THEN 'TRANSCRIPT_SUMMARY_TOO_LONG' END AS error, count(*) AS n FROM part GROUP BY ALL"""
_FIT = "p_partkey % 50 NOT IN (1, 2, 3, 4, 5, 6, 8, 9)"
_TEXTS = f"""t0 AS (SELECT p_partkey AS k, p_name || ' by ' || p_brand || '.' AS byline, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END AS g, CASE WHEN p_partkey % 7 = 0 THEN 'calm, warm' ELSE 'bright' END AS m,
    CASE WHEN p_partkey % 6 = 0 THEN 'Themes: sea.' END AS th, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'Topics: ' || p_type || ', news.' WHEN p_partkey % 3 = 0 THEN 'Topics: ' || p_type || '.' WHEN p_partkey % 2 = 0 THEN 'Topics: ' || p_type || ', news.' END AS tp,
    CASE WHEN p_partkey % 5 = 0 THEN trim(p_name || ' at large') END AS de, p_name AS title, CASE WHEN p_partkey % 9 = 0 THEN 'Tone: dry.' END AS tone, (p_partkey % 8 = 0 OR p_partkey % 4 < 3) AND (p_partkey % 7 <> 0 OR p_partkey % 6 <> 0 OR p_partkey % 2 <> 0) AS due FROM part WHERE {_FIT}),
  et AS (SELECT CAST(k AS VARCHAR) AS item_id, due, CASE k % 4 WHEN 0 THEN concat_ws(' ', byline, 'Genres: ' || g || '.', 'Mood: ' || m || '.', th) WHEN 2 THEN concat_ws(' ', byline, 'Genres: ' || g || '.', th, 'Mood: ' || m || '.', de)
    WHEN 1 THEN concat_ws(' ', byline, tp, de) ELSE concat_ws(' ', coalesce(de, trim(title)), tp, tone) END AS text FROM t0)"""


def _side(name, column):
    return f"""{name}_k AS (SELECT recommendation_id, label, row_number() OVER (PARTITION BY recommendation_id ORDER BY {column} DESC, item_id) AS r, row_number() OVER (PARTITION BY recommendation_id ORDER BY label DESC, item_id) AS i FROM ltr),
 {name}_l AS (SELECT recommendation_id, sum(CASE WHEN r <= 5 THEN (pow(2.0::DOUBLE, label) - 1) / log2(r + 1.0::DOUBLE) ELSE 0 END) / sum(CASE WHEN i <= 5 THEN (pow(2.0::DOUBLE, label) - 1) / log2(i + 1.0::DOUBLE) ELSE 0 END) AS ndcg FROM {name}_k GROUP BY ALL),
 {name}_r AS (SELECT label, rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0::DOUBLE AS r FROM ltr),
 {name} AS (SELECT (SELECT avg(ndcg) FROM {name}_l) AS ndcg, (sum(r) FILTER (label > 0) - count(*) FILTER (label > 0) * (count(*) FILTER (label > 0) + 1) / 2.0::DOUBLE) / (count(*) FILTER (label > 0) * count(*) FILTER (label <= 0)::DOUBLE) AS auc, count(*) FILTER (label > 0) AS engaged FROM {name}_r)"""


def _hex(pad):
    return bytes(x ^ pad for x in _KEY).hex()


_XP = "substr(sha256(from_hex('{}') || from_hex(sha256(from_hex('{}') || encode(CAST(user_id AS VARCHAR))))), 1, 32)".format(_hex(0x5C), _hex(0x36))
QUERIES = {
    "catalog_errors": (catalog_errors, _ERR),
    "enrichment_errors": (enrichment_errors, "SELECT CASE WHEN p_partkey % 10 IN (0, 1) THEN 'INVALID_VERSION' WHEN p_partkey % 10 = 2 THEN 'TOO_MANY_TAGS' WHEN p_partkey % 10 IN (3, 4, 5) THEN 'INVALID_TAG' WHEN p_partkey % 10 = 6 THEN 'INVALID_LABEL' END AS error, count(*) AS n FROM part GROUP BY ALL"),
    "catalog_outcome": (catalog_outcome, "SELECT (SELECT count(*) FROM part WHERE p_partkey % 10 = 0) AS inserted, count(*) FILTER (p_partkey % 2 = 0 AND (p_partkey % 7 = 0 OR (p_partkey % 4 = 0 AND p_size IS NOT NULL))) AS changed, count(*) FILTER (p_partkey % 2 = 0 AND NOT (p_partkey % 7 = 0 OR (p_partkey % 4 = 0 AND p_size IS NOT NULL))) AS unchanged FROM part"),
    "embedding_texts": (embedding_texts, f"WITH {_TEXTS} SELECT * FROM et"),
    "embedding_changes": (embedding_changes, f"WITH {_TEXTS} SELECT CASE WHEN item_id::BIGINT % 3 = 0 OR item_id::BIGINT % 4 = 0 THEN 'embed' ELSE 'refresh' END AS action, count(*) AS n FROM et GROUP BY ALL UNION ALL SELECT 'delete', 1"),
    "onboarding_seeds": (
        onboarding_seeds,
        f"{sql.cte(sql.EV, sql.ITEM)}, p AS (SELECT DISTINCT user_id, ev.domain, item_id FROM ev WHERE event_type = 'CLICK'), x AS (SELECT user_id, p.domain, CAST(unnest(vector) AS DOUBLE) AS x, generate_subscripts(vector, 1) - 1 AS i FROM p JOIN item USING (item_id)), s AS (SELECT user_id, domain, i, sum(x) AS x FROM x GROUP BY ALL), n AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY user_id, domain)) AS norm FROM s) SELECT user_id, domain, CAST(i AS INTEGER) AS i, {sql.round4('x / norm')} AS x FROM n WHERE norm >= 1e-9",
    ),
    "pseudonymised_export": (pseudonymised_export, f"WITH {sql.SERVED}, {sql.ATTRIBUTED} SELECT {_XP} AS user, lower(domain) AS domain, recommendation_id, item_id, position, outcome FROM attributed"),
    "explanation_lookup": (explanation_lookup, f"WITH {sql.SERVED} SELECT recommendation_id, item_id, CASE WHEN position <> 0 AND item_id % 2 = 0 THEN 'about ' || item_id END AS explanation FROM served"),
    "sampled_lists": (sampled_lists, "SELECT o_orderkey FROM orders WHERE ((list_reduce(list_prepend(0::BIGINT, list_transform(string_split(o_orderkey::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) % 100) + 100) % 100 < 10"),
    "value_percentiles": (
        value_percentiles,
        f"{sql.cte(sql.EV)}, v AS (SELECT domain, value, row_number() OVER (PARTITION BY domain ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY domain) AS n FROM ev WHERE value IS NOT NULL), q AS (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS share) SELECT domain, share, {sql.round4('value')} AS value FROM v JOIN q ON pos = least(floor(share * n), n - 1)",
    ),
    "token_costs": (
        token_costs,
        "WITH c AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'small' ELSE 'large' END AS model, lang AS job, n_chars::BIGINT AS tokens FROM documents UNION ALL SELECT 'large:output', lang, 100 FROM documents WHERE doc_id % 2 = 1) SELECT model, job, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) / 1e6 * CASE model WHEN 'small' THEN 0.02::DOUBLE WHEN 'large' THEN 0.13::DOUBLE ELSE 0.6::DOUBLE END, 6) AS usd FROM c GROUP BY model, job",
    ),
    "spend_warnings": (
        spend_warnings,
        f"{sql.cte(sql.EV)}, s AS (SELECT ts, sum(item_id % 10 / 1e4::DOUBLE) AS usd FROM ev GROUP BY ALL), r AS (SELECT ts, {sql.round4('sum(usd) OVER (ORDER BY ts)')} AS total FROM s) SELECT '2024-01' AS month, threshold, min(ts) AS at FROM r, (SELECT unnest([0.5, 0.8, 1.0])::DOUBLE AS threshold) WHERE total >= threshold * {BUDGET} GROUP BY ALL",
    ),
    "model_gate": (
        model_gate,
        f"{offline._LTR}, {_side('a', 'f_semantic')}, {_side('b', 'f_cf')} SELECT (SELECT count(DISTINCT recommendation_id) FROM ltr) >= 20 AND a.engaged >= 100 AND a.auc >= b.auc AS candidate, (SELECT count(DISTINCT recommendation_id) FROM ltr) >= 20 AND a.ndcg >= b.ndcg AS promoted FROM a, b",
    ),
}
