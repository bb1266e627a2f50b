"""Queries of the serving path: vectors, candidates, ranking, rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config
from ..functions.scalars import round4
from ..operators import catalog, features, neighbors, ranking, retrieval, trending
from ..sources import views
from ..sources.shared import once
from . import activity, sql

TODAY = "2024-01-31"
LIMIT = 10
#: Days for which an item is new: the driver's weeks stand for the engine's hours.
FRESH_DAYS = 60
#: The driver's data has no dislikes: its skips stand for items and creators that are turned down.
TURNED_DOWN = ("SKIP",)
_DOMAIN_NO = "CASE domain " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(config.DOMAINS)) + " END"


def _domain_no():
    return F.array_position(F.array(*map(F.lit, config.DOMAINS)), F.col("domain")) - 1


def _tastes(spark, d, keys, half_life):
    return retrieval.taste_vectors(activity.weighted(spark, d), keys, {"vector": half_life}, vectors=views.items(spark, d))


def _long(vectors, *keys):
    return vectors.select(*keys, F.posexplode("vector").alias("i", "x")).withColumn("x", round4(F.col("x")))


def user_vector(spark, d):
    return _long(_tastes(spark, d, ["user_id", "domain"], config.LONG_HALF_LIFE), "user_id", "domain")


def cross_domain_vector(spark, d):
    return _long(_tastes(spark, d, ["user_id"], config.CROSS_HALF_LIFE), "user_id")


def requests(weighted, items):
    """A request of each user in each domain that there is anything to ask with for: request_id, user_id, domain, region, vector,
    semantic_reason. Clicks stand for what users picked when they joined."""
    picked = F.coalesce(F.col("event_type") == "CLICK", F.lit(False))
    known = retrieval.tastes(weighted.withColumn("picked", picked), items, config.DOMAINS, {"short": config.SHORT_HALF_LIFE, "long": config.LONG_HALF_LIFE}, {"cross": config.CROSS_HALF_LIFE})
    vector, reason = retrieval.context(*(F.col(c) for c in ("short", "long", "cross", "seed")))
    asked = known.select("user_id", "domain", vector.alias("vector"), reason.alias("semantic_reason")).where("vector is not null")
    return asked.withColumn("request_id", F.col("user_id") * 4 + _domain_no()).withColumn("region", views.country(F.col("user_id")))


def _acts(spark, d):
    """What requests read of events. It is kept, as a filter by weight would parse an event's properties for each rule of the weight."""
    return once(activity.weighted(spark, d).select("user_id", "domain", "item_id", "event_type", "ts", "weight"))


def query_vector(spark, d):
    """What each request asks with."""
    return _long(requests(_acts(spark, d), views.items(spark, d)), "user_id", "domain")


def query_reasons(spark, d):
    """How many requests of a domain ask with what."""
    return requests(_acts(spark, d), views.items(spark, d)).groupBy("domain", "semantic_reason").agg(F.count("*").alias("n"))


def _taste_sql(name, keys, half_life):
    k = ", ".join(keys)
    return f"""{name}_v AS (SELECT {', '.join('w.' + x for x in keys)}, w.weight, w.ts, item.vector, max(w.ts) OVER (PARTITION BY {', '.join('w.' + x for x in keys)}) AS now FROM w JOIN item USING (item_id) WHERE w.weight <> 0),
 {name}_x AS (SELECT {k}, weight > 0 AS liked, {sql.decay('abs(weight)', 'now - ts', half_life)} AS a, CAST(unnest(vector) AS DOUBLE) AS x, generate_subscripts(vector, 1) - 1 AS i FROM {name}_v),
 {name}_s AS (SELECT {k}, i, sum(CASE WHEN liked THEN a * x ELSE 0.0 END) AS p, sum(CASE WHEN liked THEN a ELSE 0.0 END) AS pm, sum(CASE WHEN liked THEN 0.0 ELSE a * x END) AS n, sum(CASE WHEN liked THEN 0.0 ELSE a END) AS nm FROM {name}_x GROUP BY ALL),
 {name}_m AS (SELECT {k}, i, p / pm - CASE WHEN nm <= 1e-9 THEN 0.0 ELSE least(1.0::DOUBLE, {config.NEGATIVE_CAP} * pm / nm) END * n / pm AS x FROM {name}_s WHERE pm > 1e-9),
 {name} AS (SELECT {k}, i, x / norm AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY {k})) AS norm FROM {name}_m) WHERE norm >= 1e-9)"""


def _semantic(asked, items, k):
    """Of each request the k nearest of those items of its domain that it may be shown in its region."""
    fit = retrieval.eligible(items, list(views.COUNTRIES))
    return retrieval.nearest(asked.select(F.col("request_id").alias("query_id"), "vector", "domain", "region"), fit, k, ("domain", "region"), itself=True)


def knn_items(spark, d):
    """Asks with the items whose id is divisible by 100, against all."""
    i = views.items(spark, d)
    return retrieval.knn(i.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "vector"), i, 10)


def knn_filtered(spark, d):
    i = once(views.items(spark, d))
    found = _semantic(once(requests(_acts(spark, d), i)), i, 10)
    return found.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.item_id", "x.score")


def rescore_ids(spark, d):
    """Cosine of given pairs only: each request with the items its user consumed."""
    from ..functions.vectors import cosine, doubles

    i = views.items(spark, d)
    used = once(features.consumed_items(views.events(spark, d)).select("user_id", "domain", "item_id"))
    vectors, few = retrieval.met(i.select("item_id", F.col("vector").alias("v")), used)
    pairs = requests(_acts(spark, d), i).join(used, ["user_id", "domain"]).join(F.broadcast(vectors) if few else vectors, "item_id")
    return pairs.select("request_id", "item_id", round4(cosine(F.col("vector"), doubles(F.col("v")))).alias("score"))


def item_profiles_left_join(spark, d):
    i = views.items(spark, d)
    p = views.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("artist_id"))
    return p.join(i.where("genre < 5").select("item_id", "genre", F.size("vector").alias("dims")), "item_id", "left")


def _seeds(weighted):
    recent = weighted.where("weight > 0").groupBy("user_id", "domain", "item_id").agg(F.max(F.struct("ts", "event_id")).alias("at"))
    order = Window.partitionBy("user_id", "domain").orderBy(F.col("at").desc())
    kept = recent.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < config.CANDIDATES["cf_seeds"])
    return kept.select((F.col("user_id") * 4 + _domain_no()).alias("request_id"), F.col("item_id").alias("seed"), "place")


class Serving:
    """What the ranking queries share: events, requests and candidates, each computed once."""

    def __init__(self, spark, d):
        self.spark, self.d = spark, d
        self.events = once(activity.weighted(spark, d).drop("session_id", "received_ts"))
        self.items = once(views.items(spark, d))
        self.now = features.newest(self.events)
        self.asked = once(requests(self.events, self.items))

    def found(self):
        """The requests with what the sources found for each, as lists: a request is one row until its items are scored.

        Sets `named`, the vectors of those items that may be a candidate without a search having scored them.
        """
        c, asked = config.CANDIDATES, self.asked
        of = lambda lists, name: lists.select(F.col(lists.columns[0]).alias("request_id"), F.col("found").alias(name))
        new = self.items.where(F.col("release_date") >= F.date_sub(F.lit(TODAY).cast("date"), FRESH_DAYS))
        lists = once(neighbors.neighbor_lists(activity.pairs_of(self.events), self.now, support=0.5))
        seeds = once(_seeds(self.events))
        hot = trending.trending(trending.window_counts(self.events, activity.WINDOW), self.now, activity.HOUR, c["trending"])
        hot = hot.withColumn("score", round4(F.col("score") / F.max("score").over(Window.partitionBy("domain", "region"))))
        hot = once(hot.groupBy("domain", "region").agg(F.collect_list(F.struct("item_id", "score")).alias("found")))  # a list a region
        named = [lists.select(F.col("neighbor_id").alias("item_id")), hot.select(F.explode("found.item_id").alias("item_id"))]
        self.named, self.few = retrieval.met(self.items.select("item_id", "vector"), *named)
        found = {
            "semantic": _semantic(asked, self.items, c["semantic"]), "fresh": _semantic(asked, new, c["fresh"]),
            "cf": retrieval.neighbor_candidates(seeds, lists.where("kind = 'co'"), c["cf"]), "next": retrieval.neighbor_candidates(seeds.where("place = 0"), lists.where("kind = 'next'"), c["next"]),
        }
        rows = asked
        for name, source in found.items():
            rows = rows.join(of(source, name), "request_id", "left")
        rows = rows.join(F.broadcast(hot.withColumnRenamed("found", "here")), ["domain", "region"], "left")
        return rows.join(F.broadcast(hot.where("region = 'GLOBAL'").select("domain", F.col("found").alias("world"))), "domain", "left")

    def candidates(self, requests=None):
        """A row for each request and item that a source found; the columns of `requests` go along."""
        lists = retrieval.merge(self.found() if requests is None else requests, ["semantic", "fresh", "cf", "next", "here", "world"])
        # an item of no source has no request: a user without any candidate would be served the popular list
        rows = lists.select(*(c for c in lists.columns if c != "found"), F.explode("found").alias("x")).select("*", "x.*").drop("x")
        rows = rows.withColumns({s: F.greatest(s, F.when(F.col(s).isNotNull(), 0.0)) for s in ("semantic", "fresh")})
        world = F.col("world").isNotNull() & (F.col("here").isNull() | (F.col("world") >= F.col("here")))
        rows = rows.withColumns({"trending": F.greatest("here", "world"), "trending_reason": F.when(world, "TRENDING").when(F.col("here").isNotNull(), "POPULAR_IN_REGION"), "popular": F.lit(None).cast("double")}).drop("here", "world")
        reasons = {"semantic": F.col("semantic_reason"), "fresh": F.lit("NEW_FOR_YOU"), "cf": F.lit("LISTENED_TOGETHER"), "next": F.lit("OFTEN_PLAYED_NEXT"), "trending": F.col("trending_reason")}
        top = F.greatest(*(F.when(F.col(s).isNotNull(), F.struct(F.col(s).alias("score"), F.lit(s).alias("source"), r.alias("reason"))) for s, r in reasons.items()))
        return rows.withColumns({"reason": top["reason"], "sources": sum((F.col(s).isNotNull().cast("long") for s in reasons), F.lit(0).cast("long"))})

    def features(self, blocked=False, liked=False):
        """Candidates with their features; with `blocked`, each also has its request's blocked items and creators, with `liked` the
        items that its user liked."""
        meta = self.items.select("item_id", "creator_id", "genre", "mood", "release_date")
        narrow = retrieval.small(once(meta), retrieval.NARROW)  # broadcast wherever candidates meet it, so that they stay where they are
        with_items = self.events.join(narrow, "item_id", "left")
        liking = {by: features.affinities(with_items, by) for by in ranking.AFFINITIES}
        recent = features.recent_interactions(self.events).join(retrieval.small(self.items.select("item_id", "creator_id"), retrieval.NARROW), "item_id")
        now = self.events.groupBy("user_id", "domain").agg(F.max("ts").alias("now"))
        rejected = ranking.rejected_creators(recent, now, activity.HOUR)
        tables = [*ranking.liked_shares(liking), ranking.listed(rejected, "creator_id", "rejected")]
        if blocked:
            tables += [ranking.listed(self.blocked(), "item_id", "blocked"), ranking.listed(self.blocked_creators(), "creator_id", "blocked_creators")]
        if liked:  # a candidate is of its request's domain, and so is what was liked that can be one
            tables.append(ranking.listed(features.recent_set(self.events, ("LIKE", "SAVE"), config.LIKED_MAX), "item_id", "liked"))
        rows = self.found()
        for table in tables:
            by_request = table.withColumn("request_id", F.col("user_id") * 4 + _domain_no()).drop("user_id", "domain")
            rows = rows.join(by_request, "request_id", "left")
        stats = features.item_stats(self.events, now=self.now)
        cosines = retrieval.rescored(self.candidates(rows), None, F.broadcast(self.named) if self.few else self.named).drop("vector")
        return ranking.rank_features(cosines, retrieval.small(once(stats.select("item_id", "ctr", "completion_rate")), retrieval.NARROW), narrow, TODAY)

    def scored(self, blocked=False, liked=False):
        return self.features(blocked, liked).withColumn("score", round4(ranking.heuristic_score())).withColumn("reason", ranking.reason())

    def seen(self):
        """Items consumed within the domain's window, or turned down."""
        used = features.consumed_items(self.events)
        down = features.recent_set(self.events, TURNED_DOWN, config.SUPPRESSED_MAX)
        columns = ["user_id", "domain", "item_id"]
        return used.select(columns).unionByName(down.select(columns))

    def blocked(self):
        """Items never shown: those seen, and liked ones where liked items do not come again."""
        liked = features.recent_set(self.events, ("LIKE", "SAVE"), config.LIKED_MAX).where(F.col("domain").isin(*config.LIKED_ONCE))
        return self.seen().unionByName(liked.select("user_id", "domain", "item_id")).distinct()

    def blocked_creators(self):
        """Creators of items that were turned down within the last thirty days."""
        down = self.events.where(F.col("event_type").isin(*TURNED_DOWN)).join(retrieval.small(self.items.select("item_id", "creator_id"), retrieval.NARROW), "item_id")
        now = self.events.groupBy("user_id", "domain").agg(F.max("ts").alias("now"))
        held = down.where("creator_id is not null").join(now, ["user_id", "domain"]).where(F.col("now") - F.col("ts") <= config.CREATOR_SUPPRESSION)
        return held.select("user_id", "domain", "creator_id").distinct()

    def filtered(self):
        return ranking.hard_filter(self.scored(blocked=True), F.col("blocked"), F.col("blocked_creators"), retrieval.small(self.items.select("item_id", "explicit", "regions"), retrieval.NARROW), F.col("region"))


def candidates_merged(spark, d):
    return Serving(spark, d).candidates().select("request_id", "item_id", *[round4(F.col(c)).alias(c) for c in ("semantic", "fresh", "cf", "next", "trending")], "sources")


def rank_features(spark, d):
    return Serving(spark, d).features().select("request_id", "item_id", *[round4(F.col(f"f_{f}")).alias(f"f_{f}") for f in config.FEATURES])


def scored(spark, d):
    return Serving(spark, d).scored()


def heuristic_topk(spark, d):
    return ranking.top_per_request(scored(spark, d), LIMIT).select("request_id", "rank", "item_id", "score")


def reason_codes(spark, d):
    return ranking.top_per_request(scored(spark, d), LIMIT).groupBy("reason").agg(F.count("*").alias("n"))


def hard_filter(spark, d):
    return Serving(spark, d).filtered().select("request_id", "item_id", "score")


def topped_up(spark, d):
    """The first of each request after the hard filters, short lists filled up from the popular items."""
    s = Serving(spark, d)
    shown = once(ranking.top_per_request(s.filtered(), LIMIT).select("request_id", "user_id", "domain", "region", "item_id", "score", "reason", F.col("rank").alias("place")))
    lists = trending.trending(trending.window_counts(s.events, activity.WINDOW), s.now, activity.HOUR, config.TRENDING_TOP)
    popular = trending.region_then_global(lists, list(views.COUNTRIES), 50)
    return ranking.top_up(shown, popular, s.seen(), LIMIT).select("request_id", "item_id", "place", round4(F.col("score")).alias("score"), "reason")


def fallback_levels(spark, d):
    """How many users have an answer of each level, by domain: one with a taste, or only the domain's popular list."""
    users = views.events(spark, d).select("user_id", "domain").distinct()
    known = _tastes(spark, d, ["user_id", "domain"], config.LONG_HALF_LIFE).select("user_id", "domain", F.lit(True).alias("known"))
    lists = activity.trending_lists(spark, d).select("domain", F.lit(True).alias("listed")).distinct()
    j = users.join(known, ["user_id", "domain"], "left").join(lists, "domain", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    level = ranking.fallback_level(F.lit(False), yes("known"), yes("known") | yes("listed"), yes("listed"))
    return j.groupBy("domain", level.alias("level")).agg(F.count("*").alias("n"))


def freshness_boost(spark, d):
    return ranking.freshness_boost(scored(spark, d), TODAY, days=60).select("request_id", "item_id", round4(F.col("score")).alias("score"))


def familiarity_cap(spark, d):
    s = Serving(spark, d)
    return ranking.familiarity_cap(s.scored(liked=True), F.col("liked"), LIMIT).select("request_id", "place", "item_id", "score")


def diversity_rerank(spark, d):
    top = scored(spark, d).select("request_id", "user_id", "item_id", "creator_id", "genre", "score")
    return ranking.diversity_rerank(top, LIMIT).where(F.col("place") <= LIMIT).select("request_id", "place", "item_id", "score")


def explore_rerank(spark, d):
    return _explored(spark, d, "epsilon")


def explore_thompson(spark, d):
    return _explored(spark, d, "thompson")


def _explored(spark, d, strategy):
    s = Serving(spark, d)
    top = s.scored().select("request_id", "user_id", "item_id", "creator_id", "genre", "score", "fresh")
    stats = features.item_stats(s.events, now=s.now).select("item_id", "plays", "impressions")
    placed = ranking.diversity_rerank(top, LIMIT).join(stats, "item_id", "left").select("request_id", "item_id", "creator_id", "score", "fresh", "plays", "impressions", "place")
    return ranking.explore_rerank(placed, LIMIT, strategy=strategy).select("request_id", "place", "item_id", "explore", "propensity")


def recall_at_k(spark, d):
    wanted = next_pairs(spark, d).select(F.col("item_id").alias("query_id"), F.col("next_item").alias("item_id")).where("query_id != item_id")
    i = views.items(spark, d)
    asked = i.join(wanted.select("query_id").distinct(), i["item_id"] == F.col("query_id"), "left_semi").select(F.col("item_id").alias("query_id"), "vector", "domain")
    return retrieval.recall_at_k(retrieval.knn(once(asked), i, 20, ("domain",)), wanted)


def next_pairs(spark, d):
    first = views.events(spark, d).where("event_type in ('CLICK', 'PLAY_END')").groupBy("user_id", "domain", "item_id").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    order = Window.partitionBy("user_id", "domain").orderBy("at")
    return first.withColumn("next_item", F.lead("item_id").over(order)).where("next_item is not null").select("user_id", "domain", "item_id", "next_item")


def _trees():
    """A small fixed ensemble over the nine features and the position."""
    names = [f"f_{f}" for f in config.FEATURES]
    return names, ranking.Trees([[(i, 0.25 + i / 40, 1, 2, 0.0), (-1, 0.0, 0, 0, -0.1 * i), ((i + 3) % 9, 0.5, 3, 4, 0.0), (-1, 0.0, 0, 0, 0.05 * i), (-1, 0.0, 0, 0, 0.3 - 0.02 * i)] for i in range(9)])


def gbdt_score(spark, d):
    names, trees = _trees()
    return ranking.tree_scores(views.served(spark, d), trees, names).select("recommendation_id", "item_id", round4(F.col("score")).alias("score"))


_GBDT = " + ".join(
    f"CASE WHEN f_{config.FEATURES[i]} <= {0.25 + i / 40!r}::DOUBLE THEN {-0.1 * i!r}::DOUBLE WHEN f_{config.FEATURES[(i + 3) % 9]} <= 0.5 THEN {0.05 * i!r}::DOUBLE ELSE {0.3 - 0.02 * i!r}::DOUBLE END" for i in range(9)
)


def pointwise_ranker(spark, d):
    from . import offline
    from ..operators import evaluation

    names = [f"f_{f}" for f in config.FEATURES]
    rows = offline.ltr(spark, d).select("recommendation_id", "item_id", "served_ts", "label", *names)
    parts = once(evaluation.time_split(rows).select("recommendation_id", "item_id", "part", "label", *names))
    model = ranking.fit_ranker(parts.where("part = 'train'"), names, rounds=5)
    predicted = model.transform(parts.where("part = 'valid'"))
    m = evaluation.list_metrics(predicted.withColumnRenamed("prediction", "score"))
    return m.agg(F.count("*").alias("lists"), round4(F.avg("ndcg")).alias("ndcg"))


_TASTE = _taste_sql("taste", ["user_id", "domain"], config.LONG_HALF_LIFE)
_BASE = f"{sql.cte(sql.EV, sql.ITEM)}, {activity.WEIGHTED_SQL}"
REQ = f"""{_TASTE}, {_taste_sql('crossed', ['user_id'], config.CROSS_HALF_LIFE)}, {_taste_sql('short', ['user_id', 'domain'], config.SHORT_HALF_LIFE)},
 sd_x AS (SELECT user_id, p.domain, CAST(unnest(vector) AS DOUBLE) AS x, generate_subscripts(vector, 1) - 1 AS i FROM (SELECT DISTINCT user_id, domain, item_id FROM ev WHERE event_type = 'CLICK') p JOIN item USING (item_id)),
 sd_s AS (SELECT user_id, domain, i, sum(x) AS x FROM sd_x GROUP BY ALL), seeds AS (SELECT user_id, domain, i, x / norm AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY user_id, domain)) AS norm FROM sd_s) WHERE norm >= 1e-9),
 asks AS (SELECT u.user_id, dm.domain, g.i, s.x AS s, l.x AS l, c.x AS c, o.x AS o
   FROM (SELECT DISTINCT user_id FROM ev) u CROSS JOIN (SELECT unnest({list(config.DOMAINS)!r}) AS domain) dm CROSS JOIN (SELECT DISTINCT i FROM crossed_s) g
   LEFT JOIN short s ON s.user_id = u.user_id AND s.domain = dm.domain AND s.i = g.i LEFT JOIN taste l ON l.user_id = u.user_id AND l.domain = dm.domain AND l.i = g.i
   LEFT JOIN crossed c ON c.user_id = u.user_id AND c.i = g.i LEFT JOIN seeds o ON o.user_id = u.user_id AND o.domain = dm.domain AND o.i = g.i),
 mixed AS (SELECT user_id, domain, i, CASE WHEN s IS NOT NULL THEN 'SIMILAR_TO_RECENT' WHEN l IS NOT NULL THEN 'SIMILAR_TO_TASTE' WHEN c IS NOT NULL THEN 'CROSS_DOMAIN' ELSE 'ONBOARDING_MATCH' END AS semantic_reason,
   CASE WHEN s IS NOT NULL OR l IS NOT NULL THEN coalesce({config.BLEND['short']}::DOUBLE * s, 0.0) + coalesce({config.BLEND['long']}::DOUBLE * l, 0.0) + coalesce({config.BLEND['cross']}::DOUBLE * c, 0.0) WHEN c IS NOT NULL THEN c + coalesce(o, 0.0) ELSE o END AS x FROM asks),
 req_x AS (SELECT user_id, domain, i, semantic_reason, x / sqrt(sum(x * x) OVER (PARTITION BY user_id, domain)) AS x FROM mixed WHERE x IS NOT NULL),
 req AS (SELECT user_id * 4 + {_DOMAIN_NO} AS request_id, user_id, domain, {sql.pick(views.COUNTRIES, 'user_id % 6')} AS region, semantic_reason, list(x ORDER BY i) AS v FROM req_x GROUP BY ALL)"""
_COS = "list_cosine_similarity(v, CAST(vector AS DOUBLE[]))"


_OPEN = "regions IS NULL OR len(regions) = 0 OR list_contains(regions, 'ALL') OR list_contains(regions, region)"


def _knn_sql(name, k, where="true"):
    return f"""{name} AS (SELECT * FROM (SELECT request_id AS query_id, item_id, {sql.round4(_COS)} AS score FROM req JOIN item USING (domain) WHERE NOT explicit AND ({_OPEN}) AND {where})
   QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= {k})"""


_RANKED = "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank, item_id, score FROM {}"
_C = config.CANDIDATES
CAND = f"""{REQ}, {activity.PAIRS_CTE}, {activity.TREND_CTE}, {_knn_sql('sem', _C['semantic'])}, {_knn_sql('new', _C['fresh'], f"release_date >= CAST(DATE '{TODAY}' - {FRESH_DAYS} AS DATE)")},
 sd AS (SELECT user_id * 4 + {_DOMAIN_NO} AS request_id, item_id AS seed, row_number() OVER (PARTITION BY user_id, domain ORDER BY t DESC, e DESC) - 1 AS place FROM (SELECT user_id, domain, item_id, max(ts) AS t, arg_max(event_id, (ts, event_id)) AS e FROM w WHERE weight > 0 GROUP BY ALL) QUALIFY place < {_C['cf_seeds']}),
 nc AS (SELECT request_id, neighbor_id AS item_id, kind, max(score * (1 - 0.15 * place)) AS score FROM sd JOIN neighbors ON seed = item_id WHERE (kind = 'co' AND rank <= {_C['cf']}) OR (kind = 'next' AND place = 0 AND rank <= {_C['next']}) GROUP BY ALL),
 ht AS (SELECT domain, region, item_id, {sql.round4('score / max(score) OVER (PARTITION BY domain, region)')} AS score FROM trend WHERE rank <= {_C['trending']}),
 gen AS (SELECT query_id AS request_id, item_id, 'semantic' AS source, greatest(score, 0.0) AS score, semantic_reason AS reason FROM sem JOIN req ON query_id = request_id
   UNION ALL SELECT query_id, item_id, 'fresh', greatest(score, 0.0), 'NEW_FOR_YOU' FROM new
   UNION ALL SELECT request_id, item_id, CASE kind WHEN 'co' THEN 'cf' ELSE 'next' END, score, CASE kind WHEN 'co' THEN 'LISTENED_TOGETHER' ELSE 'OFTEN_PLAYED_NEXT' END FROM nc
   UNION ALL SELECT request_id, item_id, 'trending', score, 'POPULAR_IN_REGION' FROM req JOIN ht USING (domain, region)
   UNION ALL SELECT request_id, item_id, 'trending', score, 'TRENDING' FROM req JOIN ht USING (domain) WHERE ht.region = 'GLOBAL'),
 mg AS (SELECT request_id, item_id, {', '.join(f"max(score) FILTER (source = '{x}') AS {x}" for x in ('semantic', 'fresh', 'cf', 'next', 'trending'))},
   arg_max(reason, (score, source, reason)) AS reason, arg_max(reason, (score, reason)) FILTER (source = 'trending') AS trending_reason, count(DISTINCT source) AS sources FROM gen GROUP BY ALL),
 cand AS (SELECT user_id, domain, region, semantic_reason, mg.*, coalesce(semantic, fresh, {sql.round4(_COS)}) AS cosine FROM mg JOIN req USING (request_id) LEFT JOIN (SELECT item_id, vector FROM item) iv USING (item_id))"""


def _liking_sql(by):
    return f"""as_{by} AS (SELECT user_id, domain, {by}, {sql.round4('sum(' + sql.decay('weight', 'now - ts', config.AFFINITY_HALF_LIFE) + ')')} AS affinity FROM wi JOIN last USING (user_id, domain) WHERE {by} IS NOT NULL AND weight <> 0 GROUP BY ALL),
 af_{by} AS (SELECT * FROM as_{by} QUALIFY row_number() OVER (PARTITION BY user_id, domain ORDER BY abs(affinity) DESC, {by}) <= {config.AFFINITY_MAX}),
 li_{by} AS (SELECT user_id, domain, {by}, affinity / max(affinity) OVER (PARTITION BY user_id, domain) AS share FROM af_{by} WHERE affinity > 0)"""


FEAT = f"""{CAND}, {activity.ITEM_STATS_CTE}, wi AS (SELECT w.*, item.creator_id, item.genre, item.mood FROM w LEFT JOIN item USING (item_id)),
 last AS (SELECT user_id, domain, max(ts) AS now FROM w GROUP BY ALL), {', '.join(map(_liking_sql, ('creator_id', 'genre', 'mood')))},
 rejected AS (SELECT DISTINCT user_id, domain, creator_id, 1.0::DOUBLE AS down FROM (SELECT * FROM wi QUALIFY row_number() OVER (PARTITION BY user_id, domain ORDER BY ts DESC, event_id DESC) <= {config.RECENT_MAX}) r JOIN last USING (user_id, domain)
   WHERE weight < 0 AND creator_id IS NOT NULL AND now - ts < {activity.HOUR}),
 feat AS (SELECT c.request_id, c.user_id, c.domain, c.region, c.item_id, m.item_id IS NOT NULL AS known, m.creator_id, m.genre, m.release_date, m.explicit, m.regions, c.reason, c.trending_reason, c.semantic_reason, c.semantic, c.fresh, c.cosine,
   greatest(coalesce(c.cosine, 0.0), 0.0) AS f_semantic, coalesce(cf, 0.0) AS f_cf, coalesce(next, 0.0) AS f_next, 0.0 + 0.5::DOUBLE * coalesce(lc.share, 0.0) + 0.3::DOUBLE * coalesce(lg.share, 0.0) + 0.2::DOUBLE * coalesce(lm.share, 0.0) AS f_affinity,
   coalesce(trending, 0.0) AS f_trending, coalesce(ctr, 0.1) AS f_ctr, coalesce(completion_rate, 0.5) AS f_completion, CASE WHEN m.release_date IS NULL THEN 0.3 ELSE exp(-greatest(DATE '{TODAY}' - m.release_date, 0) / 90.0::DOUBLE) END AS f_freshness, coalesce(down, 0.0) AS f_penalty
   FROM cand c LEFT JOIN item_stats st ON st.item_id = c.item_id LEFT JOIN item m ON m.item_id = c.item_id
   LEFT JOIN li_creator_id lc ON lc.user_id = c.user_id AND lc.domain = c.domain AND lc.creator_id = m.creator_id LEFT JOIN li_genre lg ON lg.user_id = c.user_id AND lg.domain = c.domain AND lg.genre = m.genre
   LEFT JOIN li_mood lm ON lm.user_id = c.user_id AND lm.domain = c.domain AND lm.mood = m.mood LEFT JOIN rejected rj ON rj.user_id = c.user_id AND rj.domain = c.domain AND rj.creator_id = m.creator_id)"""
_POP = "(0.5 * f_trending + 0.5 * least(1.0, f_ctr / 0.3))"
_SCORE = f"0.45 * f_semantic + 0.15 * f_cf + 0.1 * f_next + 0.1 * f_affinity + 0.08 * {_POP} + 0.07 * f_completion + 0.05 * f_freshness + -0.15 * f_penalty"
SCORED = f"""{FEAT}, sc AS (SELECT *, {sql.round4(_SCORE)} AS score, 0.45 * f_semantic + 0.1 * f_affinity AS ps, 0.15 * f_cf AS pc, 0.1 * f_next AS pn, 0.08 * f_trending AS pt FROM feat),
 sr AS (SELECT * REPLACE (CASE WHEN greatest(ps, pc, pn, pt) <= 0 THEN reason WHEN greatest(ps, pc, pn, pt) = pn AND f_next > 0 THEN 'OFTEN_PLAYED_NEXT' WHEN greatest(ps, pc, pn, pt) = pc AND f_cf > 0 THEN 'LISTENED_TOGETHER'
   WHEN greatest(ps, pc, pn, pt) = ps AND cosine IS NOT NULL THEN CASE WHEN fresh IS NOT NULL AND semantic IS NULL THEN 'NEW_FOR_YOU' ELSE semantic_reason END WHEN greatest(ps, pc, pn, pt) = pt AND trending_reason IS NOT NULL THEN trending_reason ELSE reason END AS reason), CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM sc)"""
_TURNED_DOWN = "event_type = 'SKIP'"
FILTERED = f"""{SCORED}, {activity.CONSUMED_CTE},
 blocked AS (SELECT user_id, domain, item_id FROM consumed UNION SELECT user_id, domain, item_id FROM (SELECT user_id, domain, item_id, max((ts, event_id)) AS pos FROM ev WHERE {_TURNED_DOWN} GROUP BY user_id, domain, item_id) QUALIFY row_number() OVER (PARTITION BY user_id, domain ORDER BY pos DESC) <= {config.SUPPRESSED_MAX}
   UNION SELECT user_id, domain, item_id FROM (SELECT user_id, domain, item_id, max((ts, event_id)) AS pos FROM ev WHERE event_type IN ('LIKE', 'SAVE') AND domain IN {config.LIKED_ONCE!r} GROUP BY user_id, domain, item_id) QUALIFY row_number() OVER (PARTITION BY user_id, domain ORDER BY pos DESC) <= {config.LIKED_MAX}),
 bc AS (SELECT DISTINCT user_id, domain, creator_id FROM wi JOIN last USING (user_id, domain) WHERE {_TURNED_DOWN} AND creator_id IS NOT NULL AND now - ts <= {config.CREATOR_SUPPRESSION}),
 hf AS (SELECT sr.* FROM sr ANTI JOIN blocked b USING (user_id, domain, item_id) ANTI JOIN bc USING (user_id, domain, creator_id) WHERE known AND NOT explicit AND (regions IS NULL OR len(regions) = 0 OR list_contains(regions, region)))"""
_LONG = "SELECT user_id, domain, CAST(i AS INTEGER) AS i, " + sql.round4("x") + " AS x FROM {}"
QUERIES = {
    "user_vector": (user_vector, f"{_BASE}, {_TASTE} {_LONG.format('taste')}"),
    "cross_domain_vector": (cross_domain_vector, f"{_BASE}, {_taste_sql('crossed', ['user_id'], config.CROSS_HALF_LIFE)} SELECT user_id, CAST(i AS INTEGER) AS i, {sql.round4('x')} AS x FROM crossed"),
    "query_vector": (
        query_vector,
        f"{_BASE}, {REQ} {_LONG.format('req_x')}",
    ),
    "query_reasons": (
        query_reasons,
        f"{_BASE}, {REQ} SELECT domain, semantic_reason, count(*) AS n FROM req GROUP BY ALL",
    ),
    "knn_items": (
        knn_items,
        f"{sql.cte(sql.ITEM)}, k AS (SELECT a.item_id AS query_id, b.item_id, {sql.round4('list_cosine_similarity(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[]))')} AS score FROM item a JOIN item b ON a.item_id % 100 = 0 AND a.item_id <> b.item_id) {_RANKED.format('k')} QUALIFY rank <= 10",
    ),
    "knn_filtered": (knn_filtered, f"{_BASE}, {REQ}, {_knn_sql('k', 10)} {_RANKED.format('k')}"),
    "rescore_ids": (rescore_ids, f"{_BASE}, {REQ}, {activity.CONSUMED_CTE} SELECT request_id, item_id, {sql.round4(_COS)} AS score FROM req JOIN consumed USING (user_id, domain) JOIN item USING (item_id)"),
    "item_profiles_left_join": (item_profiles_left_join, f"{sql.cte(sql.ITEM)} SELECT p_partkey AS item_id, p_brand AS artist_id, genre, CAST(len(vector) AS INTEGER) AS dims FROM part LEFT JOIN (SELECT * FROM item WHERE genre < 5) i ON p_partkey = item_id"),
    "candidates_merged": (candidates_merged, f"{_BASE}, {CAND} SELECT request_id, item_id, " + ", ".join(f"{sql.round4(c)} AS {c}" for c in ("semantic", "fresh", "cf", "next", "trending")) + ", sources FROM cand"),
    "rank_features": (rank_features, f"{_BASE}, {FEAT} SELECT request_id, item_id, " + ", ".join(f"{sql.round4(f'f_{f}')} AS f_{f}" for f in config.FEATURES) + " FROM feat"),
    "heuristic_topk": (heuristic_topk, f"{_BASE}, {SCORED} SELECT request_id, rank, item_id, score FROM sr WHERE rank <= {LIMIT}"),
    "reason_codes": (reason_codes, f"{_BASE}, {SCORED} SELECT reason, count(*) AS n FROM sr WHERE rank <= {LIMIT} GROUP BY ALL"),
    "hard_filter": (hard_filter, f"{_BASE}, {FILTERED} SELECT request_id, item_id, score FROM hf"),
    "topped_up": (
        topped_up,
        f"""{_BASE}, {FILTERED}, shown AS (SELECT request_id, user_id, domain, region, item_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_id) AS INTEGER) AS place, score, reason FROM hf QUALIFY place <= {LIMIT}),
 {activity.POPULAR_CTE}, pool AS (SELECT domain, region, item_id, place AS o, 1 - (place - 1) / (count(*) OVER (PARTITION BY domain, region))::DOUBLE AS score FROM popular WHERE place <= 50),
 seen AS (SELECT user_id, domain, item_id FROM consumed UNION SELECT user_id, domain, item_id FROM (SELECT user_id, domain, item_id, max((ts, event_id)) AS pos FROM ev WHERE {_TURNED_DOWN} GROUP BY user_id, domain, item_id) QUALIFY row_number() OVER (PARTITION BY user_id, domain ORDER BY pos DESC) <= {config.SUPPRESSED_MAX}),
 few AS (SELECT request_id, user_id, domain, region, count(*) AS have FROM shown GROUP BY ALL HAVING count(*) < {LIMIT}),
 more AS (SELECT request_id, item_id, CAST(have + row_number() OVER (PARTITION BY request_id ORDER BY o) AS INTEGER) AS place, score FROM few JOIN pool USING (domain, region) ANTI JOIN seen USING (user_id, domain, item_id) ANTI JOIN (SELECT request_id, item_id FROM shown) q USING (request_id, item_id))
 SELECT request_id, item_id, place, {sql.round4('score')} AS score, reason FROM shown UNION ALL SELECT request_id, item_id, place, {sql.round4('score')}, 'POPULAR_FALLBACK' FROM more WHERE place <= {LIMIT}""",
    ),
    "fallback_levels": (
        fallback_levels,
        f"{_BASE}, {REQ}, {activity.TREND_CTE}, us AS (SELECT DISTINCT user_id, domain FROM ev), kn AS (SELECT DISTINCT user_id, domain, true AS known FROM taste), tl AS (SELECT DISTINCT domain, true AS listed FROM trend WHERE rank <= 10) SELECT us.domain, CASE WHEN known IS NULL AND listed IS NULL THEN 'STATIC' WHEN known IS NULL THEN 'ANONYMOUS' ELSE 'NONE' END AS level, count(*) AS n FROM us LEFT JOIN kn USING (user_id, domain) LEFT JOIN tl ON tl.domain = us.domain GROUP BY ALL",
    ),
    "freshness_boost": (freshness_boost, f"{_BASE}, {SCORED} SELECT request_id, item_id, {sql.round4(f'CASE WHEN release_date > CAST(DATE {chr(39)}{TODAY}{chr(39)} - 60 AS DATE) THEN score * (1 + 0.1::DOUBLE) ELSE score END')} AS score FROM sr"),
    "familiarity_cap": (
        familiarity_cap,
        f"{_BASE}, {SCORED}, lk AS (SELECT DISTINCT user_id, item_id, 1 AS liked FROM ev WHERE event_type IN ('LIKE', 'SAVE')), fc AS (SELECT request_id, item_id, score, CASE WHEN coalesce(liked, 0) = 1 AND sum(coalesce(liked, 0)) OVER (PARTITION BY request_id ORDER BY score DESC, item_id ROWS UNBOUNDED PRECEDING) > 3 THEN 1 ELSE 0 END AS sunk FROM sr LEFT JOIN lk USING (user_id, item_id)) SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY sunk, score DESC, item_id) AS INTEGER) AS place, item_id, score FROM fc QUALIFY place <= {LIMIT}",
    ),
    "diversity_rerank": (diversity_rerank, None),
    "explore_rerank": (explore_rerank, None),
    "explore_thompson": (explore_thompson, None),
    "next_item_pairs": (
        next_pairs,
        f"{_BASE}, f AS (SELECT user_id, domain, item_id, min((ts, event_id)) AS t FROM ev WHERE event_type IN ('CLICK', 'PLAY_END') GROUP BY ALL), l AS (SELECT user_id, domain, item_id, lead(item_id) OVER (PARTITION BY user_id, domain ORDER BY t) AS next_item FROM f) SELECT * FROM l WHERE next_item IS NOT NULL",
    ),
    "recall_at_k": (
        recall_at_k,
        f"{_BASE}, f AS (SELECT user_id, domain, item_id, min((ts, event_id)) AS t FROM ev WHERE event_type IN ('CLICK', 'PLAY_END') GROUP BY ALL), l AS (SELECT item_id AS query_id, lead(item_id) OVER (PARTITION BY user_id, domain ORDER BY t) AS item_id FROM f), p AS (SELECT DISTINCT * FROM l WHERE item_id IS NOT NULL AND item_id <> query_id), k AS (SELECT a.item_id AS query_id, b.item_id, {sql.round4('list_cosine_similarity(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[]))')} AS score FROM item a JOIN item b ON a.domain = b.domain AND a.item_id <> b.item_id WHERE a.item_id IN (SELECT query_id FROM p)), r AS ({_RANKED.format('k')} QUALIFY rank <= 20) SELECT CAST(count(r.rank) AS BIGINT) AS hits, count(*) AS pairs, {sql.round4('count(r.rank) / count(*)::DOUBLE')} AS recall FROM p LEFT JOIN r USING (query_id, item_id)",
    ),
    "gbdt_score": (gbdt_score, f"WITH {sql.SERVED} SELECT recommendation_id, item_id, {sql.round4(_GBDT)} AS score FROM served"),
    "pointwise_ranker": (pointwise_ranker, None),
}
