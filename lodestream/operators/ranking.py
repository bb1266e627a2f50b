"""Ranking of candidates and the business rules after it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config


#: What each kind of affinity counts for.
AFFINITIES = {"creator_id": 0.5, "genre": 0.3, "mood": 0.2}


def rejected_creators(recent: DataFrame, now: DataFrame, within_ms: int = config.HOUR_MS) -> DataFrame:
    """user_id, domain, creator_id: whose items a user turned down within the hour before the request.

    recent: user_id, domain, creator_id, weight, ts, the recent interactions; now: user_id, domain, now.
    """
    down = recent.where("weight < 0 and creator_id is not null").join(now, ["user_id", "domain"])
    return down.where(F.col("now") - F.col("ts") < within_ms).select("user_id", "domain", "creator_id").distinct()


def liked_shares(affinities: dict[str, DataFrame]) -> list[DataFrame]:
    """For each of AFFINITIES user_id, domain and `likes_<column>`, a map from what is liked to its share of the largest affinity.

    affinities: user_id, domain, the column, affinity; a user and domain has as many as `features.affinities` keeps.
    """
    out = []
    for by, table in affinities.items():
        some = table.where("affinity > 0").groupBy("user_id", "domain").agg(F.max("affinity").alias("_most"), F.collect_list(F.struct(by, "affinity")).alias("_all"))
        shares = F.map_from_entries(F.transform("_all", lambda x: F.struct(x[by], x["affinity"] / F.col("_most"))))
        out.append(some.select("user_id", "domain", shares.alias(f"likes_{by}")))
    return out


def listed(rows: DataFrame, column: str, name: str) -> DataFrame:
    """user_id, domain, and the distinct values of `column` as a list; for what was limited a user and domain before."""
    return rows.groupBy("user_id", "domain").agg(F.collect_set(column).alias(name))


def rank_features(merged: DataFrame, stats: DataFrame, meta: DataFrame, today: str) -> DataFrame:
    """The nine features of each candidate (request_id, user_id, domain, item_id, the sources' scores, cosine, semantic_reason,
    `likes_<column>` of `liked_shares` for each of AFFINITIES, `rejected` creators).

    stats: item_id, ctr, completion_rate; meta: item_id, creator_id, genre, mood, release_date. What is missing has its
    prior. Further columns of `merged` stay.
    """
    more = [c for c in ("region", "blocked", "blocked_creators", "liked") if c in merged.columns]
    j = merged.join(stats.select("item_id", "ctr", "completion_rate"), "item_id", "left").join(meta, "item_id", "left")
    liking = F.lit(0.0)
    for by, weight in AFFINITIES.items():
        liking = liking + weight * F.coalesce(F.col(f"likes_{by}")[F.col(by)], F.lit(0.0))
    j = j.withColumn("_down", F.when(F.array_contains("rejected", F.col("creator_id")), 1.0))
    days = F.greatest(F.datediff(F.lit(today).cast("date"), F.col("release_date")), F.lit(0))
    f = {
        "semantic": F.greatest(F.coalesce("cosine", F.lit(0.0)), F.lit(0.0)), "cf": F.coalesce("cf", F.lit(0.0)), "next": F.coalesce("next", F.lit(0.0)),
        "affinity": liking, "trending": F.greatest(F.coalesce("trending", F.lit(0.0)), F.coalesce("popular", F.lit(0.0))), "ctr": F.coalesce("ctr", F.lit(0.1)),
        "completion": F.coalesce("completion_rate", F.lit(0.5)), "freshness": F.when(F.col("release_date").isNull(), 0.3).otherwise(F.exp(-days / 90.0)), "penalty": F.coalesce("_down", F.lit(0.0)),
    }
    return j.select("request_id", "user_id", "domain", "item_id", "creator_id", "genre", "release_date", "reason", "trending_reason", "semantic_reason", "fresh", F.col("cosine").isNotNull().alias("near"), (F.col("fresh").isNotNull() & F.col("semantic").isNull()).alias("only_new"), "popular", *more, *[x.alias(f"f_{n}") for n, x in f.items()])


def heuristic_score(weights: dict[str, float] | None = None) -> Column:
    w = weights or config.RANK_WEIGHTS
    popular = 0.5 * F.col("f_trending") + 0.5 * F.least(F.lit(1.0), F.col("f_ctr") / 0.3)
    parts = {"semantic": F.col("f_semantic"), "cf": F.col("f_cf"), "next": F.col("f_next"), "affinity": F.col("f_affinity"), "popular": popular, "completion": F.col("f_completion"), "freshness": F.col("f_freshness"), "penalty": F.col("f_penalty")}
    total = F.lit(0.0)
    for name, x in parts.items():
        total = total + w[name] * x
    return total


def reason() -> Column:
    """Why an item is shown: the source that gave most of its score; of equals the more telling one.

    What has a cosine with the query, found by a search or not, is said to be near it for the request's reason, or new if
    only the search for new items found it. A score that no source explains keeps the reason it came with.
    """
    w = config.RANK_WEIGHTS
    parts = {"semantic": w["semantic"] * F.col("f_semantic") + w["affinity"] * F.col("f_affinity"), "cf": w["cf"] * F.col("f_cf"), "next": w["next"] * F.col("f_next"), "popular": w["popular"] * F.col("f_trending")}
    best = F.greatest(*parts.values())
    return (
        F.when(best <= 0, F.col("reason"))
        .when((best == parts["next"]) & (F.col("f_next") > 0), "OFTEN_PLAYED_NEXT")
        .when((best == parts["cf"]) & (F.col("f_cf") > 0), "LISTENED_TOGETHER")
        .when((best == parts["semantic"]) & F.col("near"), F.when(F.col("only_new"), "NEW_FOR_YOU").otherwise(F.col("semantic_reason")))
        .when((best == parts["popular"]) & F.col("trending_reason").isNotNull(), F.col("trending_reason"))
        .when((best == parts["popular"]) & F.col("popular").isNotNull(), "POPULAR_FALLBACK")
        .otherwise(F.col("reason"))
    )


def top_per_request(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("request_id").orderBy(F.col("score").desc(), "item_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_filter(scored: DataFrame, blocked: DataFrame | Column, creators: DataFrame | Column, meta: DataFrame, region: Column, explicit: bool = False, seed: str | None = None) -> DataFrame:
    """Drops what must never be shown.

    blocked: user_id, domain, item_id of consumed, suppressed and, where a liked item is not shown again, liked items;
    creators: user_id, domain, creator_id of creators that are blocked still; either may be a column of `scored` that
    lists them for the row's user and domain, so that candidates need not be dealt by user again; `seed`: the column of the item that the
    request started from. Unknown items go unless the list of popular items has them, explicit ones unless `explicit`,
    and those that are not available in the region.
    """
    known = scored.join(meta.select("item_id", "explicit", "regions", F.lit(True).alias("_known")), "item_id", "left")
    known = known.where(F.col("_known") | F.col("popular").isNotNull())
    open_here = F.col("regions").isNull() | (F.size("regions") == 0) | F.array_contains(F.col("regions"), region)
    fit = known.where(open_here) if explicit else known.where(open_here & ~F.coalesce("explicit", F.lit(False)))
    if seed is not None:
        fit = fit.where(~F.col("item_id").eqNullSafe(F.col(seed)))
    for column, gone in (("item_id", blocked), ("creator_id", creators)):
        if isinstance(gone, Column):
            fit = fit.where(~F.coalesce(F.array_contains(gone, F.col(column)), F.lit(False)))
        else:
            fit = fit.join(gone.select("user_id", "domain", column).distinct(), ["user_id", "domain", column], "left_anti")
    return fit.drop("explicit", "regions", "_known")


def top_up(shown: DataFrame, popular: DataFrame, exclude: DataFrame, limit: int) -> DataFrame:
    """request_id, user_id, domain, item_id, place, score, reason: short lists filled up from the popular items.

    shown: those columns, region, and place from 1; popular: domain, region, item_id, place; exclude: user_id,
    domain, item_id never shown. What is added scores 1 - i / n for the i-th of n popular items, from 0. Only requests
    that have a row in `shown` are filled up; the lists of popular items are short by their limit.
    """
    lists = shown.groupBy("request_id", "user_id", "domain", "region").agg(F.count("*").alias("have")).where(F.col("have") < limit)
    n = popular.groupBy("domain", "region").agg(F.count("*").alias("n"))
    pool = popular.join(n, ["domain", "region"]).select("domain", "region", "item_id", F.col("place").alias("_order"), (1 - (F.col("place") - 1) / F.col("n")).alias("score"))
    more = lists.join(pool, ["domain", "region"]).join(exclude.select("user_id", "domain", "item_id").distinct(), ["user_id", "domain", "item_id"], "left_anti")
    more = more.join(shown.select("request_id", "item_id"), ["request_id", "item_id"], "left_anti")
    more = more.withColumn("place", F.col("have") + F.row_number().over(Window.partitionBy("request_id").orderBy("_order"))).where(F.col("place") <= limit)
    columns = ["request_id", "user_id", "domain", "item_id", "place", "score", "reason"]
    return shown.select(*columns).unionByName(more.withColumn("reason", F.lit("POPULAR_FALLBACK")).select(*columns))


def fallback_level(partial: Column, known_user: Column, pool: Column, listed: Column) -> Column:
    """How degraded an answer is: NONE, PARTIAL, ANONYMOUS, CACHED_POPULAR or STATIC, the worst that applies.

    partial: a step failed; known_user: there are features of the user; pool: there are candidates; listed: there is a
    popular list for the domain.
    """
    return F.when(~pool & ~listed, "STATIC").when(~pool, "CACHED_POPULAR").when(~known_user, "ANONYMOUS").when(partial, "PARTIAL").otherwise("NONE")


def freshness_boost(scored: DataFrame, now_date: str, days: int = 14, boost: float = config.RERANK["fresh_boost"]) -> DataFrame:
    """Scores of items released within the window times (1 + boost): below zero that makes them worse."""
    new = F.col("release_date") > F.date_sub(F.lit(now_date).cast("date"), days)
    return scored.withColumn("score", F.when(F.coalesce(new, F.lit(False)), F.col("score") * (1 + boost)).otherwise(F.col("score")))


def familiarity_cap(scored: DataFrame, liked: DataFrame | Column, limit: int, share: float = config.RERANK["familiar_share"]) -> DataFrame:
    """The first `limit` of each request, with `place`: liked items beyond the share of the limit go to the end, in their order.

    liked: user_id, item_id; or a column of `scored` that lists them for the row's user, so that candidates need not be dealt by
    user. The first `limit` liked ones and as many others are all that can have such a place: the rest does not leave its task.
    """
    if isinstance(liked, Column):
        known = scored.withColumn("_liked", F.coalesce(F.array_contains(liked, F.col("item_id")), F.lit(False)).cast("int"))
    else:
        known = scored.join(liked.select("user_id", "item_id", F.lit(1).alias("_liked")).distinct(), ["user_id", "item_id"], "left").withColumn("_liked", F.coalesce("_liked", F.lit(0)))
    best = [F.col("score").desc(), "item_id"]
    first = known.withColumn("_at", F.row_number().over(Window.partitionBy("request_id", "_liked").orderBy(*best))).where(F.col("_at") <= limit)
    marked = first.withColumn("_sunk", ((F.col("_liked") == 1) & (F.col("_at") > int(share * limit))).cast("int"))
    placed = marked.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy("_sunk", *best)))
    return placed.where(F.col("place") <= limit).drop("_sunk", "_liked", "_at")


# Rules that choose one item after the other. A request has at most a few hundred candidates; a task walks the lists of a
# whole batch of requests at once.


def _by_request(rows: DataFrame, order: list, run: Callable[[pa.Table, np.ndarray], pa.Table], schema: T.StructType) -> DataFrame:
    """`run` on tables of whole requests and where each begins; a batch's last request waits for the next batch."""

    def starts(ids: pa.ChunkedArray) -> np.ndarray:
        a, b = ids.slice(1), ids.slice(0, max(len(ids) - 1, 0))
        other = pc.not_equal(a, b)
        new = pc.if_else(pc.is_valid(other), other, pc.xor(pc.is_null(a), pc.is_null(b)))
        return np.concatenate([[0], np.flatnonzero(new.to_numpy()) + 1]).astype(np.int64)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and batch.column("request_id")[-1] == held[0].column("request_id")[0]:
                held.append(batch)  # all of it is of the request that waits
                continue
            table = pa.Table.from_batches([*held, batch])
            at = starts(table.column("request_id"))
            held = table.slice(at[-1]).combine_chunks().to_batches()
            if len(at) > 1:
                yield from run(table.slice(0, at[-1]).combine_chunks(), at[:-1]).select(schema.names).to_batches()
        if held:
            yield from run(pa.Table.from_batches(held).combine_chunks(), np.zeros(1, np.int64)).select(schema.names).to_batches()

    return rows.repartition("request_id").sortWithinPartitions("request_id", *order).mapInArrow(whole, schema)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value, -1 for null."""
    return pc.fill_null(column.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def diversify(score: np.ndarray, creator: np.ndarray, genre: np.ndarray, starts: np.ndarray, limit: int, window: int, per_ten: int, keep: float, ahead: int = 50) -> np.ndarray:
    """The place, from 1, of each row in an order that spreads creators and genres; lists begin at `starts`, best score first.

    A creator (-1: none) stays out for window - 1 places after it was shown and has at most per_ten places in each ten; a
    genre costs (1 - keep) times its share so far. If no candidate fits, the first is taken. Only the next `ahead` are
    looked at, so the rest of a list keeps its order behind those chosen.
    """
    total, lengths = len(score), np.diff(np.append(starts, len(score)))
    chosen = limit + ahead // 5
    width = min(int(lengths.max()), chosen + ahead)
    real = np.arange(width) < lengths[:, None]
    at = np.where(real, starts[:, None] + np.arange(width), 0)
    s, c, g, every = score[at], creator[at], genre[at], np.arange(len(starts))
    left, spread = real.copy(), np.zeros(at.shape, np.int64)
    shown, place = np.full((len(starts), chosen), -2), np.zeros(total, np.int64)
    for t in range(min(chosen, width)):
        some = t < lengths
        fit = left & (np.cumsum(left, axis=1) <= ahead)
        for x in shown[:, max(0, t - window + 1) : t].T:
            fit &= (c != x[:, None]) | (c < 0)
        if t % 10 >= per_ten:
            often = sum(c == x[:, None] for x in shown[:, t // 10 * 10 : t].T)
            fit &= (often < per_ten) | (c < 0)
        value = np.where(fit, s - ((1 - keep) * spread / t if t else 0), -np.inf)
        value[np.isnan(value)] = -np.inf
        best = np.where(value.max(axis=1) > -np.inf, value.argmax(axis=1), left.argmax(axis=1))
        rows, best = every[some], best[some]
        left[rows, best] = False
        shown[rows, t] = c[rows, best]
        spread[rows] += g[rows] == g[rows, best][:, None]
        place[at[rows, best]] = t + 1
    rest = place == 0
    before = np.cumsum(rest) - rest
    list_of = np.repeat(every, lengths)
    behind = np.minimum(chosen, lengths)[list_of] + 1 + before - before[starts][list_of]
    return np.where(rest, behind, place)


def diversity_rerank(scored: DataFrame, limit: int, window: int = config.RERANK["artist_window"], per_ten: int = config.RERANK["per_ten"], keep: float = config.RERANK["genre_lambda"]) -> DataFrame:
    """Adds `place` to the candidates of each request."""

    def placed(table: pa.Table, starts: np.ndarray) -> pa.Table:
        score = table.column("score").to_numpy().astype(float)
        place = diversify(score, _codes(table.column("creator_id")), _codes(table.column("genre")), starts, limit, window, per_ten, keep)
        return table.append_column("place", pa.array(place.astype(np.int32)))

    schema = T.StructType([*scored.schema.fields, T.StructField("place", T.IntegerType())])
    return _by_request(scored, [F.col("score").desc(), "item_id"], placed, schema)


def explore_rerank(
    placed: DataFrame, limit: int, epsilon: float = config.RERANK["epsilon"], least: int = config.RERANK["explore_min"], seed: int = 0, strategy: str = "epsilon", first: int = 2,
) -> DataFrame:
    """The first `limit` places of each request, with some given to new or little-shown items, and their propensity.

    placed: request_id, item_id, creator_id, place, fresh, plays, impressions. The pool is the first 30 items beyond the
    limit that are new (fresh) or known to have had few impressions; an item without figures is no evidence. Those of
    creators not in the list yet are preferred. max(1, round(epsilon * limit)) of them each push out the last item and
    come in at a random place from `first` on. "epsilon" draws evenly, the propensity is the chance to be drawn;
    "thompson" takes the highest draws of Beta(plays + 1, impressions - plays + 1), the propensity is estimated by a
    hundred draws. Draws are seeded by the request, so reruns agree. Short lists are left alone.
    """

    def thompson(plays: np.ndarray, shown: np.ndarray, slots: int, draw: np.random.Generator, times: int) -> np.ndarray:
        return np.argsort(-draw.beta(plays + 1, shown - plays + 1, (times, len(plays))), axis=1, kind="stable")[:, :slots]

    def one(request: int, top: list[int], pool: np.ndarray, plays: np.ndarray, shown: np.ndarray) -> tuple[list[int], dict[int, float]]:
        """The rows that are shown, in order, and the propensity of those that came in."""
        slots = min(max(1, int(np.floor(epsilon * limit + 0.5))), len(pool))
        if limit < least or not slots:
            return top, {}
        draw = np.random.default_rng([seed, request & 0xFFFFFFFF])
        if strategy == "thompson":
            picks = thompson(plays[pool], shown[pool], slots, draw, 1)[0].tolist()
            often = np.bincount(thompson(plays[pool], shown[pool], slots, draw, 100).ravel(), minlength=len(pool)) / 100
            chance = np.maximum(often, 0.01)
        else:
            picks, chance = draw.choice(len(pool), slots, replace=False).tolist(), np.full(len(pool), slots / len(pool))
        for i in picks:
            top.pop()
            top.insert(min(first + int(draw.integers(0, max(1, limit - first))), len(top)), int(pool[i]))
        return top, {int(pool[i]): float(chance[i]) for i in picks}

    def explored(table: pa.Table, starts: np.ndarray) -> pa.Table:
        number = lambda name: table.column(name).to_pandas().astype(float).to_numpy()
        creator, impressions = _codes(table.column("creator_id")), number("impressions")
        little = table.column("fresh").to_pandas().notna().to_numpy() | (impressions < config.RERANK["low_impressions"])
        plays = np.maximum(np.nan_to_num(number("plays")), 0)
        shown = np.maximum(np.nan_to_num(impressions), plays)
        rows, explore, propensity, place = [], [], [], []
        requests = table.column("request_id").take(pa.array(starts)).to_pylist()
        for request, a, b in zip(requests, starts.tolist(), [*starts[1:].tolist(), len(table)]):
            top = list(range(a, min(a + limit, b)))
            pool = a + limit + np.flatnonzero(little[a + limit : b])[:30]
            known = set(creator[a : a + limit].tolist())
            novel = [i for i in pool.tolist() if creator[i] not in known]
            top, came = one(int(request), top, np.array(novel) if novel else pool, plays, shown)
            rows += top
            explore += [i in came for i in top]
            propensity += [came.get(i) for i in top]
            place += range(1, len(top) + 1)
        out = table.drop_columns(["place"]).take(pa.array(rows, pa.int64()))
        new = {"explore": pa.array(explore, pa.bool_()), "propensity": pa.array(propensity, pa.float64()), "place": pa.array(place, pa.int32())}
        for name, column in new.items():
            out = out.append_column(name, column)
        return out

    fields = [f for f in placed.schema.fields if f.name != "place"]
    schema = T.StructType([*fields, T.StructField("explore", T.BooleanType()), T.StructField("propensity", T.DoubleType()), T.StructField("place", T.IntegerType())])
    # neither in the list nor in the pool is what stands beyond the limit, not new and not known to be little shown
    matter = (F.col("place") <= limit) | F.col("fresh").isNotNull() | F.coalesce(F.col("impressions") < config.RERANK["low_impressions"], F.lit(False))
    return _by_request(placed.where(matter), ["place"], explored, schema)


#: What a split takes for missing: nothing (NaN counts as 0), NaN, or zero and NaN.
MISSING = {"None": 0, "NaN": 1, "Zero": 2}
#: Up to this a number is zero.
ZERO = 1e-35


def read_trees(dump: dict) -> tuple[list[str], Trees]:
    """Feature names and ensemble of a boosted model that was dumped as JSON (feature_names, tree_info).

    Only splits by `<=` are known; another one, or a dump without trees, is an error.
    """

    def flat(node: dict, out: list) -> int:
        at = len(out)
        out.append(None)
        if "leaf_value" in node:
            out[at] = (-1, 0.0, 0, 0, float(node["leaf_value"]), True, 0)
        else:
            if node.get("decision_type", "<=") != "<=":
                raise ValueError("only numerical splits by <= are supported")
            left, right = flat(node["left_child"], out), flat(node["right_child"], out)
            out[at] = (int(node["split_feature"]), float(node["threshold"]), left, right, 0.0, bool(node.get("default_left", True)), MISSING.get(node.get("missing_type", "None"), 0))
        return at

    trees = []
    for tree in dump.get("tree_info", []):
        trees.append([])
        flat(tree["tree_structure"], trees[-1])
    if not trees:
        raise ValueError("the model has no trees")
    return list(dump.get("feature_names", [])), Trees(trees)


class Trees:
    """A boosted ensemble as flat arrays. A tree is a list of nodes (feature, threshold, left, right, value), to which
    (default left, kind of MISSING) may be added; a leaf has feature -1. A value goes left if it is at most the threshold;
    a missing one goes the default way, which is left where nothing is said."""

    def __init__(self, trees: list[list[tuple]]):
        self.start = np.cumsum([0, *(len(t) for t in trees)])[:-1]
        flat = [n for t in trees for n in t]
        self.feature = np.array([n[0] for n in flat])
        self.threshold = np.array([n[1] for n in flat])
        base = np.repeat(self.start, [len(t) for t in trees])
        self.left, self.right = np.array([n[2] for n in flat]) + base, np.array([n[3] for n in flat]) + base
        self.value = np.array([n[4] for n in flat])
        self.default = np.array([n[5] if len(n) > 5 else True for n in flat])
        self.missing = np.array([n[6] if len(n) > 6 else MISSING["NaN"] for n in flat])

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.start, (len(x), 1))
        while (inner := self.feature[at] >= 0).any():
            row, col = np.nonzero(inner)
            node = at[row, col]
            v = x[row, self.feature[node]]
            kind = self.missing[node]
            gone = (np.isnan(v) & (kind > 0)) | ((np.abs(v) <= ZERO) & (kind == MISSING["Zero"]))
            left = np.where(gone, self.default[node], np.nan_to_num(v) <= self.threshold[node])
            at[row, col] = np.where(left, self.left[node], self.right[node])
        return self.value[at].sum(axis=1)


def dump_trees(trees: Trees, features: list[str]) -> dict:
    """An ensemble as the JSON that `read_trees` reads."""
    kinds = {number: word for word, number in MISSING.items()}

    def node(at: int) -> dict:
        if trees.feature[at] < 0:
            return {"leaf_value": float(trees.value[at])}
        test = {"split_feature": int(trees.feature[at]), "threshold": float(trees.threshold[at]), "decision_type": "<=", "default_left": bool(trees.default[at]), "missing_type": kinds[int(trees.missing[at])]}
        return test | {"left_child": node(trees.left[at]), "right_child": node(trees.right[at])}

    return {"feature_names": features, "tree_info": [{"tree_structure": node(at)} for at in trees.start]}


def tree_scores(rows: DataFrame, trees: Trees, features: list[str], name: str = "score") -> DataFrame:
    """Adds the ensemble's score; Arrow batches, all rows of a batch descend together."""

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(trees.score(np.column_stack([c.to_numpy(np.float64) for c in columns])))

    return rows.withColumn(name, scored(*[F.col(f) for f in features]))


def scores_by_model(rows: DataFrame, models: dict[str, Trees], model: Column, features: list[str], otherwise: Column, name: str = "score") -> DataFrame:
    """Adds the score of the model that each row names, or `otherwise` where it names none of `models`.

    All models go to the tasks together, so they are as many as there are domains and pointers, not requests; each takes its
    rows of a batch at once.
    """
    if not models:
        return rows.withColumn(name, otherwise)

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for named, *columns in batches:
            x = np.column_stack([c.to_numpy(np.float64) for c in columns])
            out = np.full(len(x), np.nan)
            for word in set(named.dropna()) & set(models):
                at = (named == word).to_numpy()
                out[at] = models[word].score(x[at])
            yield pd.Series(out)

    value = F.when(model.isin(*models), scored(model, *[F.col(f) for f in features])).otherwise(otherwise)
    return rows.withColumn(name, value)


def fit_ranker(rows: DataFrame, features: list[str], seed: int = 7, rounds: int = 20, depth: int = 4):
    """A pointwise ranker on graded labels: boosted regression trees of MLlib. Gives the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    steps = [VectorAssembler(inputCols=features, outputCol="_x"), GBTRegressor(featuresCol="_x", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed, predictionCol="prediction")]
    return Pipeline(stages=steps).fit(rows)
