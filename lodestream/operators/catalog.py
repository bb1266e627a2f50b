"""The catalog: validation, texts for embedding, what changed, onboarding, explanations, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import texts
from ..functions.scalars import is_blank, is_id
from ..functions.vectors import normalised, sums
from .events import first_error
from .retrieval import met

# Limits of the catalog's fields, of enrichment and of onboarding.
TITLE, DESCRIPTION, TRANSCRIPT, TAGS = 500, 10_000, 4_000, 20
MOODS, THEMES, TOPICS, TAG, LABEL = 5, 8, 8, 40, 30
PICKS, GENRES, FREE_TEXT = 50, 20, 500
EMBEDDED = 1500
#: Reasons that are shown without an explanation.
UNEXPLAINED = ("POPULAR_FALLBACK",)


def _blank(x: Column) -> Column:
    return x.isNull() | is_blank(x)


def validate_items(items: DataFrame) -> DataFrame:
    """Adds `error`: the first of seven codes that applies to a catalog item, else null.

    items: item_id, domain, title, creator_id, creator_name, genres, moods, description, transcript_summary. A null
    list is an empty one; null texts are short enough.
    """
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    checks = [
        ("INVALID_ITEM_ID", F.col("item_id").isNull() | ~is_id(F.col("item_id"))),
        ("INVALID_DOMAIN", F.col("domain").isNull() | ~F.col("domain").isin(*config.DOMAINS)),
        ("INVALID_TITLE", _blank(F.col("title")) | (F.length("title") > TITLE)),
        ("INVALID_ARTIST", F.col("creator_id").isNull() | ~is_id(F.col("creator_id")) | F.col("creator_name").isNull()),
        ("TOO_MANY_TAGS", (size("genres") > TAGS) | (size("moods") > TAGS)),
        ("DESCRIPTION_TOO_LONG", F.length("description") > DESCRIPTION),
        ("TRANSCRIPT_SUMMARY_TOO_LONG", F.length("transcript_summary") > TRANSCRIPT),
    ]
    return items.withColumn("error", first_error(checks))


def validate_enrichment(rows: DataFrame) -> DataFrame:
    """Adds `error`: the first of four codes that applies to an enrichment, else null.

    rows: version, moods, themes, topics, tone, reading_level. A null list is an empty one; a null tag is none.
    """
    lists = {"moods": MOODS, "themes": THEMES, "topics": TOPICS}
    bad = lambda c: F.coalesce(F.exists(c, lambda t: _blank(t) | (F.length(t) > TAG)), F.lit(False))
    many, tag = F.lit(False), F.lit(False)
    for name, most in lists.items():
        many, tag = many | (F.coalesce(F.size(name), F.lit(0)) > most), tag | bad(name)
    label = F.coalesce(F.length("tone") > LABEL, F.lit(False)) | F.coalesce(F.length("reading_level") > LABEL, F.lit(False))
    return rows.withColumn("error", first_error([("INVALID_VERSION", F.coalesce(F.col("version"), F.lit(0)) <= 0), ("TOO_MANY_TAGS", many), ("INVALID_TAG", tag), ("INVALID_LABEL", label)]))


def batch_outcome(merged: DataFrame) -> DataFrame:
    """inserted, changed, unchanged: how many rows of a merge's batch had each `status`; those kept are not of the batch."""
    return merged.agg(*[F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0)).alias(s) for s in ("inserted", "changed", "unchanged")])


def published_moods(curated: Column, enriched: Column) -> Column:
    """The curated moods, or where there are none those of the enrichment."""
    return F.when(F.coalesce(F.size(curated), F.lit(0)) > 0, curated).otherwise(enriched)


def needs_enrichment(version: int, domains: tuple[str, ...] = config.DOMAINS) -> Column:
    """Whether an item (domain, enrichment_version, moods, themes, topics) is stale and lacks something."""
    stale = F.col("enrichment_version").isNull() | (F.col("enrichment_version") < version)
    missing = F.lit(False)
    for c in ("moods", "themes", "topics"):
        missing = missing | (F.coalesce(F.size(c), F.lit(0)) == 0)
    return F.col("domain").isin(*domains) & stale & missing


def embedding_text() -> Column:
    """What of an item (domain, title, creator_name, genres, moods, themes, topics, description, transcript_summary,
    tone) is embedded, by its domain. Lists and long texts that are missing are left out."""
    tags = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    listed = lambda label, c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(F.lit(label), tags(c), F.lit(".")))
    long = lambda c: F.when(~_blank(c), F.when(F.length(c) > EMBEDDED, F.substring(c, 1, EMBEDDED)).otherwise(F.trim(c)))
    by = F.concat(F.col("title"), F.lit(" by "), F.col("creator_name"), F.lit("."))
    genres, moods = F.concat(F.lit("Genres: "), tags(F.col("genres")), F.lit(".")), F.concat(F.lit("Mood: "), tags(F.col("moods")), F.lit("."))
    none = F.array().cast("array<string>")
    topics = listed("Topics: ", F.array_union(F.coalesce("genres", none), F.coalesce("topics", none)))
    themes, description = listed("Themes: ", F.col("themes")), long(F.col("description"))
    parts = {
        "song": [by, genres, moods, themes],
        "book": [by, genres, themes, listed("Mood: ", F.col("moods")), description],
        "video": [by, topics, description, long(F.col("transcript_summary"))],
        "post": [long(F.coalesce("description", "title")), topics, F.when(F.col("tone").isNotNull(), F.concat(F.lit("Tone: "), F.col("tone"), F.lit(".")))],
    }
    chain = None
    for domain, some in parts.items():
        test = F.col("domain") == domain
        chain = F.when(test, F.concat_ws(" ", *some)) if chain is None else chain.when(test, F.concat_ws(" ", *some))
    return chain.otherwise(F.concat_ws(" ", by, description))


def embedding_changes(items: DataFrame, indexed: DataFrame, template: str, model: str, dimensions: int) -> DataFrame:
    """item_id, hash, action: `embed` where the text's hash differs from the index's, `refresh` where it is the same,
    `delete` for what the index has and the catalog has not.

    items: item_id, text; indexed: item_id, hash.
    """
    known = indexed.select(F.col("item_id").alias("_id"), F.col("hash").alias("_hash"))
    new = items.select("item_id", texts.content_hash(F.lit(template), F.lit(model), F.lit(dimensions), F.col("text")).alias("hash"))
    j = new.join(known, F.col("item_id") == F.col("_id"), "full")
    action = F.when(F.col("item_id").isNull(), "delete").when(F.col("hash").eqNullSafe(F.col("_hash")), "refresh").otherwise("embed")
    return j.select(F.coalesce("item_id", "_id").alias("item_id"), "hash", action.alias("action"))


def onboarding_picks(rows: DataFrame) -> DataFrame:
    """Submissions (item_ids, genres, free_text) as they are taken: at most PICKS ids that are ids, GENRES genres.

    Adds `error`, FREE_TEXT_TOO_LONG for a text of more than FREE_TEXT letters. Null lists become empty.
    """
    none = F.array().cast("array<string>")
    ids = F.slice(F.filter(F.coalesce("item_ids", none), lambda x: F.coalesce(is_id(x), F.lit(False))), 1, PICKS)
    return rows.withColumns({"item_ids": ids, "genres": F.slice(F.coalesce("genres", none), 1, GENRES), "error": F.when(F.length("free_text") > FREE_TEXT, "FREE_TEXT_TOO_LONG")})


def onboarding_seeds(picks: DataFrame, vectors: DataFrame) -> DataFrame:
    """user_id, domain, vector: the sum of the vectors of a user's picks (user_id, domain, item_id), of unit length.

    vectors: item_id, vector. An item picked twice counts once; picks without a vector, and users with none, give nothing.
    """
    some = picks.select("user_id", "domain", "item_id").distinct()
    vectors, few = met(vectors.where("vector is not null"), some)
    if few:  # such a join leaves the rows where they are
        rows = some.repartition("user_id", "domain").join(F.broadcast(vectors), "item_id")
    else:
        rows = some.join(vectors, "item_id").repartition("user_id", "domain")
    rows = rows.withColumn("_one", F.lit(1.0))
    return sums(rows, ["user_id", "domain"], ["_one"]).select("user_id", "domain", normalised(F.col("_one_v")).alias("vector")).where("vector is not null")


def attach_explanations(shown: DataFrame, cached: DataFrame) -> DataFrame:
    """Adds `explanation` to shown items (domain, reason, seed, item_id) from the cache (key, text); what popularity
    alone put there is not looked up."""
    key = F.when(F.col("reason").isNotNull() & (F.col("reason") != "POPULAR_FALLBACK"), texts.explanation_key(F.col("domain"), F.col("reason"), F.col("seed"), F.col("item_id")))
    found = cached.select(F.col("key").alias("_key"), F.col("text").alias("explanation"))
    return shown.withColumn("_asked", key).join(found, F.col("_asked") == F.col("_key"), "left").drop("_asked", "_key")


def explanation_plan(shown: DataFrame, existing: DataFrame, known: DataFrame, percent: int, top: int) -> DataFrame:
    """key, domain, reason, seed, item_id: the explanations that sampled lists want and that don't exist, each once.

    shown: recommendation_id, position, domain, reason, seed, item_id; the first `top` of a list count. existing: key; known:
    item_id, as an item without a description can't be explained. What needs none (UNEXPLAINED, or no reason) isn't asked for.
    """
    first = shown.where(sampled(F.col("recommendation_id").cast("string"), percent) & (F.col("position") < top) & F.col("reason").isNotNull() & ~F.col("reason").isin(*UNEXPLAINED))
    key = texts.explanation_key(F.col("domain"), F.col("reason"), F.col("seed"), F.col("item_id"))
    wanted = first.select(key.alias("key"), "domain", "reason", "seed", "item_id").distinct()
    return wanted.join(existing.select("key").distinct(), "key", "left_anti").join(known.select("item_id").distinct(), "item_id", "left_semi")


def sampled(id_: Column, percent: int) -> Column:
    """Whether a list is among the sampled ones, by its id's hash."""
    return F.pmod(texts.java_hash(id_), F.lit(100)) < percent


def pseudonymised(rows: DataFrame, secret: bytes, user: str = "user_id") -> DataFrame:
    """Rows for export: the user is a keyed hash, the domain lower-case; a null domain is `unknown`."""
    columns = [c for c in rows.columns if c not in (user, "domain")]
    return rows.select(texts.pseudonym(F.col(user).cast("string"), secret).alias("user"), F.lower(F.coalesce("domain", F.lit("UNKNOWN"))).alias("domain"), *columns)
