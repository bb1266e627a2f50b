"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, language, mixing, ogg, packing, shards, simhash, suffixes, tokens, topk, toxicity, whitening
from .common import Scratch

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document; null and empty texts have the fingerprint zero."""
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document; a null text is empty and has the closing id alone."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every vector whose id is divisible by 100; vectors with nulls or non-finite components take no part."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document; a null text is empty."""
    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot of the training order, read back from its shard; the shards go once they have been read."""
    with Scratch(spark) as scratch:
        return scratch.result(shards.training_order(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), f"{scratch.root}/shards"))


def op6_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text through an Ogg file and back; a null text is empty."""
    return ogg.media_features(_table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message in reply order. The table has no quotes (no text of it has a `>`): they are put in first, as mail
    clients do, and what comes out must be linked by them and free of them again."""
    return chat.reply_ordered(chat.quoting(_table(spark, sf_dir, "conversations")))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated passages cut out; those without any stay as they are."""
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "removed", "spans", "text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, learned from the labels that are not held out; null and empty texts are scored, too."""
    return toxicity.toxicity_by_labels(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; a null text has no words, a null source is a source of its own."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out; texts that are null or have no letter are `und`."""
    return language.languages(_table(spark, sf_dir, "documents"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part, order and step of the five filters; a null text is empty, a null source the part of the empty string."""
    return audit.interaction_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's first 32 whitened components; vectors with nulls or non-finite components take no part."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_packing, op3_top_k, op4_token_counts, op5_training_order, op6_ogg, op7_chat, op8_suffixes, op9_toxicity, op10_mixing, op11_language, op12_audit, op13_whitening)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op3_top_k": OP3_SQL, "op12_audit": OP12_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

#: Each order is walked through as it stands: a step removes what fails its filter and no earlier one.
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first FROM d GROUP BY text
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * len(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN first < d.doc_id THEN 'E' ELSE '' END) AS fails
  FROM d JOIN firsts USING (text) LEFT JOIN marks ON d.doc_id = marks.doc_id
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x)
    JOIN l d ON d.x NOT IN (a.x, b.x, c.x) JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS x, filter_order[1:step - 1] AS before FROM o, range(1, 6) AS r(step)
), g AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), e AS (
  SELECT part, filter_order, step, x, n, good, toxic, contains(fails, x) AS failing, translate(fails, before, '') <> fails AS gone, fails = x AS alone FROM g, s
), w AS (
  SELECT part, filter_order, step, x, CAST(coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (failing AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (failing AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (failing AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (failing AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM e GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM w
"""
