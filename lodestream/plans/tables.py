"""Queries over changing tables and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..operators import events as ev_ops
from ..operators import state
from ..sources.views import table


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("seq"), "o_orderstatus")


def latest_per_key(spark, d):
    return ev_ops.latest_per_key(_orders(spark, d), "user_id", "seq")


def _sides(spark, d):
    o = _orders(spark, d)
    last = lambda x: ev_ops.latest_per_key(x, "user_id", "seq")
    gone = table(spark, d, "customer").where("c_custkey % 11 = 0").select(F.col("c_custkey").alias("user_id"))
    return last(o.where("seq % 3 = 0")), last(o.where("seq % 3 != 0")), gone


def cas_upsert(spark, d):
    stored, incoming, gone = _sides(spark, d)
    return state.erase_users(state.cas_upsert(stored, incoming, "user_id"), gone, "user_id")


def cas_results(spark, d):
    stored, incoming, gone = _sides(spark, d)
    return state.cas_results(stored, incoming, gone, "user_id", "user_id").groupBy("result").agg(F.count("*").alias("n"))


def _catalog(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return p.withColumn("seq", F.lit(1).cast("long")).withColumn("deleted", F.col("p_partkey") % 7 == 0)


def catalog_merge(spark, d):
    return _merged(spark, d, 1_000_000)


def merged_with_new(spark, d):
    """The same merge where no new item has the key of one that is stored, however many there are."""
    low, high = table(spark, d, "part").agg(F.min("p_partkey"), F.max("p_partkey")).first()
    return _merged(spark, d, 0 if low is None else high - low + 1)


def _merged(spark, d, shift):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    new = p.where("p_partkey % 10 = 0").withColumn("p_partkey", F.col("p_partkey") + shift)
    changed = p.where("p_partkey % 2 = 0").withColumn("p_size", F.when(F.col("p_partkey") % 4 == 0, F.lit(None)).otherwise(F.col("p_size")))
    return state.merge_catalog(_catalog(spark, d), changed.unionByName(new), "p_partkey", ["p_brand", "p_size"])


def soft_delete(spark, d):
    return state.soft_delete(_catalog(spark, d), table(spark, d, "part").where("p_partkey % 3 = 0"), "p_partkey")


def content_hash(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", texts.content_hash(F.lit("v2"), F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("hash"), texts.explanation_key(F.lit("song"), F.lit("TRENDING"), F.lit(None), F.col("p_partkey")).alias("explanation"))


def pii_scrub(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.scrubbed(F.col("text")).alias("text"))


_LAST = "SELECT o_custkey AS user_id, max(o_orderkey) AS seq, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders WHERE {} GROUP BY ALL"
_SIDES = f"WITH st AS ({_LAST.format('o_orderkey % 3 = 0')}), inc AS ({_LAST.format('o_orderkey % 3 <> 0')})"
_CAT = "cat AS (SELECT p_partkey, p_brand, p_size, 1::BIGINT AS seq, p_partkey % 7 = 0 AS deleted FROM part)"
_SCRUBBED = "text"
for _pattern, _mark in texts.PERSONAL:
    _lookbehind = _pattern.startswith("(?<!")  # which DuckDB lacks: the character before is matched and put back
    _SCRUBBED = f"regexp_replace({_SCRUBBED}, '{_pattern.replace('(?<![' + chr(92) + 'w@])', '(^|[^' + chr(92) + 'w@])')}', '{chr(92) + '1' if _lookbehind else ''}{_mark}', 'g')"
_SCRUBBED = f"regexp_replace({_SCRUBBED}, '^[\\t-\\r ]+|[\\t-\\r ]+$', '', 'g')"
QUERIES = {
    "latest_per_key": (latest_per_key, _LAST.format("true")),
    "cas_upsert": (cas_upsert, f"{_LAST.format('o_custkey % 11 <> 0')}"),
    "cas_results": (cas_results, f"{_SIDES} SELECT CASE WHEN user_id % 11 = 0 THEN 'USER_DELETED' WHEN st.seq IS NULL OR inc.seq > st.seq THEN 'APPLIED' ELSE 'STALE' END AS result, count(*) AS n FROM inc LEFT JOIN st USING (user_id) GROUP BY ALL"),
    "catalog_merge": (
        catalog_merge,
        f"WITH {_CAT}, inc AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS p_size FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey + 1000000, p_brand, p_size FROM part WHERE p_partkey % 10 = 0), "
        "j AS (SELECT coalesce(c.p_partkey, i.p_partkey) AS p_partkey, CASE WHEN i.p_partkey IS NULL THEN c.p_brand ELSE i.p_brand END AS p_brand, CASE WHEN i.p_partkey IS NULL THEN c.p_size ELSE i.p_size END AS p_size, coalesce(seq, 0) AS s, deleted AS g, "
        "CASE WHEN c.p_partkey IS NULL THEN 'inserted' WHEN i.p_partkey IS NULL THEN 'kept' WHEN c.p_brand IS NOT DISTINCT FROM i.p_brand AND c.p_size IS NOT DISTINCT FROM i.p_size AND NOT deleted THEN 'unchanged' ELSE 'changed' END AS status FROM cat c FULL JOIN inc i ON c.p_partkey = i.p_partkey) "
        "SELECT p_partkey, p_brand, p_size, s + (status IN ('inserted', 'changed'))::BIGINT AS seq, CASE WHEN status IN ('inserted', 'changed') THEN false ELSE g END AS deleted, status FROM j",
    ),
    "soft_delete": (soft_delete, f"WITH {_CAT} SELECT p_partkey, p_brand, p_size, seq + (p_partkey % 3 = 0 AND NOT deleted)::BIGINT AS seq, deleted OR p_partkey % 3 = 0 AS deleted FROM cat"),
    "content_hash": (content_hash, "SELECT p_partkey, sha256(concat_ws('|', 'v2', p_name, p_brand, p_size)) AS hash, substr(sha256('song|TRENDING|null|' || p_partkey), 1, 24) AS explanation FROM part"),
    "pii_scrub": (pii_scrub, f"SELECT doc_id, {_SCRUBBED} AS text FROM documents"),
}
