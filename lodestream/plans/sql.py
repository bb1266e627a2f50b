"""The same tables and expressions for DuckDB, as common table expressions of the queries' SQL."""

from __future__ import annotations

from .. import config
from ..sources import views


def pick(values, index: str) -> str:
    return "CASE " + " ".join(f"WHEN ({index}) = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def cases(mapping: dict, of: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


_ITEM = "CAST(regexp_extract(props, '[0-9]+') AS BIGINT)"
EV = f"""ev AS (
  SELECT event_id, user_id, {_ITEM} AS item_id, {pick(config.DOMAINS, f"{_ITEM} % 4")} AS domain, {cases(views.TYPES, "event_type")} AS event_type,
    value, epoch_us(ts) // 1000 AS ts, epoch_us(ts) // 1000 AS received_ts, CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id,
    {pick(views.COUNTRIES, "user_id % 6")} AS country, event_id % 2 = 0 AS autoplay, CAST(30000 * (1 + {_ITEM} % 5) AS BIGINT) AS duration_ms,
    CAST(NULL AS BIGINT) AS position_ms, CAST(NULL AS BIGINT) AS seek_from_ms, CAST(NULL AS BIGINT) AS seek_to_ms
  FROM events)"""
ITEM = f"""item AS (
  SELECT vec_id AS item_id, {pick(config.DOMAINS, "vec_id % 4")} AS domain, embedding AS vector, CAST(label AS BIGINT) AS genre, p_brand AS creator_id, p_type AS mood, p_name AS title,
    CAST(DATE '2023-11-01' + CAST(p_size AS INTEGER) AS DATE) AS release_date, coalesce(p_size % 7 = 0, false) AS explicit, [{pick(views.COUNTRIES, "vec_id % 6")}, 'US'] AS regions
  FROM embeddings LEFT JOIN part ON vec_id = p_partkey)"""
_LINES = """line AS (
  SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey
    ORDER BY l_linenumber, l_suppkey, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) = 1)"""
SERVED = f"""{_LINES}, served AS (
  SELECT o_orderkey AS recommendation_id, o_custkey AS user_id, l_partkey AS item_id, l_linenumber - 1 AS position,
    CASE WHEN (o_custkey // 4) % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant_id, {pick(config.DOMAINS, "o_custkey % 4")} AS domain, epoch_us(o_orderdate) // 1000 AS served_ts, l_discount AS score,
    l_quantity / 50 AS f_semantic, l_discount * 10 AS f_cf, l_suppkey % 5 / 5.0::DOUBLE AS f_next, l_suppkey % 7 / 7.0::DOUBLE AS f_affinity, l_suppkey % 3 / 3.0::DOUBLE AS f_trending, l_tax AS f_ctr,
    l_suppkey % 11 / 11.0::DOUBLE AS f_completion, l_suppkey % 13 / 13.0::DOUBLE AS f_freshness, CAST(l_suppkey % 2 AS DOUBLE) AS f_penalty
  FROM line JOIN orders ON l_orderkey = o_orderkey)"""
_OUTCOME = cases({a + b: v for (a, b), v in views.OUTCOMES.items()}, "l_returnflag || l_linestatus")
ATTRIBUTED = f"""attributed AS (
  SELECT DISTINCT * FROM (
    SELECT o_orderkey AS recommendation_id, l_partkey AS item_id, o_custkey AS user_id, l_linenumber - 1 AS position, CASE WHEN (o_custkey // 4) % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant_id,
      {pick(config.DOMAINS, "o_custkey % 4")} AS domain, unnest([{_OUTCOME}, 'IMPRESSED']) AS outcome, epoch_us(o_orderdate) // 1000 AS served_ts, epoch_us(l_shipdate) // 1000 AS outcome_ts
    FROM line JOIN orders ON l_orderkey = o_orderkey))"""


def rule(name: str) -> str:
    values = config.RULES[name]
    return "CASE domain " + " ".join(f"WHEN '{d}' THEN {v}::DOUBLE" for d, v in list(zip(config.DOMAINS, values))[1:]) + f" ELSE {values[0]}::DOUBLE END"


LISTENED = "coalesce(value, position_ms / 1000.0)"
COMPLETION = f"(CASE WHEN duration_ms > 0 THEN {LISTENED} * 1000.0::DOUBLE / duration_ms END)"
EARLY = f"coalesce(event_type = 'SKIP' AND {LISTENED} < {rule('early_skip_seconds')}, false)"
DWELT = f"coalesce(event_type = 'DWELL' AND {rule('dwell_seconds')} > 0 AND value >= {rule('dwell_seconds')}, false)"
COMPLETE = f"coalesce({rule('complete_ratio')} > 0 AND {COMPLETION} >= {rule('complete_ratio')}, false)"
CLASS = f"""CASE WHEN event_type = 'IMPRESSION' THEN 'IMPRESSION' WHEN event_type IN ('PLAY_START', 'CLICK') OR {DWELT} THEN 'START'
  WHEN event_type = 'SKIP' THEN CASE WHEN {EARLY} THEN 'EARLY_SKIP' ELSE 'SKIP' END
  WHEN event_type = 'PLAY_END' THEN CASE WHEN {COMPLETE} THEN 'COMPLETE' ELSE 'END' END ELSE 'OTHER' END"""
_FLAT = "CASE domain " + " ".join(f"WHEN '{d}' THEN CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in w.items()) + " ELSE 0.0::DOUBLE END" for d, w in config.FLAT_WEIGHTS.items()) + " END"


def weight(browsing: str = "false") -> str:
    return f"""CASE event_type
  WHEN 'PLAY_END' THEN CASE WHEN {COMPLETE} THEN {rule('complete_weight')} WHEN {rule('abandon_ratio')} > 0 AND {COMPLETION} < {rule('abandon_ratio')} THEN {rule('abandon_weight')}
    WHEN ({rule('listened_seconds')} > 0 AND {LISTENED} >= {rule('listened_seconds')}) OR ({rule('listened_ratio')} > 0 AND {COMPLETION} >= {rule('listened_ratio')}) THEN {rule('listened_weight')} ELSE 0.0::DOUBLE END
  WHEN 'SKIP' THEN CASE WHEN {LISTENED} IS NULL THEN {rule('mid_skip_weight')} WHEN {LISTENED} < {rule('early_skip_seconds')} THEN {rule('early_skip_weight')} * CASE WHEN {browsing} THEN {rule('browsing_factor')} ELSE 1.0::DOUBLE END
    WHEN {LISTENED} < {rule('mid_skip_seconds')} THEN {rule('mid_skip_weight')} WHEN {COMPLETION} >= {rule('late_skip_ratio')} THEN {rule('late_skip_weight')} ELSE 0.0::DOUBLE END
  WHEN 'DWELL' THEN CASE WHEN {DWELT} THEN {rule('dwell_weight')} WHEN {rule('short_dwell_seconds')} > 0 AND value < {rule('short_dwell_seconds')} THEN {rule('short_dwell_weight')} ELSE 0.0::DOUBLE END
  WHEN 'RATE' THEN coalesce((value - 3) * {rule('weight_per_star')}, 0.0::DOUBLE)
  WHEN 'SEEK' THEN 0.0::DOUBLE ELSE {_FLAT} END"""


def round4(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5) / 10000"


def decay(w: str, age: str, half_life: int) -> str:
    return f"({w}) * pow(2.0::DOUBLE, -greatest({age}, 0) / {float(half_life)!r}::DOUBLE)"


def cte(*parts: str) -> str:
    return "WITH " + ", ".join(parts)
