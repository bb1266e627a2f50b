"""Parameters of the engine: signal weights, half-lives, windows, ranking weights and business rules."""

from __future__ import annotations

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS

DOMAINS = ("song", "video", "book", "post")

# Weights and thresholds of engagement signals by domain. A threshold of 0 switches its rule off.
FLAT_WEIGHTS = {
    "song": {"SAVE": 2.0, "LIKE": 1.5, "SHARE": 1.5, "REPLAY": 1.2, "COMMENT": 1.0, "SEARCH_RESULT_CLICK": 0.3, "DISLIKE": -2.0, "NOT_INTERESTED": -3.0},
    "video": {"SHARE": 1.5, "LIKE": 1.2, "SAVE": 1.2, "COMMENT": 1.0, "DISLIKE": -2.0, "NOT_INTERESTED": -3.0},
    "book": {"SAVE": 1.2, "LIKE": 1.0, "SHARE": 1.2, "CLICK": 0.2, "DISLIKE": -1.5, "NOT_INTERESTED": -3.0},
    "post": {"COMMENT": 1.5, "SHARE": 1.5, "SAVE": 1.2, "LIKE": 0.8, "CLICK": 0.2, "DISLIKE": -1.5, "NOT_INTERESTED": -3.0},
}
RULES = {
    #                    song  video  book  post
    "complete_ratio": (0.9, 0.9, 0.0, 0.0),
    "complete_weight": (1.0, 1.5, 0.0, 0.0),
    "listened_seconds": (30.0, 30.0, 0.0, 0.0),
    "listened_ratio": (0.0, 0.25, 0.0, 0.0),
    "listened_weight": (0.4, 0.5, 0.0, 0.0),
    "abandon_ratio": (0.0, 0.1, 0.0, 0.0),
    "abandon_weight": (0.0, -0.5, 0.0, 0.0),
    "early_skip_seconds": (10.0, 10.0, 0.0, 0.0),
    "early_skip_weight": (-0.8, -0.5, 0.0, 0.0),
    "mid_skip_seconds": (30.0, 30.0, 0.0, 0.0),
    "mid_skip_weight": (-0.3, -0.2, 0.0, 0.0),
    "late_skip_ratio": (0.5, 0.5, 0.0, 0.0),
    "late_skip_weight": (0.2, 0.2, 0.0, 0.0),
    "browsing_factor": (0.5, 0.5, 1.0, 1.0),
    "seek_ratio": (0.3, 0.3, 0.0, 0.0),
    "seek_weight": (-0.1, -0.1, 0.0, 0.0),
    "dwell_seconds": (0.0, 0.0, 20.0, 5.0),
    "dwell_weight": (0.0, 0.0, 0.3, 0.3),
    "short_dwell_seconds": (0.0, 0.0, 0.0, 1.0),
    "short_dwell_weight": (0.0, 0.0, 0.0, -0.05),
    "follow_weight": (1.0, 1.0, 1.0, 1.0),
    "weight_per_star": (0.75, 0.75, 1.0, 0.75),
}

# Half-lives, windows and limits.
SHORT_HALF_LIFE = 2 * HOUR_MS
LONG_HALF_LIFE = 30 * DAY_MS
CROSS_HALF_LIFE = 7 * DAY_MS
AFFINITY_HALF_LIFE = 6 * HOUR_MS
ITEM_HALF_LIFE = 24 * HOUR_MS
NEIGHBOR_HALF_LIFE = 7 * DAY_MS
MAX_LATENESS = 24 * HOUR_MS
DEDUPE_WINDOW = 24 * HOUR_MS
ATTRIBUTION_WINDOW = HOUR_MS // 2
TRENDING_WINDOW = HOUR_MS // 4
CONSUMED_WINDOWS = {"song": 2 * HOUR_MS, "video": 30 * DAY_MS, "book": 365 * DAY_MS, "post": 30 * DAY_MS}
NEGATIVE_CAP = 0.3
RECENT_MAX, LIKED_MAX, SUPPRESSED_MAX, CONSUMED_MAX, AFFINITY_MAX = 50, 200, 500, 500, 50
SESSION_POSITIVES, CO_EMITS_MAX, CO_MIN_WEIGHT = 5, 200, 0.4
NEIGHBOR_TOP, NEIGHBOR_SUPPORT = 50, 2.0
TRENDING_TOP = 500
BROWSE_SKIPS, BROWSE_WINDOW_MS = 3, 30_000
CTR_PRIOR, RATE_PRIOR = (1.0, 10.0), (1.0, 2.0)
SUPPRESSING, SUPPRESSING_CREATORS, CREATOR_SUPPRESSION = ("DISLIKE", "NOT_INTERESTED"), ("NOT_INTERESTED",), 30 * DAY_MS
LIKED_ONCE = ("video", "book", "post")
CONSUMING = ("PLAY_START", "PLAY_END", "SKIP", "REPLAY", "CLICK", "RATE")
ENGAGING = ("PLAY_END", "LIKE", "SAVE", "SHARE", "REPLAY", "COMMENT", "RATE", "DWELL")

# Retrieval, ranking and re-ranking.
BLEND = {"short": 0.6, "long": 0.25, "cross": 0.15}
CANDIDATES = {"semantic": 120, "fresh": 30, "cf_seeds": 5, "cf": 30, "next": 100, "trending": 50}
RANK_WEIGHTS = {"semantic": 0.45, "cf": 0.15, "next": 0.10, "affinity": 0.10, "popular": 0.08, "completion": 0.07, "freshness": 0.05, "penalty": -0.15}
FEATURES = ("semantic", "cf", "next", "affinity", "trending", "ctr", "completion", "freshness", "penalty")
RERANK = {"artist_window": 2, "per_ten": 3, "genre_lambda": 0.8, "fresh_window": 14 * DAY_MS, "fresh_boost": 0.1, "familiar_share": 0.3, "epsilon": 0.08, "explore_min": 8, "low_impressions": 20}
GRADES = {"SAVED": 4, "LIKED": 3, "COMPLETED": 2, "PLAYED": 1}
OUTCOMES = ("IMPRESSED", "PLAYED", "COMPLETED", "LIKED", "SAVED", "SKIPPED_EARLY", "DISLIKED", "NONE")
EVENT_TYPES = (
    "IMPRESSION", "CLICK", "PLAY_START", "PLAY_END", "PAUSE", "SKIP", "SEEK", "REPLAY", "LIKE", "DISLIKE", "SAVE", "SHARE", "COMMENT",
    "RATE", "DWELL", "FOLLOW", "SEARCH", "SEARCH_RESULT_CLICK", "NOT_INTERESTED",
)
