"""What an engagement event says: its weight, its class and its outcome, by domain.

All take the columns domain, event_type, value, position_ms, duration_ms, seek_from_ms and seek_to_ms of the
frame that they are used on. A domain that isn't known has the rules of the first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def rule(name: str) -> Column:
    values = config.RULES[name]
    out = F.when(F.col("domain") == config.DOMAINS[1], values[1])
    for domain, value in list(zip(config.DOMAINS, values))[2:]:
        out = out.when(F.col("domain") == domain, value)
    return out.otherwise(values[0])


def flat_weight() -> Column:
    chain = None
    for domain, weights in config.FLAT_WEIGHTS.items():
        here = F.col("domain") == domain
        if domain == config.DOMAINS[0]:
            here = ~F.col("domain").isin(*config.DOMAINS[1:]) | F.col("domain").isNull()
        for kind, weight in weights.items():
            test = here & (F.col("event_type") == kind)
            chain = F.when(test, weight) if chain is None else chain.when(test, weight)
    return chain.otherwise(0.0)


def listened() -> Column:
    return F.coalesce(F.col("value"), F.col("position_ms") / 1000.0)


def completion() -> Column:
    return F.when(F.col("duration_ms") > 0, listened() * 1000.0 / F.col("duration_ms"))


def early_skip() -> Column:
    return F.coalesce((F.col("event_type") == "SKIP") & (listened() < rule("early_skip_seconds")), F.lit(False))


def engaged_dwell() -> Column:
    return F.coalesce((F.col("event_type") == "DWELL") & (rule("dwell_seconds") > 0) & (F.col("value") >= rule("dwell_seconds")), F.lit(False))


def complete() -> Column:
    return F.coalesce((rule("complete_ratio") > 0) & (completion() >= rule("complete_ratio")), F.lit(False))


def weight(browsing: Column | None = None) -> Column:
    """The signal's weight; `browsing` softens an early skip."""
    browsing = F.lit(False) if browsing is None else browsing
    kind = F.col("event_type")
    heard = ((rule("listened_seconds") > 0) & (listened() >= rule("listened_seconds"))) | ((rule("listened_ratio") > 0) & (completion() >= rule("listened_ratio")))
    play_end = (
        F.when(complete(), rule("complete_weight"))
        .when((rule("abandon_ratio") > 0) & (completion() < rule("abandon_ratio")), rule("abandon_weight"))
        .when(heard, rule("listened_weight"))
        .otherwise(0.0)
    )
    skip = (
        F.when(listened().isNull(), rule("mid_skip_weight"))
        .when(listened() < rule("early_skip_seconds"), F.when(browsing, rule("early_skip_weight") * rule("browsing_factor")).otherwise(rule("early_skip_weight")))
        .when(listened() < rule("mid_skip_seconds"), rule("mid_skip_weight"))
        .when(completion() >= rule("late_skip_ratio"), rule("late_skip_weight"))
        .otherwise(0.0)
    )
    jump = F.when(F.col("duration_ms") > 0, (F.col("seek_to_ms") - F.col("seek_from_ms")) / F.col("duration_ms"))
    seek = F.when(jump > rule("seek_ratio"), rule("seek_weight")).otherwise(0.0)
    dwell = (
        F.when(engaged_dwell(), rule("dwell_weight"))
        .when((rule("short_dwell_seconds") > 0) & (F.col("value") < rule("short_dwell_seconds")), rule("short_dwell_weight"))
        .otherwise(0.0)
    )
    rate = F.coalesce((F.col("value") - 3) * rule("weight_per_star"), F.lit(0.0))
    return F.when(kind == "PLAY_END", play_end).when(kind == "SKIP", skip).when(kind == "SEEK", seek).when(kind == "DWELL", dwell).when(kind == "RATE", rate).otherwise(flat_weight())


def event_class() -> Column:
    """IMPRESSION, START, COMPLETE, END, EARLY_SKIP, SKIP or OTHER."""
    kind = F.col("event_type")
    return (
        F.when(kind == "IMPRESSION", "IMPRESSION")
        .when(kind.isin("PLAY_START", "CLICK") | engaged_dwell(), "START")
        .when(kind == "SKIP", F.when(early_skip(), "EARLY_SKIP").otherwise("SKIP"))
        .when(kind == "PLAY_END", F.when(complete(), "COMPLETE").otherwise("END"))
        .otherwise("OTHER")
    )


def outcome() -> Column:
    """What became of a shown item, or null."""
    kind = F.col("event_type")
    return (
        F.when(kind == "IMPRESSION", "IMPRESSED")
        .when(kind.isin("PLAY_START", "CLICK") | engaged_dwell(), "PLAYED")
        .when((kind == "RATE") & (F.col("value") >= 4), "LIKED")
        .when((kind == "RATE") & (F.col("value") <= 2), "DISLIKED")
        .when((kind == "PLAY_END") & complete(), "COMPLETED")
        .when(early_skip(), "SKIPPED_EARLY")
        .when(kind == "LIKE", "LIKED")
        .when(kind == "SAVE", "SAVED")
        .when(kind.isin("DISLIKE", "NOT_INTERESTED"), "DISLIKED")
    )
