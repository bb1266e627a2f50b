"""Scalar expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round4(x: Column) -> Column:
    """Four decimals, ties towards plus infinity (Spark's own round goes away from zero)."""
    return F.floor(x * 10000 + 0.5) / 10000


def epoch_ms(ts: str) -> Column:
    """Milliseconds of a timestamp without time zone, whatever zone the session has."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def decay(weight: Column, age_ms: Column, half_life_ms: int) -> Column:
    """What is left of a weight after its age; an age below zero takes nothing."""
    return weight * F.pow(F.lit(2.0), -F.greatest(age_ms, F.lit(0)) / float(half_life_ms))


def is_id(x: Column) -> Column:
    return x.rlike(r"^[A-Za-z0-9_.:-]{1,64}$")


def is_blank(x: Column) -> Column:
    """Nothing but white space of any kind, no-break spaces aside."""
    return x.rlike(r"\A\p{javaWhitespace}*\z")
