"""Number and time expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dbl(x: float | int) -> Column:
    return F.lit(float(x))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(dbl(low), F.least(dbl(high), x))


def clip01(x: Column) -> Column:
    """Clamp to [0, 1]; null, NaN and both infinities become 0."""
    x = x.cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == dbl(float("inf")))
    return F.when(bad, dbl(0)).otherwise(clip(x))


def r6(x: Column) -> Column:
    """Round to six places for comparison; adding zero removes a negative zero."""
    return F.round(x.cast("double"), 6) + dbl(0)


def round_decimal(x: Column, digits: int) -> Column:
    """Round to ``digits`` places by the exact binary value, ties to even.

    Spark rounds the shortest decimal text of a double, so 0.575 would go up although it
    is stored just below the tie. The scaled product is split into itself and its exact
    rounding error, and the error settles apparent ties.
    """
    m = dbl(10.0**digits)
    x = x.cast("double")
    p = x * m
    wide = dbl(134_217_729) * x
    high = wide - (wide - x)
    error = (high * m - p) + (x - high) * m
    low = F.floor(p).cast("double")
    tie = (p - low == 0.5) & (error != 0)
    return F.when(tie, F.when(error > 0, low + 1).otherwise(low)).otherwise(F.rint(p)) / m


def presentation_ms(seconds: Column) -> Column:
    """Seconds to integer milliseconds, half up. Negative instants give null."""
    return F.when(seconds >= 0, F.floor(seconds * dbl(1000) + dbl(0.5)).cast("bigint"))


def duration_ms(seconds: Column) -> Column:
    """As ``presentation_ms`` but zero is not a duration."""
    ms = presentation_ms(seconds)
    return F.when(ms > 0, ms)


def frame_duration_ms(numerator: Column, denominator: Column) -> Column:
    """Milliseconds per frame of a rational rate, at least 1."""
    ms = F.floor(dbl(1000) * denominator / numerator + dbl(0.5)).cast("bigint")
    return F.greatest(F.lit(1).cast("bigint"), ms)


def int_div(a: Column, b: int | Column) -> Column:
    """Floor of a non-negative integer quotient, kept integral."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.floor((a - F.pmod(a, b)) / b).cast("bigint")


def midpoint(a: Column, b: Column) -> Column:
    return a + F.floor((b - a) / 2).cast("bigint")


def to_epoch_tick(ts: Column, origin: str, seconds_per_tick: int) -> Column:
    """Whole ticks since ``origin`` for a timestamp without zone."""
    secs = F.timestamp_diff("SECOND", F.lit(origin).cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
    return F.floor(secs / F.lit(seconds_per_tick)).cast("bigint")
