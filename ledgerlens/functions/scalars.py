"""Column expressions shared by the operators; all stay inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN_CATEGORY = "nan"


def finite_or(c: Column, default: float = 0.0) -> Column:
    """Null, NaN and infinities become ``default``."""
    c = c.cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(c)


def ratio(num: Column, den: Column) -> Column:
    """``num/den`` with 0 where it is undefined (zero, null or infinite)."""
    return finite_or(F.try_divide(num.cast("double"), den.cast("double")))


def cyclic(c: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a cyclic value; null counts as 0."""
    angle = F.coalesce(c.cast("double"), F.lit(0.0)) * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def is_weekend(ts: Column) -> Column:
    return F.coalesce(F.weekday(ts) >= 5, F.lit(False))


def unix_seconds(ts: Column) -> Column:
    """Whole seconds since 1970, rounded down also before 1970."""
    return F.floor(F.unix_micros(ts) / F.lit(1_000_000)).cast("bigint")


def as_category(c: Column) -> Column:
    """Text form used by the category encoders; null is a category of its own."""
    return F.coalesce(c.cast("string"), F.lit(NAN_CATEGORY))


def smoothed_mean(total: Column, count: Column, prior: Column | float, alpha: float) -> Column:
    prior = prior if isinstance(prior, Column) else F.lit(float(prior))
    return (total + F.lit(float(alpha)) * prior) / (count + F.lit(float(alpha)))


def logit(c: Column, eps: float = 1e-6) -> Column:
    p = F.greatest(F.least(c, F.lit(1 - eps)), F.lit(eps))
    return F.ln(p / (1 - p))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def lenient_double(c: Column) -> Column:
    """Number or null, never an error."""
    return c.try_cast("double")


def lenient_timestamp(c: Column) -> Column:
    """ISO timestamp (with or without offset) or null, never an error."""
    return F.try_to_timestamp(c)


def epoch_timestamp(c: Column) -> Column:
    """Seconds since 1970, or milliseconds where the number is too large for seconds; null beyond year 9999."""
    number = finite_or(c.try_cast("double"), float("inf"))
    seconds = F.when(F.abs(number) > 2e10, number / 1000).otherwise(number)
    return F.when(F.abs(seconds) < 253_402_300_800, seconds.try_cast("timestamp"))


def wall_clock(iso: Column) -> Column:
    """Local time as written in an ISO string, its offset ignored."""
    return F.substring(F.regexp_replace(iso, "T", " "), 1, 19).try_cast("timestamp_ntz")


def money(c: Column) -> Column:
    """Exact form for sums that must not depend on the order of addition; null if it does not fit."""
    return c.try_cast("decimal(24,6)")


def json_payload(*cols: str | Column) -> Column:
    """JSON text of the given columns, nulls kept."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
