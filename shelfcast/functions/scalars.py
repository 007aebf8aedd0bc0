"""Column expressions shared by the operators. All stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def log_demand(demand: Column) -> Column:
    """``log(demand + 1)``; NULL for demand of -1 or less, which the callers filter out first."""
    return F.log1p(demand)


def log_target(demand: Column) -> Column:
    """Training target: log demand, never below zero."""
    return F.greatest(log_demand(demand), F.lit(0.0))


def from_log(prediction: Column) -> Column:
    """Undo the log target. The prediction is rounded to ten places first."""
    return F.exp(F.round(prediction, 10)) - 1


def clean_prediction(prediction: Column, negative: float = 0.0, cap: float | None = None) -> Column:
    """Replace negatives by ``negative`` and limit the rest to ``cap``."""
    cleaned = F.when(prediction < 0, F.lit(float(negative)))
    if cap is not None:
        cleaned = cleaned.when(prediction > cap, F.lit(float(cap)))
    return cleaned.otherwise(prediction)


def capped(value: Column, high: float) -> Column:
    """Limit from above; NULL stays NULL (``least`` alone would turn it into the limit)."""
    return F.when(value > high, F.lit(high)).otherwise(value)


def known(value: Column) -> Column:
    """NaN counts as missing, so that a later ``coalesce`` falls through it."""
    return F.when(~F.isnan(value), value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL on a zero denominator under ANSI mode."""
    return F.try_divide(numerator, denominator)


def strict(aggregate: Column, value: Column) -> Column:
    """The aggregate, or NULL as soon as one input of the group is missing."""
    return F.when(F.count(value) == F.count(F.lit(1)), aggregate)


def label_thousands(value: Column) -> Column:
    """Axis label such as ``1.5 k``: the value in thousands without trailing zeros."""
    thousands = (value / 1000).cast("decimal(20,3)").cast("string")
    return F.concat_ws(" ", F.regexp_replace(thousands, r"\.?0+$", ""), F.lit("k"))


def midpoint(left: Column, right: Column) -> Column:
    """Half-way between two predictions."""
    return right - (right - left) / 2


def hash_text(key: Column, salt: str = "") -> Column:
    """Hexadecimal hash of a row key; another ``salt`` gives an independent draw."""
    text = key.cast("string")
    return F.md5(F.concat(text, F.lit(salt)) if salt else text)


def hash_bucket(key: Column, salt: str = "", buckets: int = 10_000) -> Column:
    """A reproducible number in ``[0, buckets)``, the same on every engine with MD5."""
    return F.conv(F.substring(hash_text(key, salt), 1, 8), 16, 10).cast("bigint") % buckets
