"""Distinct counts and quantiles of any range of weeks, from small sketches that are stored once per week.

A week is read once: its sketches are made with partial aggregation, so a key that owns a third of the rows is a few
kilobytes before the shuffle, and stored by week (``sources.store.save_features``). A later range of weeks reads only
its folders and merges sketches; no sales row is read again.

Distinct counts are theta sketches: exact below ``2 ** entries`` values, beyond that with a relative standard error of
``1 / sqrt(2 ** entries)``, merges included; they also tell how many values two ranges share. Quantiles are KLL
sketches: the rank of the value given differs from the rank asked for by less than ``RANK_ERROR`` of the rows (at 99
percent confidence, for the default size). NULL values are not counted; a key with NULL values only has 0 and NULL.

Where counts of whole-number ids must be exact beyond a sketch, ``weekly_members`` stores bitmaps instead: a row of 4 KB
per week, key and 32,768 neighbouring ids that occur. They suit coarse keys, whose ids are dense.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

ENTRIES = 12
SIZE = 200
#: Of a KLL sketch of the default size.
RANK_ERROR = 0.0133


def weekly_sketches(
    sales: DataFrame, keys: Sequence[str], distinct: Sequence[str] = (), numbers: Sequence[str] = (), entries: int = ENTRIES, size: int = SIZE
) -> DataFrame:
    """``week``, the keys, ``<column>_seen`` per distinct column and ``<column>_spread`` per number."""
    seen = [F.theta_sketch_agg(F.col(c), entries).alias(f"{c}_seen") for c in distinct]
    spread = [F.kll_sketch_agg_double(F.col(c).cast("double"), size).alias(f"{c}_spread") for c in numbers]
    return sales.groupBy("week", *keys).agg(*seen, *spread)


def over_weeks(
    sketches: DataFrame, keys: Sequence[str], first: int, last: int, entries: int = ENTRIES, size: int = SIZE
) -> DataFrame:
    """The sketches of the weeks ``first`` to ``last`` merged, a row per key; ``keys`` may be fewer than the stored ones."""
    chosen = sketches.where(F.col("week").between(first, last))
    merged = [F.theta_union_agg(c, entries).alias(c) for c in sketches.columns if c.endswith("_seen")]
    merged += [F.kll_merge_agg_double(c, size).alias(c) for c in sketches.columns if c.endswith("_spread")]
    return chosen.groupBy(*keys).agg(*merged)


def count_of(column: str) -> Column:
    """Distinct values of a ``_seen`` sketch."""
    return F.coalesce(F.theta_sketch_estimate(column), F.lit(0).cast("long"))


def rows_of(column: str) -> Column:
    """Values that went into a ``_spread`` sketch."""
    return F.coalesce(F.kll_sketch_get_n_double(column), F.lit(0).cast("long"))


def quantile_of(column: str, share: float) -> Column:
    """The value at ``share`` of the rows of a ``_spread`` sketch, one of the values that went in."""
    return F.when(rows_of(column) > 0, F.kll_sketch_get_quantile_double(column, F.lit(share)))


def seen_again(early: DataFrame, late: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Per key of both: distinct values in ``early``, in ``late`` and in both."""
    name = f"{column}_seen"
    both = early.select(*keys, F.col(name).alias("_early")).join(late.select(*keys, F.col(name).alias("_late")), list(keys))
    shared = F.theta_sketch_estimate(F.theta_intersection("_early", "_late"))
    return both.select(*keys, count_of("_early").alias("early"), count_of("_late").alias("late"), shared.alias("both"))


def weekly_members(sales: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``week``, the keys, ``bucket`` and ``members``: exact sets of the whole-number ids in ``column``, as bitmaps.

    A key with NULL ids only keeps a row with an empty set, in the bucket NULL.
    """
    bucket = F.bitmap_bucket_number(F.col(column)).alias("bucket")
    return sales.groupBy("week", *keys, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(column))).alias("members"))


def members_over(members: DataFrame, keys: Sequence[str], early: tuple[int, int], late: tuple[int, int]) -> DataFrame:
    """Per key with rows in both ranges of weeks: exact distinct ids in ``early``, in ``late`` and in both.

    A bucket's sets are merged over its weeks, so no id is moved; ids in both are those of each less those of either.
    """
    ranges = {"early": F.col("week").between(*early), "late": F.col("week").between(*late)}
    known = {n: F.when(chosen & F.col("bucket").isNotNull(), F.col("members")) for n, chosen in ranges.items()}
    known["either"] = F.coalesce(*known.values())
    seen = {f"has_{n}": F.max(chosen).alias(f"has_{n}") for n, chosen in ranges.items()}
    sizes = [F.bitmap_count(F.bitmap_or_agg(c)).alias(n) for n, c in known.items()]
    buckets = members.groupBy(*keys, "bucket").agg(*sizes, *seen.values())
    totals = buckets.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in known], *[F.max(n).alias(n) for n in seen])
    both = totals.where(" AND ".join(["has_early", "has_late", *[f"{k} IS NOT NULL" for k in keys]]))
    return both.select(*keys, "early", "late", (F.col("early") + F.col("late") - F.col("either")).alias("both"))
