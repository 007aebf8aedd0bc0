"""Row filters, samples, caps and fills."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from shelfcast.functions.scalars import capped, hash_bucket, hash_text
from shelfcast.session import cut_lineage

# Hexadecimal digits by which an exact sample narrows its cut-off, and rows it ranks at the end.
DIGITS = 4
FEW_ROWS = 1000


def in_demand_range(low: float = -1, high: float = 5000, low_open: bool = True, high_open: bool = False) -> Column:
    """Whether demand is in the range; both ends can be open or closed."""
    demand = F.col("demand")
    above = demand > low if low_open else demand >= low
    below = demand < high if high_open else demand <= high
    return above & below


def demand_between(
    df: DataFrame, low: float = -1, high: float = 5000, low_open: bool = True, high_open: bool = False
) -> DataFrame:
    """Keep rows with demand in the range."""
    return df.where(in_demand_range(low, high, low_open, high_open))


def holdout_week(df: DataFrame, week: int = 9) -> DataFrame:
    return df.where(F.col("week") == week)


def week_range(df: DataFrame, after: int = 5, last: int = 9) -> DataFrame:
    """Weeks in ``(after, last]``; on a table laid out by week this prunes folders."""
    return df.where((F.col("week") > after) & (F.col("week") <= last))


def for_clients(df: DataFrame, client_ids: Iterable[int]) -> DataFrame:
    return df.where(F.col("client_id").isin(*client_ids))


def hash_sample(df: DataFrame, fraction: float, key: str = "id", salt: str = "") -> DataFrame:
    """About ``fraction`` of the rows, chosen by key hash: no shuffle, same rows on every run."""
    return df.where(hash_bucket(F.col(key), salt) < round(fraction * 10_000))


def exact_sample(df: DataFrame, fraction: float, key: str = "id", salt: str = "") -> DataFrame:
    """Exactly ``round(fraction * n)`` rows (half to even): those with the lowest key hashes.

    ``key`` must be unique. Hashes and keys are written once. Counts per leading hash digits find the bucket in which
    the quota runs out, and counts per further digits the bucket inside it, until it has few rows; the driver gets at
    most ``16 ** DIGITS`` counts at a time. The rows are then chosen by a filter against the cut-off; nothing is sorted.
    """
    drawn = cut_lineage(df.select(hash_text(F.col(key), salt).alias("drawn"), F.col(key).alias("key")))
    quota, prefix, inside = round(fraction * drawn.count()), "", None
    if quota <= 0:
        return df.limit(0)
    while inside is None or inside > FEW_ROWS and len(prefix) < 32:
        own = drawn.where(F.col("drawn").startswith(prefix))
        counts = own.groupBy(F.substring("drawn", 1, len(prefix) + DIGITS).alias("digits")).agg(F.count("*").alias("n"))
        for digits, n in sorted(map(tuple, counts.collect())):
            if quota <= n:
                prefix, inside = digits, n
                break
            quota -= n
    rows = drawn.where(F.col("drawn").startswith(prefix)).orderBy("drawn", "key").limit(quota)
    last = rows.orderBy(F.desc("drawn"), F.desc("key")).first()
    hashed = hash_text(F.col(key), salt)
    return df.where((hashed < last["drawn"]) | ((hashed == last["drawn"]) & (F.col(key) <= last["key"])))


def hash_split(df: DataFrame, fraction: float = 0.7, key: str = "idx", salt: str = "") -> tuple[DataFrame, DataFrame]:
    """Train and validation rows by key hash; every row lands in exactly one side."""
    inside = hash_bucket(F.col(key), salt) < round(fraction * 10_000)
    return df.where(inside), df.where(~inside)


def cap(df: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """Limit columns from above; missing values stay missing."""
    return df.withColumns({c: capped(F.col(c), high) for c, high in limits.items()})


def fill_features(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return df.fillna(dict(values))


def fill_from(df: DataFrame, columns: Iterable[str], other: str) -> DataFrame:
    """Fill each column from ``other`` on the same row."""
    return df.withColumns({c: F.coalesce(c, other) for c in columns})


def fill_median(df: DataFrame, column: str) -> DataFrame:
    """Fill a whole-number column with its overall median.

    Rows are counted per value before the median, so its only task sees distinct values, not rows.
    """
    per_value = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    median = per_value.agg(F.percentile(column, 0.5, F.col("n")).alias("median"))
    return df.withColumn(column, F.coalesce(F.col(column).cast("double"), median.scalar()))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))
