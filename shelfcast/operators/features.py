"""Weekly demand features and the model-ready table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from shelfcast.functions.scalars import log_target
from shelfcast.operators.skew import find_hot_keys, lookup_join
from shelfcast.schema import PAIR

STATS = ("total", "mean", "median")
LAGS = (1, 2, 3)
# The category of an unknown brand and the default of a missing product mean.
UNKNOWN_BRAND = 16
DEFAULT_PRODUCT_MEAN = 7.0


@dataclass(frozen=True)
class Grain:
    """One level of weekly statistics: its name in columns and its keys besides the week."""

    prefix: str
    keys: tuple[str, ...]


# The four levels of weekly features.
PAIR_WEEK = Grain("pcw", PAIR)
CLIENT_WEEK = Grain("c", ("client_id",))
PRODUCT_ROUTE_WEEK = Grain("pr", ("product_id", "route_id"))
ROUTE_WEEK = Grain("r", ("route_id",))


def demand_counts(sales: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key and demand value.

    Every statistic below follows from these counts. Demand is a whole number in a bounded range, so
    a key that owns a third of all rows still has few of them after the map-side combine, and an
    exact median never has to gather its rows. Keys are declared non-null; stating it gives all users
    of the same counts the same plan, so that Spark shuffles the sales rows once for them.
    """
    complete = sales.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    return complete.groupBy(*keys, "demand").agg(F.count("*").alias("n"))


def dealt_counts(sales: DataFrame, keys: Sequence[str], hot: Mapping[tuple[str, ...], DataFrame]) -> DataFrame:
    """``demand_counts`` per key and week, dealt by the key, from one shuffle.

    Rows are counted where they land. Those of hot keys, as far as ``hot`` names them, are counted beforehand, so that no
    task sees their rows.
    """
    keys, names = list(keys), [*keys, "week"]
    complete = sales.where(reduce(and_, [F.col(k).isNotNull() for k in names])).select(*names, "demand")
    if tuple(keys) not in hot:
        return complete.repartition(*keys).groupBy(*names, "demand").agg(F.count("*").alias("n"))
    marks = F.broadcast(hot[tuple(keys)].select(*keys))
    many = demand_counts(complete.join(marks, keys, "left_semi"), names)
    few = complete.join(marks, keys, "left_anti").withColumn("n", F.lit(1).cast("long"))
    return roll_up(few.unionByName(many).repartition(*keys), names)


def roll_up(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts on coarser keys, without another pass over the sales rows."""
    return counts.groupBy(*keys, "demand").agg(F.sum("n").alias("n"))


def demand_stats(counts: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """Total, mean and median demand per key, from ``demand_counts`` on the same or finer keys."""
    total = F.sum(F.col("demand") * F.col("n"))
    return counts.groupBy(*keys).agg(
        total.alias(f"{prefix}_total"),
        (total / F.sum("n")).alias(f"{prefix}_mean"),
        F.percentile("demand", 0.5, F.col("n")).alias(f"{prefix}_median"),
        F.sum("n").alias("rows"),
    )


def weekly_stats(sales: DataFrame, grain: Grain, approximate: bool = False) -> DataFrame:
    """Total, mean and median demand per key and week.

    ``approximate`` takes the median from Spark's quantile sketch over the raw rows, for demand that
    is not a bounded whole number.
    """
    keys = [*grain.keys, "week"]
    if approximate:
        return sales.groupBy(*keys).agg(
            F.sum("demand").alias(f"{grain.prefix}_total"),
            F.avg("demand").alias(f"{grain.prefix}_mean"),
            F.percentile_approx("demand", 0.5).cast("double").alias(f"{grain.prefix}_median"),
        )
    return demand_stats(demand_counts(sales, keys), keys, grain.prefix).drop("rows")


def pair_totals(pair_counts: DataFrame) -> DataFrame:
    stats = demand_stats(pair_counts, PAIR, "pc")
    return stats.withColumn("multi", (F.col("rows") >= 2).cast("int")).drop("rows")


def pair_stats(sales: DataFrame) -> DataFrame:
    """Statistics of a product-client pair over all weeks; ``multi`` is 1 from two rows on."""
    return pair_totals(demand_counts(sales, [*PAIR, "week"]))


def weekly_lookup(weekly: DataFrame, grain: Grain, stats: Sequence[str] = STATS) -> DataFrame:
    """One row per key with a map from week to its statistics.

    The input has one row per key and week, so a map has as many entries as there are weeks. One
    join to this table replaces a join per lag.
    """
    entry = F.struct("week", F.struct(*[F.col(f"{grain.prefix}_{s}").alias(s) for s in stats]))
    return weekly.groupBy(*grain.keys).agg(
        F.map_from_entries(F.collect_list(entry)).alias(f"{grain.prefix}_weeks")
    )


def lag_week(lag: int, last_known_week: int | None = None) -> Column:
    """The week a lag points to. When forecasting, lag 1 never points past the last known week."""
    week = F.col("week") - lag
    return F.least(week, F.lit(last_known_week)) if last_known_week is not None and lag == 1 else week


def lag_weeks(df: DataFrame, lags: Sequence[int] = LAGS, last_known_week: int | None = None) -> DataFrame:
    return df.withColumns({f"prev{k}": lag_week(k, last_known_week).cast("int") for k in lags})


def lag_columns(grain: Grain, stats: Sequence[str] = STATS, lags: Sequence[int] = LAGS) -> list[str]:
    return [f"{grain.prefix}{k}_{s}" for k in lags for s in stats]


def read_lags(
    df: DataFrame,
    grain: Grain,
    stats: Sequence[str] = STATS,
    lags: Sequence[int] = LAGS,
    last_known_week: int | None = None,
) -> DataFrame:
    """Turn the joined week map into one column per lag and statistic."""
    weeks = F.col(f"{grain.prefix}_weeks")
    found = {k: F.try_element_at(weeks, lag_week(k, last_known_week)) for k in lags}
    columns = {f"{grain.prefix}{k}_{s}": found[k][s] for k in lags for s in stats}
    return df.withColumns(columns).drop(f"{grain.prefix}_weeks")


def attach_lags(
    df: DataFrame,
    weekly: DataFrame,
    grain: Grain,
    stats: Sequence[str] = STATS,
    lags: Sequence[int] = LAGS,
    last_known_week: int | None = None,
    hot: Mapping[tuple[str, ...], DataFrame] | None = None,
) -> DataFrame:
    """Add earlier weeks' statistics of the row's own key; NULL where that week had no sales."""
    joined = lookup_join(df, weekly_lookup(weekly, grain, stats), grain.keys, hot)
    return read_lags(joined, grain, stats, lags, last_known_week)


def attach_brand(df: DataFrame, brands: DataFrame) -> DataFrame:
    return df.join(brands, "product_id", "left")


def brand_feature(df: DataFrame, brands: DataFrame, unknown: int = UNKNOWN_BRAND) -> DataFrame:
    """Brand category; a product without brand, or missing from the table, is ``unknown``."""
    category = F.when(F.col("brand").isNull(), F.lit(unknown)).otherwise(F.col("cat_brand"))
    return attach_brand(df, brands).withColumn("cat_brand", category).drop("brand")


def keys_repeat(df: DataFrame, key: str) -> bool:
    """Whether a key has several rows; a join to such a table repeats rows even where nothing is read from it."""
    return not df.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) & F.col(key).isNotNull()).isEmpty()


def attach_pair_features(
    df: DataFrame, pairs: DataFrame, hot: Mapping[tuple[str, ...], DataFrame] | None = None
) -> DataFrame:
    return lookup_join(df, pairs, PAIR, hot)


@dataclass(frozen=True)
class FeatureTables:
    """The feature tables of one history, as they are stored between runs."""

    pair: DataFrame
    pair_week: DataFrame
    client_week: DataFrame
    product_route_week: DataFrame
    route_week: DataFrame
    brands: DataFrame


def build_features(history: DataFrame, brands: DataFrame, written: bool = False) -> FeatureTables:
    """All feature tables from two passes over the history.

    The pair counts also give the pair's overall and the client's weekly statistics; the
    product-route counts also give the route's. Counts, which are small for any key, are dealt by the grain's key without
    the week: its weekly statistics, its week map and the join to rows then need no further shuffle.

    ``written`` tells that the history is a plain scan. Passes over it move nothing then, so its hot keys are looked up
    and all others are dealt by the grain's key at once, for each grain but the route.
    """
    if written:
        hot = find_hot_keys(history, [PAIR, CLIENT_WEEK.keys, PRODUCT_ROUTE_WEEK.keys])
        pairs, routes = dealt_counts(history, PAIR, hot), dealt_counts(history, PRODUCT_ROUTE_WEEK.keys, hot)
        # The coarser grains are over the rows of the finer ones, which have a product.
        complete = history.where(F.col("product_id").isNotNull())
        clients = dealt_counts(complete, CLIENT_WEEK.keys, hot)
        by_route = demand_counts(complete, [*ROUTE_WEEK.keys, "week"])

        def stats(counts: DataFrame, grain: Grain) -> DataFrame:
            return demand_stats(counts, [*grain.keys, "week"], grain.prefix).drop("rows")

        return FeatureTables(
            pair=pair_totals(pairs),
            pair_week=stats(pairs, PAIR_WEEK),
            client_week=stats(clients, CLIENT_WEEK),
            product_route_week=stats(routes, PRODUCT_ROUTE_WEEK),
            route_week=stats(by_route, ROUTE_WEEK),
            brands=brands,
        )
    pair_counts = demand_counts(history, [*PAIR, "week"])
    route_counts = demand_counts(history, [*PRODUCT_ROUTE_WEEK.keys, "week"])

    def weekly(counts: DataFrame, grain: Grain, coarser: bool = False) -> DataFrame:
        keys = [*grain.keys, "week"]
        own = roll_up(counts, keys) if coarser else counts
        # Routes are few beside their rows: partial statistics are smaller than their counts.
        own = own if grain == ROUTE_WEEK else own.repartition(*grain.keys)
        return demand_stats(own, keys, grain.prefix).drop("rows")

    return FeatureTables(
        pair=pair_totals(pair_counts.repartition(*PAIR)),
        pair_week=weekly(pair_counts, PAIR_WEEK),
        client_week=weekly(pair_counts, CLIENT_WEEK, coarser=True),
        product_route_week=weekly(route_counts, PRODUCT_ROUTE_WEEK),
        route_week=weekly(route_counts, ROUTE_WEEK, coarser=True),
        brands=brands,
    )


PAIR_COLUMNS = ("multi", "pc_total", "pc_mean", "pc_median")
LAG_MEDIANS = tuple(
    c
    for grain in (PAIR_WEEK, CLIENT_WEEK, PRODUCT_ROUTE_WEEK, ROUTE_WEEK)
    for c in lag_columns(grain, ("median",))
)
# Features that are zero when there is no history. The totals and means of the client, route and
# product-route lags stay missing: no model reads them.
ZERO_FILLED: Mapping[str, float] = {
    c: 0 for c in (*PAIR_COLUMNS, *lag_columns(PAIR_WEEK), *LAG_MEDIANS)
}


FEATURE_KEYS = tuple(g.keys for g in (PAIR_WEEK, CLIENT_WEEK, PRODUCT_ROUTE_WEEK, ROUTE_WEEK))


def model_table(
    rows: DataFrame,
    features: FeatureTables,
    last_known_week: int | None = None,
    stats: Sequence[str] = STATS,
    hot: Mapping[tuple[str, ...], DataFrame] | None = None,
    needed: Sequence[str] | None = None,
) -> DataFrame:
    """Attach every feature to training or request rows; row count and ``id`` are unchanged.

    ``last_known_week`` marks request rows. The pair's weekly map and its overall statistics share
    their keys, so they meet before the join and the rows shuffle once for both. ``hot`` holds the
    rows' hot keys, which are split. ``needed`` names the features that will be read: rows are not moved to meet lags
    that are not among them nor a brand that is not, and other statistics are left out.
    """

    def read(grain: Grain, of: Sequence[str]) -> list[str]:
        return [s for s in of if needed is None or set(lag_columns(grain, (s,))) & set(needed)]

    pair_read = read(PAIR_WEEK, STATS)
    pair = features.pair
    if pair_read:
        pair = weekly_lookup(features.pair_week, PAIR_WEEK, pair_read).join(pair, list(PAIR))
    df = rows.withColumn("channel_id", F.lit(1.0))
    if needed is None or "cat_brand" in needed or keys_repeat(features.brands, "product_id"):
        df = brand_feature(df, features.brands)

    def with_lags(df: DataFrame, grain: Grain, weekly: DataFrame) -> DataFrame:
        own = read(grain, stats)
        return attach_lags(df, weekly, grain, own, last_known_week=last_known_week, hot=hot) if own else df

    # Rows get wider with each lookup. Lags of product and route are mostly missing, so they come first; the client's
    # are seldom missing and come last.
    df = with_lags(df, PRODUCT_ROUTE_WEEK, features.product_route_week)
    df = attach_pair_features(df, pair, hot)
    if pair_read:
        df = read_lags(df, PAIR_WEEK, pair_read, last_known_week=last_known_week)
    df = with_lags(df, ROUTE_WEEK, features.route_week)
    df = with_lags(df, CLIENT_WEEK, features.client_week)
    lags = {g: lag_columns(g, read(g, stats)) for g in (CLIENT_WEEK, PRODUCT_ROUTE_WEEK, ROUTE_WEEK)}
    late = [c for columns in lags.values() for c in columns]
    df = df.select(*[c for c in df.columns if c not in late], *late)
    df = df.fillna({c: v for c, v in ZERO_FILLED.items() if c in df.columns})
    return df.withColumn("target", log_target(F.col("demand"))) if "demand" in df.columns else df
