"""Back-off demand forecasts: group means on the log scale, answered by the finest known group."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from shelfcast.functions.scalars import hash_bucket, known, log_demand
from shelfcast.operators.filters import fill_from
from shelfcast.operators.features import DEFAULT_PRODUCT_MEAN
from shelfcast.operators.skew import lookup_join


@dataclass(frozen=True)
class Tier:
    """A group of sales rows whose log demand is averaged."""

    name: str
    keys: tuple[str, ...]
    stat: str = "mean"


@dataclass(frozen=True)
class Step:
    """One candidate answer: ``sum(scale * link(tier)) + offset``; missing if any tier is missing."""

    terms: tuple[tuple[str, float], ...]
    offset: float
    link: str = "exp"

    @property
    def label(self) -> str:
        return "+".join(name for name, _ in self.terms)

    def value(self) -> Column:
        link = {"exp": F.exp, "expm1": F.expm1}[self.link]
        parts = [link(known(F.col(name))) * scale for name, scale in self.terms]
        return sum(parts[1:], parts[0]) + self.offset


@dataclass(frozen=True)
class Fallback:
    """The answer for a row no tier knows: overall mean or median demand, shifted."""

    stat: str = "mean"
    offset: float = 0.0


@dataclass(frozen=True)
class Hierarchy:
    steps: tuple[Step, ...]
    fallback: Fallback

    def tier_names(self) -> set[str]:
        return {name for step in self.steps for name, _ in step.terms}


PCA = Tier("pca", ("product_id", "client_id", "agency_id"))
PCR = Tier("pcr", ("product_id", "client_id", "route_id"))
PR = Tier("pr", ("product_id", "route_id"))
PA = Tier("pa", ("product_id", "agency_id"))
P = Tier("p", ("product_id",))
R = Tier("r", ("route_id",))
C = Tier("c", ("client_id",))
PC = Tier("pc", ("product_id", "client_id"))
PC_MEDIAN = Tier("pc", ("product_id", "client_id"), "median")
TIERS = (PCA, PCR, PR, PA, P, C)


def _one(name: str, scale: float, offset: float, link: str = "exp") -> Step:
    return Step(((name, scale),), offset, link)


# Back-off orders, scales and offsets of the published forecasts.
_MEAN_LESS = Fallback("mean", -0.9)
HIER1 = Hierarchy((_one("pca", 0.70, 0.7), _one("pr", 0.76, 0.1), _one("p", 0.76, 0.25)), _MEAN_LESS)
HIER2 = Hierarchy((_one("pcr", 0.70, 0.7), _one("pa", 0.75, 0.1), _one("p", 0.76, 0.25)), _MEAN_LESS)
HIER3 = Hierarchy(
    (
        Step((("pca", 0.7173), ("pr", 0.1859)), 0.12, "expm1"),
        _one("pr", 0.741, 0.192, "expm1"),
        _one("c", 0.822, 0.855, "expm1"),
        _one("pa", 0.53, 0.95, "expm1"),
        _one("p", 0.49, 1.0, "expm1"),
    ),
    _MEAN_LESS,
)
HIER3_V1 = Hierarchy(
    (_one("pcr", 0.70, 0.7), _one("pa", 0.75, 0.1), _one("c", 0.76, 0.25), _one("p", 0.76, 0.25)),
    Fallback("mean"),
)
_MEDIAN = Fallback("median")
JULY_AB = Hierarchy((_one("pca", 0.75, 0.75), _one("pc", 0.8, 0.1), _one("p", 1.15, 0.25)), _MEDIAN)
JULY_C = Hierarchy((_one("pca", 0.75, 0.75), _one("pr", 0.8, 0.1), _one("p", 1.15, 0.25)), _MEDIAN)
HOLDOUT = Hierarchy((_one("pca", 0.7, 0.7), _one("pr", 0.8, 0.1), _one("p", 1.1, 0.25)), Fallback("mean"))
# Group-mean model inputs: the scaled means of the July forecast.
TIER_INPUTS = {"pca": (0.75, 0.75), "pr": (0.8, 0.1), "p": (1.15, 0.25)}
# Of further tiers, as they are.
PLAIN_INPUT = (1.0, 0.0)
INPUT_TIERS = (PCA, PR, P)


def fit_tiers(sales: DataFrame, tiers: Iterable[Tier] = TIERS) -> dict[str, DataFrame]:
    """One table per tier, keyed by its group.

    Mean tiers are rolled up from one shared table of sums and counts on the union of their keys. Ids
    are declared non-null; saying so here gives every tier the same plan below that table, and Spark
    then reads and shuffles the sales rows once for all of them. A tier on all these keys is that table itself: grouping
    it again would hold its groups three times in a task. A median tier first counts rows per
    demand value, which keeps a group that owns most rows small before its one task sees it.
    """
    tiers = list(tiers)
    means = [t for t in tiers if t.stat == "mean"]
    finest = list(dict.fromkeys(k for t in means for k in t.keys))
    value = log_demand(F.col("demand"))
    complete = sales.where(reduce(and_, [F.col(k).isNotNull() for k in finest])) if means else sales
    base = complete.groupBy(*finest).agg(F.sum(value).alias("s"), F.count(value).alias("n")) if means else None
    fitted = {}
    for tier in tiers:
        if tier.stat == "mean" and set(tier.keys) == set(finest):
            table = base.select(*tier.keys, (F.col("s") / F.col("n")).alias(tier.name))
        elif tier.stat == "mean":
            table = base.groupBy(*tier.keys).agg((F.sum("s") / F.sum("n")).alias(tier.name))
        else:
            counts = sales.groupBy(*tier.keys, "demand").agg(F.count("*").alias("n"))
            middle = F.percentile(value, 0.5, F.col("n"))
            table = counts.groupBy(*tier.keys).agg(middle.alias(tier.name))
        fitted[tier.name] = table
    return fitted


def global_level(sales: DataFrame, fallback: Fallback) -> DataFrame:
    """The fallback demand as a one-row table."""
    if fallback.stat == "mean":
        return sales.agg((F.avg("demand") + fallback.offset).alias("global_level"))
    counts = sales.groupBy("demand").agg(F.count("*").alias("n"))
    return counts.agg((F.percentile("demand", 0.5, F.col("n")) + fallback.offset).alias("global_level"))


def attach_tiers(
    requests: DataFrame, tiers: Mapping[str, DataFrame], hot: Mapping[tuple[str, ...], DataFrame] | None = None
) -> DataFrame:
    """Left join every tier table; keys are unique on the right, so no request row is repeated.

    No broadcast is forced: Spark broadcasts a tier whose measured size allows it and shuffles the
    others. The requests' hot keys, if given as ``hot``, are split.
    """
    keys = {name: tuple(c for c in table.columns if c != name) for name, table in tiers.items()}
    for name, table in tiers.items():
        requests = lookup_join(requests, table, keys[name], hot)
    return requests


def step_through(hierarchy: Hierarchy, level: Column) -> Column:
    """The first step whose tiers are all known, else the fallback."""
    return F.coalesce(*[step.value() for step in hierarchy.steps], level)


def answering_tier(hierarchy: Hierarchy) -> Column:
    """Which step answered the row."""
    label = F.lit("global")
    for step in reversed(hierarchy.steps):
        label = F.when(step.value().isNotNull(), F.lit(step.label)).otherwise(label)
    return label


def predict_hierarchies(
    requests: DataFrame,
    sales: DataFrame,
    hierarchies: Mapping[str, Hierarchy],
    tiers: Sequence[Tier] = TIERS,
    keep: Sequence[str] = ("id",),
    hot: Mapping[tuple[str, ...], DataFrame] | None = None,
) -> DataFrame:
    """One prediction column per hierarchy; the tiers they share are fitted and joined once."""
    used = set().union(*[h.tier_names() for h in hierarchies.values()])
    attached = attach_tiers(requests, fit_tiers(sales, [t for t in tiers if t.name in used]), hot)
    return attached.select(
        *keep,
        *[
            step_through(h, global_level(sales, h.fallback).scalar()).alias(name)
            for name, h in hierarchies.items()
        ],
    )


def tier_features(
    rows: DataFrame, sales: DataFrame, default: float = DEFAULT_PRODUCT_MEAN, tiers: Sequence[Tier] = INPUT_TIERS
) -> DataFrame:
    """Scaled group means as model inputs; missing means come from the product, then a constant.

    The fine means are filled from the product mean before the product mean itself is filled.
    """
    attached = attach_tiers(rows, fit_tiers(sales, tiers))
    inputs = {t.name: TIER_INPUTS.get(t.name, PLAIN_INPUT) for t in tiers}
    scaled = attached.withColumns({name: F.exp(name) * scale + offset for name, (scale, offset) in inputs.items()})
    return fill_from(scaled, [n for n in inputs if n != "p"], "p").fillna({"p": default})


def out_of_fold_features(
    rows: DataFrame,
    folds: int = 5,
    default: float = DEFAULT_PRODUCT_MEAN,
    key: str = "id",
    hot: Mapping[tuple[str, ...], DataFrame] | None = None,
    tiers: Sequence[Tier] = INPUT_TIERS,
    own: str | None = None,
) -> DataFrame:
    """``tier_features`` for the rows that the means come from: no row's own fold is in its means.

    Sums and counts per group and fold come from one pass over the rows. A group's table row holds its totals and those
    of its folds, from one shuffle per group, so a row's mean is total minus own fold, and one join per group answers all folds. A group that only
    the row's own fold has is unknown, as it would be for a row to predict. ``own`` names the column that holds a row's
    fold, where it is not to be drawn from ``key``.
    """
    finest = list(dict.fromkeys(k for t in tiers for k in t.keys))
    value = log_demand(F.col("demand"))
    folded = rows.withColumn("__fold", F.col(own) if own else (hash_bucket(F.col(key)) % folds).cast("int"))
    complete = folded.where(reduce(and_, [F.col(k).isNotNull() for k in finest]))
    base = complete.groupBy(*finest, "__fold").agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    for tier in tiers:
        inside = [F.col("__fold") == k for k in range(folds)]
        table = base.groupBy(*tier.keys).agg(
            F.sum("s").alias("__s"),
            F.sum("n").alias("__n"),
            F.array(*[F.sum(F.when(here, F.col("s"))) for here in inside]).alias("__own_s"),
            F.array(*[F.sum(F.when(here, F.col("n"))) for here in inside]).alias("__own_n"),
        )
        own_s, own_n = (F.get(c, F.col("__fold")) for c in ("__own_s", "__own_n"))
        others = F.when(F.col("__n") > own_n, (F.col("__s") - own_s) / (F.col("__n") - own_n))
        scale, offset = TIER_INPUTS.get(tier.name, PLAIN_INPUT)
        folded = lookup_join(folded, table, tier.keys, hot)
        folded = folded.withColumn(tier.name, F.exp(others) * scale + offset).drop("__s", "__n", "__own_s", "__own_n")
    return fill_from(folded.drop("__fold"), [t.name for t in tiers if t.name != "p"], "p").fillna({"p": default})


def early_means(sales: DataFrame, hot: Mapping[tuple[str, ...], DataFrame] | None = None) -> DataFrame:
    """The early scaled means per product, agency and client, with that of product and agency and the overall median.

    Both means are rolled up from one table of sums and counts.
    """
    value = log_demand(F.col("demand"))
    keys, coarse = ("product_id", "agency_id", "client_id"), ("product_id", "agency_id")
    complete = sales.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    base = complete.groupBy(*keys).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    # Scale and offset of the early forecast.
    om = base.groupBy(*coarse).agg((F.exp(F.sum("s") / F.sum("n")) * 0.57928).alias("om"))
    apm = base.select(*keys, (F.exp(F.col("s") / F.col("n")) - 0.91).alias("apm"))
    overall = global_level(sales, Fallback("median")).scalar()
    return lookup_join(apm, om, coarse, hot).withColumn("overall", overall)


def pair_returns(sales: DataFrame) -> DataFrame:
    """Typical returned units of a product-client pair, over its rows with returns."""
    returned = sales.where(F.col("return_units") > 0)
    return returned.groupBy("product_id", "client_id").agg(
        F.expm1(F.avg(F.log1p("return_units"))).alias("pair_returns")
    )
