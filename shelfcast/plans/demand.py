"""Demand forecasts end to end: back-off, boosted trees, ensemble and hold-out scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfcast.functions.scalars import log_target
from shelfcast.operators.ensemble import MEMBERS, SUBMISSIONS, ensemble
from shelfcast.operators.evaluate import rmsle
from shelfcast.operators.features import DEFAULT_PRODUCT_MEAN, FEATURE_KEYS, FeatureTables, build_features, model_table
from shelfcast.operators.filters import demand_between, hash_sample, week_range
from shelfcast.operators.hierarchy import (
    C,
    HIER1,
    HIER2,
    HIER3,
    HOLDOUT,
    INPUT_TIERS,
    TIERS,
    Hierarchy,
    R,
    out_of_fold_features,
    predict_hierarchies,
    tier_features,
)
from shelfcast.operators.models import (
    LATEST_INPUTS,
    STACKED_INPUTS,
    BoostParams,
    CvResult,
    assemble,
    fit_forest,
    fit_tuned,
    predict_demand,
    with_fold,
)
from shelfcast.operators.skew import find_hot_keys
from shelfcast.operators.tuning import SearchResult
from shelfcast.schema import SALES_COLUMNS
from shelfcast.session import cut_lineage
from shelfcast.sources.store import load_params, save_params, write_submissions

LATEST_HIERARCHIES = {"hp1": HIER1, "hp2": HIER2, "hp3": HIER3}
#: Requests meet their client's lags last, so they are where its mean is when that comes first.
LATEST_TIERS = (C, *[t for t in TIERS if t != C])


def hierarchy_forecast(
    requests: DataFrame, sales: DataFrame, hierarchies: Mapping[str, Hierarchy] = LATEST_HIERARCHIES
) -> DataFrame:
    """Back-off forecasts ``(id, hp1, hp2, hp3)``; six joins serve all three."""
    return predict_hierarchies(requests, sales, hierarchies)


def training_matrix(
    sales: DataFrame,
    features: FeatureTables,
    after: int = 5,
    last: int = 9,
    sample: float | None = None,
    inputs: Sequence[str] = LATEST_INPUTS,
    folds: int | None = None,
) -> DataFrame:
    """Assembled training rows ``(id, features, target)``, written once: every fit reads them many times.

    Where ``folds`` is given, a row's ``fold`` takes the place of its id, which is wide, before anything is moved.
    """
    rows = week_range(demand_between(sales), after, last)
    rows = hash_sample(rows, sample) if sample else rows
    rows, key = (with_fold(rows, folds).drop("id"), "fold") if folds else (rows, "id")
    # Inputs are written apart, each in its own encoding, and put together where they are read.
    flat = cut_lineage(model_table(rows, features, needed=inputs).select(key, *inputs, "target"))
    return assemble(flat, inputs).select(key, "features", "target")


def shared_table(
    sales: DataFrame,
    requests: DataFrame,
    features: FeatureTables,
    last_known_week: int,
    after: int,
    last: int,
    sample: float | None = None,
    folds: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``training_matrix`` and the model table of the requests from one meeting of both with the feature tables.

    The last known week changes no lag of a training row: the week before its own is not after it.
    """
    rows = week_range(demand_between(sales), after, last)
    rows = hash_sample(rows, sample) if sample else rows
    rows = with_fold(rows, folds).drop("id") if folds else rows
    both = rows.withColumn("asked", F.lit(False)).unionByName(
        requests.withColumn("asked", F.lit(True)), allowMissingColumns=True
    )
    table = model_table(both, features, last_known_week, hot=find_hot_keys(both, FEATURE_KEYS), needed=LATEST_INPUTS)
    key = "fold" if folds else "id"
    kept = dict.fromkeys([*requests.columns, key, *LATEST_INPUTS, "target", "asked"])
    table = cut_lineage(table.select(*kept))
    matrix = assemble(table.where(~F.col("asked")), LATEST_INPUTS).select(key, "features", "target")
    return matrix, table.where("asked").drop("asked", "target")


def written_sales(sales: DataFrame) -> DataFrame:
    """What forecasts read of the sales, written once: they pass over it several times."""
    return cut_lineage(sales.select(*SALES_COLUMNS))


@dataclass(frozen=True)
class Forecast:
    """Predictions of the whole forecast and the model behind the boosted column."""

    predictions: DataFrame
    model: object
    tuning: CvResult | None


def forecast(
    sales: DataFrame,
    requests: DataFrame,
    brands: DataFrame,
    params: BoostParams = BoostParams(),
    last_known_week: int = 9,
    tune_folds: int | None = None,
    sample: float | None = None,
    negative: float = 0.0,
    cap: float | None = None,
    features: FeatureTables | None = None,
    written: bool = False,
) -> Forecast:
    """Boosted and back-off forecasts with all their ensembles, one row per request.

    ``features`` takes stored feature tables in place of building them; ``params`` may come from a search, by way of
    ``save_best`` and ``load_best``.

    The boosted prediction stays on the request row while the back-off means are attached to it, so
    the two sets of predictions never have to be joined with each other. ``written`` tells that sales and requests are
    plain scans; they are written first otherwise.
    """
    if not written:
        sales, requests = written_sales(sales), cut_lineage(requests)
    hot = find_hot_keys(requests, [*FEATURE_KEYS, *[t.keys for t in TIERS]])
    if features is None:
        features = build_features(demand_between(sales), brands, written=True)
        matrix = training_matrix(sales, features, last_known_week - 4, last_known_week, sample, folds=tune_folds)
        table = model_table(requests, features, last_known_week, hot=hot, needed=LATEST_INPUTS)
    else:
        # Stored tables are moved to meet the rows, so all rows meet them together.
        weeks = (last_known_week - 4, last_known_week)
        matrix, table = shared_table(sales, requests, features, last_known_week, *weeks, sample, tune_folds)
    model, tuning = fit_tuned(matrix, params, tune_folds)
    rows = assemble(table, LATEST_INPUTS)
    boosted = predict_demand(model, rows, negative, cap).select(*requests.columns, "boosted")
    predictions = predict_hierarchies(boosted, sales, LATEST_HIERARCHIES, LATEST_TIERS, ("id", "boosted"), hot)
    return Forecast(ensemble(predictions), model, tuning)


def write_forecast(result: Forecast, path: str) -> str:
    """All prediction files of a forecast, a folder per model."""
    # What the averages follow from is written first, so that no file makes the predictions again.
    members = cut_lineage(result.predictions.select("id", *MEMBERS))
    return write_submissions(ensemble(members), path, SUBMISSIONS, written=True)


def save_best(spark: SparkSession, search: SearchResult, path: str) -> str:
    """The settings of the best trial, with its number of rounds, as a parameter file."""
    best = search.best
    return save_params(spark, asdict(replace(best.params, rounds=best.result.best_round)), path)


def load_best(spark: SparkSession, path: str) -> BoostParams:
    return BoostParams(**load_params(spark, path))


def split_holdout(sales: DataFrame, week: int = 9, faithful: bool = False) -> tuple[DataFrame, DataFrame]:
    """History and hold-out rows. The history ends before the hold-out week.

    ``faithful`` keeps the hold-out week in the history, as the published scores did; they are
    optimistic for it.
    """
    history = sales if faithful else sales.where(F.col("week") < week)
    return history, sales.where(F.col("week") == week)


def holdout_hierarchies(
    sales: DataFrame,
    week: int = 9,
    hierarchies: Mapping[str, Hierarchy] = {"predicted": HOLDOUT},
    faithful: bool = False,
) -> DataFrame:
    """Back-off predictions beside the actual demand of the hold-out week."""
    history, actual = split_holdout(sales, week, faithful)
    return predict_hierarchies(actual, history, hierarchies, keep=("id", "demand"))


def holdout_boosted(
    sales: DataFrame,
    brands: DataFrame,
    params: BoostParams = BoostParams(),
    week: int = 9,
    faithful: bool = False,
    tune_folds: int | None = None,
    written: bool = False,
) -> DataFrame:
    """Boosted predictions beside the actual demand of the hold-out week, with the same inputs as training.

    ``tune_folds`` takes the number of rounds from cross-validation on the history. ``written`` tells that the sales are
    a plain scan; they are written first otherwise.
    """
    sales = sales if written else written_sales(sales)
    history, actual = split_holdout(demand_between(sales), week, faithful)
    features = build_features(history, brands, written=True)
    last = week if faithful else week - 1
    matrix, table = shared_table(history, actual, features, week - 1, week - 4, last, folds=tune_folds)
    model, _ = fit_tuned(matrix, params, tune_folds)
    return predict_demand(model, assemble(table, LATEST_INPUTS)).select("id", "demand", "boosted")


def holdout_forest(sales: DataFrame, brands: DataFrame, week: int = 9, n_trees: int = 10, mtry: int = 3, max_depth: int = 8) -> DataFrame:
    """Forest predictions beside the actual demand of the hold-out week, with the inputs of the boosted model."""
    history, actual = split_holdout(demand_between(sales), week)
    features = build_features(history, brands)
    matrix = training_matrix(history, features, week - 4, week - 1)
    model = fit_forest(matrix, n_trees, mtry, max_depth=max_depth).setPredictionCol("log_prediction")
    rows = assemble(model_table(actual, features, last_known_week=week - 1, needed=LATEST_INPUTS), LATEST_INPUTS)
    return predict_demand(model, rows).select("id", "demand", "boosted")


def stacked_matrices(
    history: DataFrame, rows: DataFrame, folds: int = 5, tune_folds: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Assembled training and scoring rows with group means as inputs; training rows get those of the other folds.

    Pairs of product and route seldom return, and the route's number has more values than a tree has bins, so the mean
    of the route is an input besides the published ones. Where ``tune_folds`` is given, a training row's ``fold`` of as
    many takes the place of its id, which is wide, before anything is moved.
    """
    tiers = (*INPUT_TIERS, R)
    means = [t.name for t in tiers if t.name != "p"]
    hot = find_hot_keys(history, [t.keys for t in tiers])
    known, key, own = history, "id", None
    if tune_folds:
        own = "own_fold"
        known, key = with_fold(with_fold(history, folds).withColumnRenamed("fold", own), tune_folds).drop("id"), "fold"
    train = out_of_fold_features(known, folds, hot=hot, tiers=tiers, own=own).fillna(DEFAULT_PRODUCT_MEAN, subset=means)
    train = train.withColumn("target", log_target(F.col("demand")))
    flat = cut_lineage(train.select(key, *STACKED_INPUTS, "target"))
    ready = assemble(flat, STACKED_INPUTS).select(key, "features", "target")
    # A product that the history does not know has no mean to fill the others from.
    known = tier_features(rows, history, tiers=tiers).fillna(DEFAULT_PRODUCT_MEAN, subset=means)
    return ready, assemble(known, STACKED_INPUTS)


def holdout_stacked(
    sales: DataFrame,
    params: BoostParams = BoostParams(),
    week: int = 9,
    folds: int = 5,
    tune_folds: int | None = None,
    written: bool = False,
) -> DataFrame:
    """Boosted predictions from group means beside the actual demand of the hold-out week.

    ``written`` tells that the sales are a plain scan; they are written first otherwise.
    """
    sales = sales if written else written_sales(sales)
    history, actual = split_holdout(demand_between(sales), week)
    matrix, rows = stacked_matrices(history, actual, folds, tune_folds)
    model, _ = fit_tuned(matrix, params, tune_folds)
    return predict_demand(model, rows).select("id", "demand", "boosted")


def holdout_scores(predicted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Log error and totals per prediction column, from one pass."""
    long = predicted.unpivot(["id", "demand"], list(columns), "model", "prediction")
    scores = long.groupBy("model").agg(
        F.sqrt(F.avg(F.pow(F.log1p("demand") - F.log1p("prediction"), 2))).alias("rmsle"),
        F.sum("demand").alias("actual_total"),
        F.sum("prediction").alias("predicted_total"),
        F.count("*").alias("rows"),
    )
    return scores


def evaluate_holdout(predicted: DataFrame, column: str) -> DataFrame:
    return rmsle(predicted, "demand", column)
