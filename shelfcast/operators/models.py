"""Model inputs and tree models on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    DecisionTreeRegressor,
    GBTRegressionModel,
    GBTRegressor,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructField, StructType

from shelfcast.functions.scalars import clean_prediction, from_log, hash_bucket
from shelfcast.operators.features import LAG_MEDIANS
from shelfcast.session import cut_lineage, shuffled_once

# Model inputs by revision: the latest, the one with pair medians only, and the one with all pair lags.
BASE_INPUTS = ("multi", "week", "agency_id", "route_id", "product_id", "client_id")
LATEST_INPUTS = (*BASE_INPUTS, *LAG_MEDIANS)
PAIR_MEDIAN_INPUTS = (*BASE_INPUTS, *[f"pcw{k}_median" for k in (1, 2, 3)])
STACKED_INPUTS = (*BASE_INPUTS[1:], "pca", "pr", "p", "r")
PAIR_LAG_INPUTS = (*BASE_INPUTS, *[f"pcw{k}_{s}" for k in (1, 2, 3) for s in ("total", "mean", "median")])


def category_codes(values: DataFrame, column: str) -> DataFrame:
    """Codes 0, 1, 2, ... of the distinct values in their own order, as a table.

    Distinct values are range-partitioned and written once, so that their place is fixed. The number
    of values per partition is a table with one row per partition; its running total turns the place
    within a partition into the place overall. The vocabulary never visits the driver or one task.
    """
    ordered = values.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
    placed = cut_lineage(
        ordered.select(
            column,
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
        )
    )
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    return placed.join(starts, "part").select(column, (F.col("start") + F.col("place")).alias(f"{column}_code"))


def index_categories(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Add the same codes to both sides; the vocabulary is the union of both."""
    for c in columns:
        codes = category_codes(train.select(c).unionByName(test.select(c)), c)
        train, test = train.join(codes, c, "left"), test.join(codes, c, "left")
    return train, test


def fit_assembler(train: DataFrame, columns: Sequence[str], onehot: Sequence[str] = ()) -> PipelineModel:
    """Feature vector builder, used alike for training and prediction rows.

    Integer ids stay one numeric input each; columns in ``onehot`` (non-negative codes) are expanded.
    A missing input is an error, not a dropped row.
    """
    stages = []
    if onehot:
        encoder = OneHotEncoder(
            inputCols=list(onehot), outputCols=[f"{c}_onehot" for c in onehot], handleInvalid="keep", dropLast=False
        )
        stages.append(encoder.fit(train))
    inputs = [f"{c}_onehot" if c in onehot else c for c in columns]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error"))
    return PipelineModel(stages)


VECTOR = StructType([StructField("v", VectorUDT())])


def sparse_vector(at: Sequence[Column], values: Sequence[Column], width: int) -> Column:
    """A vector of ``width`` from ascending positions and their values; zeros are not stored. It is ``vector_entries``
    the other way round."""
    entries = F.array(*[F.struct(a.cast("int").alias("at"), v.cast("double").alias("value")) for a, v in zip(at, values)])
    stored = F.filter(entries, lambda e: e["value"] != 0)
    kind, size = F.lit(0).cast("tinyint"), F.lit(width).cast("int")
    parts = F.struct(kind.alias("type"), size.alias("size"), stored["at"].alias("indices"), stored["value"].alias("values"))
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), VECTOR)["v"]


def onehot_matrices(
    train: DataFrame, rows: DataFrame, categories: Sequence[str], numbers: Sequence[str] = (), marked: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Sparse ``features`` with a position per value of each category, then the numbers, for both tables alike.

    Positions follow the values' order; a category's last position is for NULL. Codes are joined from tables, so
    vocabularies never visit the driver, however many values there are. A missing number is an error. ``marked`` tells
    tree fits which positions hold zeros and ones only, so that rare values are split on as well; it takes the driver an
    entry per position, as the fit does.
    """
    both = train.select(*categories).unionByName(rows.select(*categories))
    sizes = both.agg(*[F.count_distinct(c).alias(c) for c in categories]).first().asDict()
    starts, width = {}, 0
    for c in categories:
        starts[c], width = width, width + sizes[c] + 1
    ones = width
    width += len(numbers)
    if width >= 1 << 31:
        raise ValueError(f"a vector has fewer than {1 << 31} positions, not {width}")
    at = [F.coalesce(f"{c}_code", F.lit(sizes[c])) + starts[c] for c in categories]
    values = [F.lit(1.0) for _ in categories]
    for i, c in enumerate(numbers):
        value = F.col(c).cast("double")
        missing = F.raise_error(F.lit(f"{c} is missing"))
        at.append(F.lit(ones + i))
        values.append(F.when(value.isNull() | F.isnan(value), missing.cast("double")).otherwise(value))
    features = sparse_vector(at, values, width).alias("features")
    if marked:
        spans = {"binary": range(ones), "numeric": range(ones, width)}
        attributes = {kind: [{"idx": i} for i in span] for kind, span in spans.items() if span}
        features = features.alias("features", metadata={"ml_attr": {"attrs": attributes, "num_attrs": width}})
    codes = [f"{c}_code" for c in categories]
    coded = index_categories(train, rows, categories)
    return tuple(df.select(*[c for c in df.columns if c not in codes], features) for df in coded)


def vector_entries(column: str) -> tuple[Column, Column, Column]:
    """Positions ``at`` and ``value`` of a vector's stored entries, in order, and its ``width``.

    A sparse vector is not spread out, so a row costs its entries, however wide the vector is.
    """
    parts = F.from_json(F.to_json(F.struct(F.col(column).alias("v"))), "v STRUCT<size: INT, indices: ARRAY<INT>, `values`: ARRAY<DOUBLE>>")["v"]
    width = F.coalesce(parts["size"], F.size(parts["values"]))
    at = F.coalesce(parts["indices"], F.transform(parts["values"], lambda _, i: i))
    return at.alias("at"), parts["values"].alias("value"), width.alias("width")


def assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Feature vector of numeric columns, in the given order."""
    return fit_assembler(df, columns).transform(df)


@dataclass(frozen=True)
class BoostParams:
    """Boosted-tree settings under Spark's names.

    ``gamma`` is a total loss reduction; Spark's limit is per row of a node, so it is divided by the
    training rows. Columns are drawn per node, not per tree. Rows are drawn per partition, so ``partitions`` is part
    of the model: the same value gives the same trees however the training rows arrive. Set it to a small multiple of
    the cluster's cores, or to 0 for what ``boosted_partitions`` makes of the training rows.
    """

    # The best single parameters noted for the forecast.
    max_depth: int = 8
    eta: float = 0.2784
    gamma: float = 0.134885
    subsample: float = 0.7742556
    colsample: float = 0.5917445
    min_child: int = 9
    rounds: int = 20
    max_bins: int = 32
    seed: int = 1969
    partitions: int = 64


#: Where the number of partitions is left to the rows; it grows with them and is the same in every layout.
ROWS_PER_PARTITION = 100_000
LEAST_PARTITIONS = 8
#: Boosted fits: every partition shuffles the statistics of each node of every tree, so their sum grows with the
#: partitions. Beyond ``BOOSTED_ENOUGH`` of them, partitions get more rows, until they are full.
BOOSTED_ROWS = 250_000
BOOSTED_ENOUGH = 48
BOOSTED_FULL = 2_000_000
#: Rows of boosted fits that run at the same time.
TOGETHER = 8_000_000


def partitions_for(rows: int, each: int = ROWS_PER_PARTITION) -> int:
    return max(LEAST_PARTITIONS, -(-rows // each))


def boosted_partitions(rows: int) -> int:
    return max(min(partitions_for(rows, BOOSTED_ROWS), BOOSTED_ENOUGH), partitions_for(rows, BOOSTED_FULL))


def laid_out(train: DataFrame, params: BoostParams, label: str) -> DataFrame:
    """The training rows in an order and in partitions that depend on their values alone.

    They are shuffled once, however often they are read: a fit plans its rows twice and reads them several times.
    """
    key = F.xxhash64(vector_to_array("features"), F.col(label))
    also = [c for c in ("weight", "fold") if c in train.columns]
    rows = train.select("features", label, *also).repartition(params.partitions or boosted_partitions(train.count()), key)
    rows = rows.sortWithinPartitions(key, *[c for c in also if c == "fold"])
    return shuffled_once(rows)


def merged(train: DataFrame, label: str) -> DataFrame:
    """Equal training rows as one with their number as ``weight``; they are counted before they are shuffled."""
    return train.groupBy("features", label).agg(F.count("*").cast("double").alias("weight"))


def fit_boosted(
    train: DataFrame, params: BoostParams = BoostParams(), label: str = "target", ordered: bool = False
) -> GBTRegressionModel:
    """Boosted regression trees on ``features``; squared loss on the log target.

    Where neither rows are drawn nor the rows of a leaf are limited, equal rows are fitted as one with a weight.
    ``ordered`` tells that the rows come from ``laid_out`` and stay where they are.
    """
    min_gain = 2 * params.gamma / max(train.count(), 1) if params.gamma else 0.0
    whole = params.subsample >= 1 and params.min_child <= 1
    if whole:
        train = merged(train, label)
    booster = GBTRegressor(
        featuresCol="features",
        labelCol=label,
        maxIter=params.rounds,
        maxDepth=params.max_depth,
        stepSize=params.eta,
        subsamplingRate=params.subsample,
        featureSubsetStrategy="all" if params.colsample >= 1 else str(params.colsample),
        minInstancesPerNode=params.min_child,
        minInfoGain=min_gain,
        maxBins=params.max_bins,
        maxMemoryInMB=1024,
        cacheNodeIds=False,
        seed=params.seed,
    )
    if not whole:
        return booster.fit(train if ordered else laid_out(train, params, label))
    model = booster.setWeightCol("weight").fit(laid_out(train, params, label))
    # Rows to score have no weight.
    model.clear(model.weightCol)
    return model


def predict_demand(model, rows: DataFrame, negative: float = 0.0, cap: float | None = None, name: str = "boosted") -> DataFrame:
    """Predicted demand on the original scale, cleaned; all other columns stay on the row."""
    demand = clean_prediction(from_log(F.col("log_prediction")), negative, cap)
    scored = model.setPredictionCol("log_prediction").transform(rows)
    return scored.withColumn(name, demand).drop("log_prediction")


@dataclass(frozen=True)
class CvResult:
    """Mean validation error per round, and the best round under early stopping."""

    curve: tuple[float, ...]
    best_round: int
    best_error: float
    #: Given up as hopeless before early stopping ended it.
    stopped: bool = False


def best_round(curve: Sequence[float], patience: int | None = None) -> tuple[int, float]:
    """First round with the lowest error, reading no further than ``patience`` rounds without gain."""
    best, at = float("inf"), 0
    for i, error in enumerate(curve, start=1):
        if error < best:
            best, at = error, i
        elif patience is not None and i - at >= patience:
            break
    return at, best


def in_parallel(spark: SparkSession, jobs: Sequence, workers: int) -> list:
    """Run a few driver calls at once; each one is a distributed job of its own."""
    with ThreadPoolExecutor(max_workers=workers) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def with_fold(df: DataFrame, folds: int, key: str = "id", salt: str = "") -> DataFrame:
    return df.withColumn("fold", (hash_bucket(F.col(key), salt) % folds).cast("int"))


def cv_rounds(
    train: DataFrame,
    params: BoostParams,
    folds: int = 5,
    patience: int | None = 2,
    key: str = "id",
    label: str = "target",
    workers: int = 4,
    first_block: int = 4,
    hopeless: Callable[[Sequence[float]], bool] | None = None,
    ordered: bool = False,
) -> CvResult:
    """Cross-validated error after each boosting round, and the best round.

    Folds grow ``first_block`` rounds, then twice as many, and so on, until the mean curve has not improved for
    ``patience`` rounds; the draws of a round do not depend on how many follow, so a longer fit repeats the shorter
    one. The first fold grows so alone, until its own curve tells about how many rounds are needed; the others begin
    there, and its curve is kept. Folds come from the key hash, so they are the same on every run. Write the training
    matrix first: every fold reads it again. ``hopeless`` sees the curve before more rounds are added, and may end it;
    with it all folds grow together. ``ordered`` tells that the rows have their fold and come from ``laid_out``, so that
    no fold shuffles them again.
    """
    folded = train if ordered else with_fold(train.select(key, "features", label), folds, key)
    as_they_are = {"ordered": True} if ordered else {}

    def curve(fold: int, rounds: int) -> list[float]:
        model = fit_boosted(folded.where(F.col("fold") != fold), replace(params, rounds=rounds), label, **as_they_are)
        held = folded.where(F.col("fold") == fold)
        return [e**0.5 for e in model.evaluateEachIteration(held, "squared")]

    rounds = params.rounds if patience is None else min(first_block, params.rounds)
    ahead = []
    while patience is not None and hopeless is None:
        ahead = curve(0, rounds)
        at, _ = best_round(ahead, patience)
        if rounds == params.rounds or at + patience <= rounds:
            # The mean of all folds may stop later than one.
            rounds = min(rounds, max(first_block, at + at // 2 + patience))
            break
        rounds = min(2 * rounds, params.rounds)
    while True:
        left = [f for f in range(folds) if f or len(ahead) < rounds]
        curves = in_parallel(train.sparkSession, [lambda f=f: curve(f, rounds) for f in left], workers)
        curves = [ahead[:rounds], *curves] if len(left) < folds else curves
        mean = tuple(sum(errors) / folds for errors in zip(*curves))
        at, error = best_round(mean, patience)
        if rounds == params.rounds or at + patience <= rounds:
            return CvResult(mean, at, error)
        if hopeless and hopeless(mean):
            return CvResult(mean, at, error, stopped=True)
        rounds = min(2 * rounds, params.rounds)


def refit(
    train: DataFrame, params: BoostParams, result: CvResult, label: str = "target", ordered: bool = False
) -> GBTRegressionModel:
    """Fit on all rows with the best number of rounds."""
    return fit_boosted(train, replace(params, rounds=result.best_round), label, ordered)


def fit_tuned(
    train: DataFrame, params: BoostParams, folds: int | None = None, label: str = "target"
) -> tuple[GBTRegressionModel, CvResult | None]:
    """The fit on all rows, with the number of rounds from cross-validation where ``folds`` is given.

    ``train`` has its ``fold`` then. All fits share one layout of the rows, so that they are shuffled once.
    """
    if not folds:
        return fit_boosted(train, params, label), None
    rows = laid_out(train, params, label)
    # A fit keeps its rows in memory, and on disk beyond it: large ones run one after the other.
    workers = max(1, min(4, TOGETHER // max(train.count(), 1)))
    tuning = cv_rounds(rows, params, folds, label=label, workers=workers, ordered=True)
    return refit(rows, params, tuning, label, ordered=True), tuning


def importance(spark: SparkSession, model, columns: Sequence[str]) -> DataFrame:
    """Importance per input, largest first; one row per model input."""
    scores = model.featureImportances.toArray()
    rows = sorted(zip(columns, map(float, scores)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature STRING, importance DOUBLE")


def fit_tree(
    train: DataFrame, label: str = "target", max_depth: int = 5, min_rows: int = 1, max_bins: int = 32, min_gain: float = 0.0
) -> DecisionTreeRegressionModel:
    """Regression tree by variance reduction."""
    return DecisionTreeRegressor(
        featuresCol="features",
        labelCol=label,
        maxDepth=max_depth,
        minInstancesPerNode=min_rows,
        minInfoGain=min_gain,
        maxBins=max_bins,
        maxMemoryInMB=1024,
    ).fit(train)


def fit_forest(
    train: DataFrame, n_trees: int = 10, mtry: int | None = 3, label: str = "target", max_depth: int = 5,
    bootstrap: bool = True, max_bins: int = 32, seed: int = 1969,
):
    """Random forest; ``mtry`` inputs are tried per split."""
    forest = RandomForestRegressor(
        featuresCol="features",
        labelCol=label,
        numTrees=n_trees,
        featureSubsetStrategy="all" if mtry is None else str(mtry),
        bootstrap=bootstrap,
        maxDepth=max_depth,
        maxBins=max_bins,
        maxMemoryInMB=1024,
        seed=seed,
    )
    return forest.fit(train)


def tree_rules(spark: SparkSession, model: DecisionTreeRegressionModel, columns: Sequence[str]) -> DataFrame:
    """The tree's printed split table, one row per line, with input names in place of numbers."""
    text = model.toDebugString
    for i in reversed(range(len(columns))):
        text = text.replace(f"feature {i} ", f"{columns[i]} ")
    lines = [ln for ln in text.splitlines()[1:] if ln.strip()]
    rows = [(i, len(ln) - len(ln.lstrip()), ln.strip()) for i, ln in enumerate(lines)]
    return spark.createDataFrame(rows, "line INT, indent INT, rule STRING")
