"""Credit scoring: imputation, transforms, logistic and neural models."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import Imputer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import NumericType

from shelfcast.functions.scalars import known
from shelfcast.operators.filters import cap
from shelfcast.operators.models import fit_tree, in_parallel, partitions_for
from shelfcast.operators.trees import split_table, tree_nodes
from shelfcast.session import cut_lineage

# Upper limits, pooled-standardised columns and interactions of the scoring model.
CAPS = {"loan": 60000.0, "mortdue": 200000.0, "value": 300000.0, "clage": 500.0, "clno": 60.0, "debtinc": 60.0}
STANDARDISED = ("loan", "mortdue", "clage", "value", "clno", "debtinc")
INTERACTIONS = {"int_var1": ("delinq", "debtinc"), "int_var2": ("delinq", "loan")}
# Terms of the final logistic model.
LOGIT_TERMS = (
    "loan", "mortdue", "value", "reason", "job", "yoj", "derog", "delinq", "clage", "ninq", "debtinc",
    "mortdue_imp_f", "value_imp_f", "yoj_imp_f", "derog_imp_f", "delinq_imp_f", "clage_imp_f", "clno_imp_f",
    "debtinc_imp_f", "int_var1", "int_var2",
)


# Levels of a category that may become columns of a design matrix.
MAX_LEVELS = 1000
# Columns that are filled before the rows are written again.
WRITE_AFTER = 4


def is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NumericType)


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values per column, from one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "missing")


def missing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns of ``columns`` with at least one missing value; the driver gets one row of counts."""
    found = {r["column_name"] for r in missing_profile(df, columns).where("missing > 0").collect()}
    return [c for c in columns if c in found]


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A 0/1 column per imputed column; add them before filling."""
    return df.withColumns({f"{c}_imp_f": F.col(c).isNull().cast("int") for c in columns})


def impute_by_tree(
    train: DataFrame,
    test: DataFrame,
    predictors: Sequence[str],
    columns: Sequence[str] | None = None,
    flags: bool = True,
    max_depth: int = 5,
    min_rows: int = 5,
    max_bins: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """Fill each column that is missing in training by a regression tree on the others.

    Columns are filled in order and later trees see earlier fills. The same tree fills the test rows.
    A predictor still missing at its turn is replaced by its training mean for that tree only; the
    filled column is not among its own predictors. Both tables are written at the start and again after every few
    columns, so no fit replays more than a few trees; between, every fill is a projection and no rows move.
    """
    train, test = cut_lineage(train), cut_lineage(test)
    columns = list(columns) if columns is not None else missing_columns(train, predictors)
    if flags:
        train, test = missing_flags(train, columns), missing_flags(test, columns)
    numbers = [c for c in predictors if is_number(train, c)]
    categories = [c for c in predictors if c not in numbers]
    stages = []
    if categories:
        check_levels(train, categories, max_bins - 1)
        stages.append(
            StringIndexer(
                inputCols=categories, outputCols=[f"{c}__in" for c in categories], handleInvalid="keep",
                stringOrderType="alphabetAsc",
            )
        )
    if numbers:
        # A column keeps its training mean until its own turn, so the means are taken once.
        stages.append(Imputer(strategy="mean", inputCols=numbers, outputCols=[f"{c}__in" for c in numbers]))
    prepare = Pipeline(stages=stages).fit(train)
    made = [f"{c}__in" for c in predictors]

    for done, column in enumerate(columns, start=1):
        inputs = [f"{c}__in" for c in predictors if c != column]
        assembler = VectorAssembler(inputCols=inputs, outputCol="features")

        def ready(df: DataFrame) -> DataFrame:
            return assembler.transform(prepare.transform(df))

        known_rows = ready(train.where(F.col(column).isNotNull())).select("features", column)
        tree = fit_tree(known_rows, column, max_depth, min_rows, max_bins).setPredictionCol("__fill")

        def fill(df: DataFrame) -> DataFrame:
            filled = tree.transform(ready(df)).withColumn(column, F.coalesce(known(F.col(column)), "__fill"))
            return filled.drop("__fill", "features", *made)

        train, test = fill(train), fill(test)
        if done % WRITE_AFTER == 0 or done == len(columns):
            train, test = cut_lineage(train), cut_lineage(test)
    return train, test


def pooled_stats(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each column over both tables, as a one-row table."""
    both = train.select(*columns).unionByName(test.select(*columns))
    return both.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_samp(c).alias(f"{c}_sd") for c in columns]
    )


def standardise(train: DataFrame, test: DataFrame, columns: Sequence[str] = STANDARDISED) -> tuple[DataFrame, DataFrame]:
    stats = pooled_stats(train, test, columns).select(F.struct("*").alias("stats"))

    def scale(df: DataFrame) -> DataFrame:
        with_stats = df.withColumn("__stats", stats.scalar())
        scaled = {
            c: F.try_divide(F.col(c) - F.col(f"__stats.{c}_mean"), F.col(f"__stats.{c}_sd")) for c in columns
        }
        return with_stats.withColumns(scaled).drop("__stats")

    return scale(train), scale(test)


def interactions(df: DataFrame, products: Mapping[str, tuple[str, str]] = INTERACTIONS) -> DataFrame:
    return df.withColumns({name: F.col(a) * F.col(b) for name, (a, b) in products.items()})


def prepare_applicants(
    train: DataFrame, test: DataFrame, predictors: Sequence[str], **impute_options
) -> tuple[DataFrame, DataFrame]:
    """Impute, cap, standardise and cross the columns of both tables."""
    train, test = impute_by_tree(train, test, predictors, **impute_options)
    train, test = standardise(cap(train, CAPS), cap(test, CAPS))
    return interactions(train), interactions(test)


def check_levels(df: DataFrame, categories: Sequence[str], most: int) -> None:
    """Fail where a category has more than ``most`` levels, before they go anywhere."""
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in categories]).first()
    for c in categories:
        if counts[c] > most:
            raise ValueError(f"{c} has {counts[c]} levels; the limit is {most}")


def category_levels(train: DataFrame, terms: Sequence[str]) -> dict[str, list[str]]:
    """Levels of the categorical terms in alphabetical order; they become columns, so there are few."""
    categories = [t for t in terms if not is_number(train, t)]
    if not categories:
        return {}
    check_levels(train, categories, MAX_LEVELS)
    made = [f"{c}__code" for c in categories]
    indexer = StringIndexer(inputCols=categories, outputCols=made, stringOrderType="alphabetAsc").fit(train)
    return dict(zip(categories, map(list, indexer.labelsArray)))


def design(terms: Sequence[str], levels: Mapping[str, Sequence[str]], features: str = "features") -> PipelineModel:
    """Design matrix: numbers as they are, a category as one 0/1 column per level but the first.

    A level that was not in the training rows counts as the first level.
    """

    def is_level(category: str, level: str) -> str:
        text = level.replace("\\", "\\\\").replace("'", "\\'")
        return f"CASE WHEN {category} = '{text}' THEN 1 ELSE 0 END"

    columns = {
        t: {f"{t}_{i}_{re.sub(r'[^A-Za-z0-9]+', '_', lv)}": is_level(t, lv) for i, lv in enumerate(levels[t]) if i}
        for t in terms
        if t in levels
    }
    made = [f"{sql} AS `{name}`" for part in columns.values() for name, sql in part.items()]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(made)} FROM __THIS__")] if made else []
    inputs = [name for t in terms for name in (columns[t] if t in columns else [t])]
    return PipelineModel([*stages, VectorAssembler(inputCols=inputs, outputCol=features)])


def applicant_splits(
    train: DataFrame, terms: Sequence[str] = LOGIT_TERMS, label: str = "target_flag", max_depth: int = 5, min_rows: int = 5
) -> DataFrame:
    """The split table of a tree over all terms, to look for interactions: each node's conditions, rows and mean flag."""
    matrix = design(terms, category_levels(train, terms))
    rows = cut_lineage(matrix.transform(train).select("features", label))
    model = fit_tree(rows, label, max_depth=max_depth, min_rows=min_rows)
    return split_table(cut_lineage(tree_nodes(train.sparkSession, model, matrix.stages[-1].getInputCols())))


@dataclass(frozen=True)
class Logit:
    """A fitted logistic model with the design it was fitted on."""

    terms: tuple[str, ...]
    design: PipelineModel
    model: GeneralizedLinearRegressionModel

    @property
    def aic(self) -> float:
        return self.model.summary.aic

    def score(self, df: DataFrame, name: str = "probability") -> DataFrame:
        scored = self.model.setPredictionCol(name).transform(self.design.transform(df))
        return scored.select(*df.columns, name)

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """Estimate, standard error and p-value per design column."""
        summary = self.model.summary
        labels = [*self.design.stages[-1].getInputCols(), "(intercept)"]
        estimates = [*self.model.coefficients.toArray().tolist(), self.model.intercept]
        rows = list(zip(labels, estimates, summary.coefficientStandardErrors, summary.pValues))
        return spark.createDataFrame(
            rows, "term STRING, estimate DOUBLE, std_error DOUBLE, p_value DOUBLE"
        )


def fit_logit(
    train: DataFrame,
    terms: Sequence[str] = LOGIT_TERMS,
    label: str = "target_flag",
    max_iter: int = 25,
    tol: float = 1e-8,
    levels: Mapping[str, Sequence[str]] | None = None,
    written: bool = False,
) -> Logit:
    """Logistic regression by iteratively reweighted least squares.

    Every iteration reads the rows again, so the columns of the model are written once, unless the caller says that
    ``train`` is ``written``.
    """
    if not written:
        train = cut_lineage(train.select(*terms, label))
    matrix = design(terms, category_levels(train, terms) if levels is None else levels)
    glm = GeneralizedLinearRegression(
        family="binomial", link="logit", featuresCol="features", labelCol=label, maxIter=max_iter, tol=tol
    )
    return Logit(tuple(terms), matrix, glm.fit(matrix.transform(train).select("features", label)))


@dataclass(frozen=True)
class Move:
    """One accepted step of the selection."""

    step: int
    action: str
    term: str
    aic: float


def logistic_sums(
    rows: DataFrame, fits: Sequence[tuple[np.ndarray, np.ndarray]]
) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Deviance, gradient and information of several logistic models at given coefficients, from one pass.

    ``rows`` has the inputs as an array ``x`` and the 0/1 flag ``y``; a fit is the places of its inputs and their
    coefficients. Tasks add up their rows and Spark adds up the tasks, so the driver gets one set of sums per fit.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0.0] * len(fits)
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            for i, (own, coefficients) in enumerate(fits if len(y) else ()):
                inputs = x[:, own]
                eta = inputs @ coefficients
                deviance = 2 * (np.logaddexp(0, eta) - y * eta).sum()
                p = np.exp(-np.logaddexp(0, -eta))
                weighted = inputs * np.maximum(p * (1 - p), 1e-10)[:, None]
                sums[i] = sums[i] + np.concatenate([[deviance], inputs.T @ (y - p), (inputs.T @ weighted).ravel()])
        for i, values in enumerate(sums):
            if np.ndim(values):
                places = np.arange(len(values), dtype=np.int32)
                yield pa.RecordBatch.from_pydict({"fit": np.full(len(values), i, np.int32), "place": places, "value": values})

    added = rows.mapInArrow(add_up, "fit INT, place INT, value DOUBLE").groupBy("fit", "place").agg(F.sum("value"))
    out = [np.zeros(1 + len(own) + len(own) ** 2) for own, _ in fits]
    for i, place, value in added.collect():
        out[i][place] = value
    return [(v[0], v[1 : n + 1], v[n + 1 :].reshape(n, n)) for v, n in zip(out, (len(own) for own, _ in fits))]


def solved(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least solution of a symmetric system; inputs of any scale, or that repeat each other, may be among its columns."""
    scale = np.sqrt(np.maximum(np.diag(matrix), 1e-300))
    return np.linalg.pinv(matrix / np.outer(scale, scale), rcond=1e-12, hermitian=True) @ (right / scale) / scale


def newton_logits(
    rows: DataFrame, starts: Sequence[tuple[np.ndarray, np.ndarray]], max_iter: int = 25, tol: float = 1e-9
) -> list[tuple[float, np.ndarray]]:
    """Deviance and coefficients of several logistic models, fitted together: a pass over the rows is a step of all.

    A model is done when its next step would lower the deviance by less than ``tol``. A step that raised the deviance is
    halved.
    """
    best = [(np.inf, b) for _, b in starts]
    now = [b for _, b in starts]
    left = list(range(len(starts)))
    for _ in range(max_iter):
        sums = logistic_sums(rows, [(starts[i][0], now[i]) for i in left])
        going = []
        for i, (deviance, gradient, information) in zip(left, sums):
            if deviance <= best[i][0] + tol:
                best[i] = deviance, now[i]
                step = solved(information, gradient)
                if gradient @ step < tol:
                    continue
                now[i] = now[i] + step
            else:
                now[i] = (now[i] + best[i][1]) / 2
            going.append(i)
        left = going
        if not left:
            break
    return best


def step_errors(products: np.ndarray, subsets: Sequence[Sequence[int]]) -> list[float]:
    """Weighted squared error of the working response for each subset of inputs (the constant is always in)."""
    constant, z = len(products) - 2, len(products) - 1
    out = []
    for subset in subsets:
        own = [*subset, constant]
        moment = products[own, z]
        out.append(float(products[z, z] - moment @ np.linalg.pinv(products[np.ix_(own, own)], hermitian=True) @ moment))
    return out


def stepwise_aic(
    train: DataFrame,
    terms: Sequence[str] = LOGIT_TERMS,
    label: str = "target_flag",
    max_steps: int = 100,
    refits: int | None = 2,
) -> tuple[Logit, list[Move]]:
    """Drop or re-add one term at a time while that lowers the AIC, from the full model on.

    A category enters or leaves whole. The cross products at the current model, one pass over the rows, give every
    move's AIC up to one step of its fit; the best ``refits`` moves are fitted exactly, and the best of them is taken.
    Where none lowers the AIC, all other moves are fitted as well before the search ends, so its end point is one that
    no exact move improves. ``refits=None`` fits every move of every step. Moves that are fitted together start from
    the products and share their passes, so a step takes a few passes however many moves it has; only AIC values and
    the products reach the driver. The inputs of all terms are written once, for every pass to read.
    """
    train = cut_lineage(train.select(*terms, label))
    levels = category_levels(train, terms)
    whole = design(terms, levels, "__all")
    columns = whole.stages[-1].getInputCols()
    made = {t: set(design([t], levels).stages[-1].getInputCols()) for t in terms}
    places = {t: [i for i, c in enumerate(columns) if c in made[t]] for t in terms}
    inputs = F.concat(vector_to_array("__all"), F.array(F.lit(1.0))).alias("x")
    rows = whole.transform(train).select(inputs, F.col(label).cast("double").alias("y"))
    # Many passes follow: about as much work for each task, however few files the rows came in.
    rows = cut_lineage(rows.repartition(partitions_for(train.count())))
    everything = np.arange(len(columns) + 1)

    def inputs_of(kept: Sequence[str]) -> np.ndarray:
        return np.array(sorted(i for t in kept for i in places[t]) + [len(columns)])

    def aic_of(deviance: float, own: np.ndarray) -> float:
        return float(deviance) + 2 * len(own)

    kept, own = tuple(terms), everything
    deviance, coefficients = newton_logits(rows, [(own, np.zeros(len(own)))])[0]
    current = aic_of(deviance, own)
    moves = [Move(0, "start", "", current)]
    while len(moves) <= max_steps:
        options = [("drop", t, tuple(k for k in kept if k != t)) for t in kept if len(kept) > 1]
        options += [("add", t, (*kept, t)) for t in terms if t not in kept]
        at = np.zeros(len(everything))
        at[own] = coefficients
        _, gradient, information = logistic_sums(rows, [(everything, at)])[0]
        response = information @ at + gradient
        if refits is not None:
            products = np.block([[information, response[:, None]], [response[None, :], np.atleast_2d(at @ (response + gradient))]])
            subsets = [[i for t in option[2] for i in places[t]] for option in options]
            near = [e + 2 * len(s) for e, s in zip(step_errors(products, subsets), subsets)]
            options = [options[i] for i in np.argsort(near, kind="stable")]
        first = len(options) if refits is None else refits
        chosen = None
        for part in (options[:first], options[first:]):
            if chosen is None and part:
                tried = [inputs_of(option[2]) for option in part]
                starts = [(o, solved(information[np.ix_(o, o)], response[o])) for o in tried]
                fitted = newton_logits(rows, starts)
                i = min(range(len(part)), key=lambda i: aic_of(fitted[i][0], tried[i]))
                if aic_of(fitted[i][0], tried[i]) < current - 1e-7:
                    chosen = part[i], tried[i], fitted[i]
        if chosen is None:
            break
        (action, term, kept), own, (deviance, coefficients) = chosen
        current = aic_of(deviance, own)
        moves.append(Move(len(moves), action, term, current))
    return fit_logit(train, kept, label, levels=levels, written=True), moves


def moves_table(df: DataFrame, moves: Sequence[Move]) -> DataFrame:
    rows = [(m.step, m.action, m.term, m.aic) for m in moves]
    return df.sparkSession.createDataFrame(rows, "step INT, action STRING, term STRING, aic DOUBLE")


@dataclass(frozen=True)
class MlpEnsemble:
    """Networks that differ only by seed."""

    design: PipelineModel
    models: tuple

    def score(self, df: DataFrame, name: str = "probability") -> DataFrame:
        """Mean probability of the positive class; all networks score the row in one pass."""
        scored = self.design.transform(df)
        made = []
        for i, model in enumerate(self.models):
            out = model.setProbabilityCol(f"__p{i}").setRawPredictionCol(f"__r{i}").setPredictionCol(f"__y{i}")
            scored = out.transform(scored)
            made.append(vector_to_array(F.col(f"__p{i}"))[1])
        return scored.select(*df.columns, (reduce(add, made) / len(made)).alias(name))


def fit_mlp_ensemble(
    train: DataFrame,
    terms: Sequence[str] = LOGIT_TERMS,
    label: str = "target_flag",
    fits: int = 20,
    hidden: Sequence[int] = (32, 16),
    max_iter: int = 20,
    workers: int = 2,
) -> MlpEnsemble:
    """Neural classifiers with seeds 1, 2, ...: sigmoid layers, trained by L-BFGS on all partitions.

    Every network reads the rows again, so they are dealt evenly to tasks and written once.
    """
    matrix = design(terms, category_levels(train, terms))
    ready = cut_lineage(matrix.transform(train).select("features", label).repartition(partitions_for(train.count())))
    width = len(matrix.stages[-1].getInputCols())

    def fit(seed: int):
        return MultilayerPerceptronClassifier(
            featuresCol="features", labelCol=label, layers=[width, *hidden, 2], maxIter=max_iter, seed=seed
        ).fit(ready)

    models = in_parallel(train.sparkSession, [lambda s=s: fit(s) for s in range(1, fits + 1)], workers)
    return MlpEnsemble(matrix, tuple(models))
