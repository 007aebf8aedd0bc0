"""Random search over boosted-tree settings, with a ledger of finished trials from which a lost search goes on."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace
from statistics import median

from pyspark.sql import DataFrame, SparkSession

from shelfcast.operators.models import BoostParams, CvResult, best_round, cv_rounds, in_parallel


# Spark ML limits trees to this depth.
MAX_DEPTH = 30


@dataclass(frozen=True)
class SearchSpace:
    """Closed ranges the settings are drawn from."""

    # The latest published ranges.
    max_depth: tuple[int, int] = (8, 11)
    eta: tuple[float, float] = (0.1, 0.3)
    gamma: tuple[float, float] = (0.0, 0.2)
    subsample: tuple[float, float] = (0.6, 0.9)
    colsample: tuple[float, float] = (0.5, 0.8)
    min_child: tuple[int, int] = (1, 40)

    def __post_init__(self) -> None:
        if self.max_depth[1] > MAX_DEPTH:
            raise ValueError(f"trees are limited to a depth of {MAX_DEPTH}")

    def draw(self, rng: random.Random, base: BoostParams) -> BoostParams:
        return replace(
            base,
            max_depth=rng.randint(*self.max_depth),
            eta=rng.uniform(*self.eta),
            gamma=rng.uniform(*self.gamma),
            subsample=rng.uniform(*self.subsample),
            colsample=rng.uniform(*self.colsample),
            min_child=rng.randint(*self.min_child),
            seed=rng.randint(1, 10_000),
        )


# Ranges of earlier revisions.
EARLIER_SPACE = SearchSpace(max_depth=(6, 10), eta=(0.01, 0.3))
# Published with depths up to 50, which Spark ML's limit does not allow.
DEEP_SPACE = SearchSpace(max_depth=(10, MAX_DEPTH), eta=(0.1, 0.9))


@dataclass(frozen=True)
class Trial:
    params: BoostParams
    result: CvResult


@dataclass(frozen=True)
class SearchResult:
    trials: tuple[Trial, ...]

    @property
    def best(self) -> Trial:
        """The first trial with the lowest error."""
        return min(self.trials, key=lambda t: t.result.best_error)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per trial."""
        rows = [
            (i, p.max_depth, p.eta, p.gamma, p.subsample, p.colsample, p.min_child, t.result.best_round, t.result.best_error,
             t.result.stopped)
            for i, t in enumerate(self.trials, start=1)
            for p in [t.params]
        ]
        return spark.createDataFrame(
            rows,
            "trial INT, max_depth INT, eta DOUBLE, gamma DOUBLE, subsample DOUBLE, colsample DOUBLE, "
            "min_child INT, best_round INT, best_error DOUBLE, stopped BOOLEAN",
        )


#: Finished trials from which a running median can be told.
LEAST_FINISHED = 5

LEDGER = (
    "trial INT, folds INT, patience INT, rows BIGINT, curve ARRAY<DOUBLE>, stopped BOOLEAN, max_depth INT, eta DOUBLE, gamma DOUBLE, "
    "subsample DOUBLE, colsample DOUBLE, min_child INT, rounds INT, max_bins INT, seed INT, partitions INT"
)
_SETTINGS = ("folds", "patience", "rows")


def write_trial(spark: SparkSession, path: str, number: int, trial: Trial, settings: dict) -> None:
    """Add a finished trial: one file, which appears when it is whole."""
    row = {"trial": number, "curve": list(trial.result.curve), "stopped": trial.result.stopped, **settings, **asdict(trial.params)}
    spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("append").parquet(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """The finished trials of a ledger; none where nothing has been written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path).dropDuplicates(["trial"])


def known_trials(spark: SparkSession, path: str, drawn: Sequence[BoostParams], settings: dict) -> dict[int, Trial]:
    """Finished trials by number; a ledger of another search is an error."""
    known = {}
    for row in read_trials(spark, path).where(f"trial <= {len(drawn)}").collect():
        params = BoostParams(**{name: row[name] for name in asdict(drawn[0])})
        if params != drawn[row["trial"] - 1] or any(row[name] != settings[name] for name in _SETTINGS):
            raise ValueError(f"{path} holds trials of another search")
        curve = tuple(row["curve"])
        known[row["trial"]] = Trial(params, CvResult(curve, *best_round(curve, settings["patience"]), row["stopped"]))
    return known


def behind_median(curves: Sequence[Sequence[float]]) -> Callable[[Sequence[float]], bool] | None:
    """Whether a curve's lowest error is above the median of what finished trials had after as many rounds."""
    if len(curves) < LEAST_FINISHED:
        return None
    return lambda curve: min(curve) > median(min(known[: len(curve)]) for known in curves)


def random_search(
    train: DataFrame,
    space: SearchSpace = SearchSpace(),
    trials: int = 100,
    seed: int = 1969,
    base: BoostParams = BoostParams(rounds=500),
    folds: int = 5,
    patience: int | None = 2,
    key: str = "id",
    workers: int = 2,
    ledger: str | None = None,
    prune: bool = False,
) -> SearchResult:
    """Cross-validate seeded draws from ``space``; a few trials run at once, each fit is distributed.

    ``train`` is read ``trials * folds`` times, so pass a written matrix. ``ledger`` is a shared folder to which each
    finished trial is added: the same search started again fits only what is missing, and more trials may be asked for.
    ``prune`` ends a trial that is behind the running median of the trials before its batch; as batches of ``workers``
    are fixed, a search that was interrupted ends as one that was not.
    """
    spark = train.sparkSession
    rng = random.Random(seed)
    drawn = [space.draw(rng, base) for _ in range(trials)]
    known, settings = {}, {}
    if ledger:
        settings = {"folds": folds, "patience": patience, "rows": train.count()}
        known = known_trials(spark, ledger, drawn, settings)

    def run(number: int, hopeless) -> Trial:
        params = drawn[number - 1]
        trial = Trial(params, cv_rounds(train, params, folds, patience, key, workers=folds, hopeless=hopeless))
        if ledger:
            write_trial(spark, ledger, number, trial, settings)
        return trial

    for start in range(1, trials + 1, workers):
        batch = [n for n in range(start, min(start + workers, trials + 1)) if n not in known]
        hopeless = behind_median([known[n].result.curve for n in range(1, start)]) if prune else None
        known |= zip(batch, in_parallel(spark, [lambda n=n: run(n, hopeless) for n in batch], workers))
    return SearchResult(tuple(known[n] for n in range(1, trials + 1)))
