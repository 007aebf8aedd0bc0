import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shelfcast.operators import models as md
from shelfcast.operators.models import BoostParams


@pytest.mark.parametrize("ends", [(1, 1, 1), (9, 9, 9), (3, 20, 20), (20, 3, 3)])
def test_the_first_fold_tells_how_many_rounds_to_fit(spark, monkeypatch, ends):
    """Curves that fall until a round of each fold and rise after it: the same best round, with fewer fits."""
    curves = [[1 + abs(r - end) / 10 for r in range(1, 65)] for end in ends]
    fitted = []

    class Model:
        def __init__(self, rounds):
            self.rounds = rounds

        def evaluateEachIteration(self, held, loss):
            return [e**2 for e in curves[held.first()["fold"]][: self.rounds]]

    def fit(train, params, label):
        fitted.append(params.rounds)
        return Model(params.rounds)

    monkeypatch.setattr(md, "fit_boosted", fit)
    train = spark.range(60).select(F.col("id").cast("string").alias("id"), F.lit(1.0).alias("features"), F.lit(1.0).alias("target"))
    found = md.cv_rounds(train, BoostParams(rounds=64), folds=3)
    best, error = md.best_round([sum(c) / 3 for c in zip(*curves)], 2)
    assert (found.best_round, found.best_error) == (best, pytest.approx(error))
    if ends == (1, 1, 1):
        assert sum(fitted) == 12  # 48 where every fold began with 16


def test_equal_rows_are_fitted_as_one(spark, monkeypatch):
    rows = spark.range(3000).select(
        F.col("id").cast("string").alias("id"), (F.col("id") % 5).cast("double").alias("x"), (F.col("id") % 15).cast("double").alias("target"))
    ready = md.assemble(rows, ["x"])
    seen, laid_out = [], md.laid_out
    monkeypatch.setattr(md, "laid_out", lambda train, *rest: seen.append(train.count()) or laid_out(train, *rest))
    exact = BoostParams(max_depth=4, eta=1.0, gamma=0.0, subsample=1.0, colsample=1.0, min_child=1, rounds=1, partitions=8)
    model = md.fit_boosted(ready, exact)
    means = {r["x"]: r["m"] for r in rows.groupBy("x").agg(F.avg("target").alias("m")).collect()}
    assert seen == [15]
    assert all(model.predict(Vectors.dense([x])) == pytest.approx(m) for x, m in means.items())
    assert model.evaluateEachIteration(ready, "squared")[0] == pytest.approx(50 / 3)
    md.fit_boosted(ready, BoostParams(rounds=1, max_depth=2))
    assert seen == [15, 3000]
