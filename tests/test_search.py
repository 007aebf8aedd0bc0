import pytest
from pyspark.ml.linalg import Vectors

from shelfcast.operators import tuning
from shelfcast.operators.models import BoostParams, CvResult, cv_rounds
from shelfcast.operators.tuning import SearchSpace, random_search, read_trials

BASE = BoostParams(rounds=3, partitions=2)


def matrix(spark):
    rows = [(i, Vectors.dense(float(i % 7), float(i % 3)), float(i % 7) + 0.1 * (i % 5)) for i in range(200)]
    return spark.createDataFrame(rows, ["id", "features", "target"])


def test_a_lost_search_goes_on(spark, tmp_path, monkeypatch):
    """The driver is lost in the third trial; the search started again fits only what is missing and ends the same."""
    train, ledger = matrix(spark), str(tmp_path / "ledger")
    options = {"space": SearchSpace(max_depth=(2, 3)), "trials": 4, "base": BASE, "folds": 2, "workers": 1}
    whole = random_search(train, **options)
    fitted = []

    def until(last):
        def counted(train, params, *args, **kwargs):
            if len(fitted) == last:
                raise KeyboardInterrupt
            fitted.append(params)
            return cv_rounds(train, params, *args, **kwargs)

        return counted

    monkeypatch.setattr(tuning, "cv_rounds", until(2))
    with pytest.raises(KeyboardInterrupt):
        random_search(train, **options, ledger=ledger)
    assert sorted(r["trial"] for r in read_trials(spark, ledger).collect()) == [1, 2]
    monkeypatch.setattr(tuning, "cv_rounds", until(4))
    again = random_search(train, **options, ledger=ledger)
    assert fitted == [t.params for t in whole.trials] and len(fitted) == 4
    assert [t.params for t in again.trials] == [t.params for t in whole.trials]
    for one, other in zip(again.trials, whole.trials):
        assert one.result.curve == pytest.approx(other.result.curve) and one.result.best_round == other.result.best_round
    # Nothing is left to fit; a ledger of other draws or other rows is refused.
    assert random_search(train, **options, ledger=ledger).best == again.best and len(fitted) == 4
    with pytest.raises(ValueError):
        random_search(train, **options, seed=7, ledger=ledger)
    with pytest.raises(ValueError):
        random_search(train.where("id < 100"), **options, ledger=ledger)


def planned(curves, seen):
    """A cross-validation that follows given curves in blocks of two rounds."""

    def run(train, params, folds, patience, key, workers, hopeless):
        curve = curves[params.seed]
        for rounds in range(2, len(curve) + 1, 2):
            part = tuple(curve[:rounds])
            if rounds == len(curve):
                return CvResult(part, len(part), min(part))
            if hopeless and hopeless(part):
                seen.append(params.seed)
                return CvResult(part, len(part), min(part), stopped=True)

    return run


def test_hopeless_trials_stop_at_the_running_median(spark, monkeypatch):
    levels = [5.0, 4.0, 3.0, 2.0, 1.0, 6.0, 2.5, 0.5]
    draws, stopped = iter(range(len(levels))), []
    monkeypatch.setattr(SearchSpace, "draw", lambda self, rng, base: BoostParams(seed=next(draws)))
    curves = {i: [level + 0.1 * (6 - r) for r in range(6)] for i, level in enumerate(levels)}
    monkeypatch.setattr(tuning, "cv_rounds", planned(curves, stopped))
    result = random_search(matrix(spark), trials=len(levels), workers=1, prune=True)
    assert stopped == [5]
    assert [t.result.stopped for t in result.trials] == [i == 5 for i in range(len(levels))]
    assert result.best.params.seed == 7
    table = result.table(spark).where("stopped").collect()
    assert [r["trial"] for r in table] == [6]
