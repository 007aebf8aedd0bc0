"""Selection fits its moves together, by passes over the rows that all of them share."""

import random

import numpy as np
import pytest

from shelfcast.operators import credit as cr


def flagged(spark, extra=lambda a, b: 0.0):
    rng = random.Random(7)
    rows = []
    for _ in range(400):
        a, b, kind = rng.gauss(0, 1), rng.gauss(5000, 900), rng.choice("xyz")
        chance = 1 / (1 + np.exp(-(a + (kind == "y"))))
        rows.append((a, b, kind, float(extra(a, b)), int(rng.random() < chance)))
    return spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, kind STRING, c DOUBLE, target_flag INT")


@pytest.mark.parametrize("extra", [lambda a, b: a * a, lambda a, b: 2 * a + 3])
def test_one_model_is_fitted_on_its_own(spark, monkeypatch, extra):
    train, fits, terms = flagged(spark, extra), [], ["a", "b", "kind", "c"]
    fit = cr.fit_logit
    monkeypatch.setattr(cr, "fit_logit", lambda *args, **options: fits.append(args[1]) or fit(*args, **options))
    model, moves = cr.stepwise_aic(train, terms)
    assert len(fits) == 1
    assert len(moves) > 1 and moves[0].aic == pytest.approx(fit(train, terms).aic, abs=1e-5)
    assert moves[-1].aic == pytest.approx(model.aic, abs=1e-5)
    assert all(later.aic < earlier.aic for earlier, later in zip(moves, moves[1:]))
