"""Selection from cross products against selection by exact fits alone."""

import random

import numpy as np
import pytest

from shelfcast.operators import credit as cr


def test_step_errors_are_weighted_least_squares():
    rng = np.random.default_rng(3)
    x, w, z = rng.normal(size=(50, 3)), rng.uniform(0.1, 1, 50), rng.normal(size=50)
    whole = np.column_stack([x, np.ones(50), z])
    products = whole.T @ (whole * w[:, None])
    for subset in ([], [0], [0, 2], [0, 1, 2]):
        own = np.column_stack([x[:, subset], np.ones(50)]) * np.sqrt(w)[:, None]
        left = z * np.sqrt(w) - own @ np.linalg.lstsq(own, z * np.sqrt(w), rcond=None)[0]
        assert cr.step_errors(products, [subset])[0] == pytest.approx(left @ left)


def test_same_end_as_exact_fits(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        a, b, c, kind = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1), rng.choice("xyz")
        chance = 1 / (1 + np.exp(-(1.2 * a + (kind == "y"))))
        rows.append((a, b, c, kind, int(rng.random() < chance)))
    train = spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, c DOUBLE, kind STRING, target_flag INT")
    terms = ["a", "b", "c", "kind"]
    quick, exact = (cr.stepwise_aic(train, terms, refits=n) for n in (1, None))
    assert set(quick[0].terms) == set(exact[0].terms) and quick[0].aic == pytest.approx(exact[0].aic)
    assert "a" in quick[0].terms
