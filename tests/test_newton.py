"""Newton steps against plain numpy, and the defined results where there is no optimum."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from cohortlens.plans import newton


def rows(spark, x, y, parts=3):
    made = [(Vectors.dense(v), None if b is None else int(b)) for v, b in zip(x, y)]
    return spark.createDataFrame(made, ["features", "label"]).repartition(parts)


def plain(x, y, inverse_penalty):
    """Gradient descent with a fixed small step, far more rounds than needed."""
    x1 = np.column_stack((np.ones(len(x)), x))
    keep = np.r_[0.0, np.full(x.shape[1], 1 / inverse_penalty)]
    step = 1 / (np.linalg.norm(x1, 2) ** 2 / 4 + keep.max())
    beta = np.zeros(x1.shape[1])
    for _ in range(60_000):
        beta -= step * (x1.T @ (1 / (1 + np.exp(-x1 @ beta)) - y) + keep * beta)
    return beta


def problem(seed, n=200, width=3, shift=0.5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    return x, (x @ rng.normal(size=width) + rng.logistic(size=n) > shift).astype(int)


@pytest.mark.parametrize("penalty", [1.0, 0.1])
def test_equals_plain_descent(spark, penalty):
    x, y = problem(1)
    fit = newton.fit(rows(spark, x, y), 3, penalty)
    assert np.r_[fit.intercept, fit.coef] == pytest.approx(plain(x, y, penalty), abs=1e-7)
    assert np.abs(fit.gradient).max() < 1e-6 and fit.rounds < 10


def test_partitioning_changes_nothing(spark):
    x, y = problem(2)
    one, many = (newton.fit(rows(spark, x, y, parts), 3) for parts in (1, 9))
    assert one.coef == pytest.approx(many.coef, abs=1e-12)


def test_separable_rows_with_wide_scales(spark):
    x = np.array([[-3e4, 1.0], [-2e4, 0.0], [2e4, 1.0], [3e4, 0.0]] * 5)
    fit = newton.fit(rows(spark, x, x[:, 0] > 0), 2)
    assert fit.coef[0] > 0 and np.abs(fit.gradient).max() < 1e-3


def test_one_label_no_rows_and_unknown_labels(spark):
    x, y = problem(3, n=20)
    for label, intercept in ((0, -np.inf), (1, np.inf)):
        fit = newton.fit(rows(spark, x, [label] * 20), 3)
        assert fit.intercept == intercept and not fit.coef.any()
    assert newton.fit(rows(spark, x, y).limit(0), 3).intercept == 0.0
    known = newton.fit(rows(spark, x, y), 3)
    more = newton.fit(rows(spark, np.vstack((x, x)), [*y, *[None] * 20]), 3)
    assert known.coef == pytest.approx(more.coef, abs=1e-9)
