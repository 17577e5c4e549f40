"""Descent with an elastic-net penalty against the batch optimum; the same fit however rows are placed."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from cohortlens.plans import sparse_sgd


def problem(n=1200):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 6))
    x[: n // 3] = x[0]
    y = (x[:, 0] - 0.7 * x[:, 1] + rng.logistic(size=n) > 0.3).astype(float)
    return x, y


def loss(beta, x, y, penalty, mix):
    z = beta[0] + x @ beta[1:]
    return np.mean(np.logaddexp(0, z) - y * z) + penalty * (
        mix * np.abs(beta[1:]).sum() + (1 - mix) / 2 * (beta[1:] ** 2).sum()
    )


def optimum(x, y, penalty, mix):
    x1 = np.column_stack((np.ones(len(x)), x))
    step, beta = 1 / (np.linalg.norm(x1, 2) ** 2 / 4 / len(x) + penalty), np.zeros(x1.shape[1])
    for _ in range(20_000):
        slope = x1.T @ (1 / (1 + np.exp(-x1 @ beta)) - y) / len(x)
        slope[1:] += penalty * (1 - mix) * beta[1:]
        beta = beta - step * slope
        beta[1:] = np.sign(beta[1:]) * np.maximum(np.abs(beta[1:]) - step * penalty * mix, 0)
    return beta


def frame(spark, x, y, parts):
    return spark.createDataFrame([(Vectors.dense(a), int(b)) for a, b in zip(x, y)], ["features", "label"]).repartition(parts)


@pytest.mark.parametrize("penalty, mix", [(0.05, 1.0), (0.01, 0.5)])
def test_loss_is_close_to_the_optimum(spark, monkeypatch, penalty, mix):
    monkeypatch.setattr(sparse_sgd, "SHARD_ROWS", 300)
    x, y = problem()
    made = sparse_sgd.fit(frame(spark, x, y, 4), 6, penalty, mix)
    best = optimum(x, y, penalty, mix)
    assert loss(made, x, y, penalty, mix) <= loss(best, x, y, penalty, mix) * 1.005
    if mix == 1.0:
        assert ((made[1:] != 0) == (best[1:] != 0)).mean() >= 5 / 6


def test_placing_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(sparse_sgd, "SHARD_ROWS", 300)
    x, y = problem()
    one, many = (sparse_sgd.fit(frame(spark, x, y, parts), 6, 0.01, 0.5, rounds=2) for parts in (1, 7))
    assert one == pytest.approx(many, abs=1e-12)
    assert not sparse_sgd.fit(frame(spark, x, y, 1).limit(0), 6, 0.01, 0.5, rounds=2).any()
