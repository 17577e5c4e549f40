"""The network's fit against the library's: the same weights mean the same, and as low a loss in numpy sums."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from cohortlens.plans import models as M
from cohortlens.plans import perceptron_fit as P


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] > 0).astype(int)
    made = [(int(b), Vectors.dense(a)) for a, b in zip(x, y)]
    return spark.createDataFrame(made, ["label", "features"]).repartition(3), x, y


def test_gradient_equals_differences():
    rng = np.random.default_rng(5)
    layers = [3, 4, 3, 2]
    flat = rng.normal(size=3 * 4 + 4 + 4 * 3 + 3 + 3 * 2 + 2)
    x, y = rng.normal(size=(6, 3)), rng.integers(0, 2, 6)
    slope = np.concatenate(P.gradient(P.shaped(flat, layers), x, y)[1])
    for at in range(len(flat)):
        shift = np.zeros(len(flat))
        shift[at] = 1e-6
        up, down = (P.gradient(P.shaped(flat + s, layers), x, y)[0] for s in (shift, -shift))
        assert slope[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_fit_is_as_good_as_the_librarys_and_its_model_means_the_same(rows):
    df, x, y = rows
    ours = M.perceptron(3, (6, 5), 60)
    assert isinstance(ours, M.Perceptron)
    model = ours.fit(df)
    theirs = ours._estimator.fit(df)

    def loss(m):
        return P.gradient(P.shaped(np.asarray(m.weights), [3, 6, 5, 2]), x, y)[0] / len(y)

    assert loss(model) <= loss(theirs) + 0.02
    assert M.chosen_parameters(model) == M.chosen_parameters(theirs)
    found = model.transform(df).select("features", "probability").collect()
    net = P.shaped(np.asarray(model.weights), [3, 6, 5, 2])
    for r in found[:20]:
        v = r.features.toArray()
        for w, b in net[:-1]:
            v = 1 / (1 + np.exp(-(v @ w + b)))
        e = np.exp(v @ net[-1][0] + net[-1][1])
        assert r.probability[1] == pytest.approx(e[1] / e.sum(), abs=1e-9)
