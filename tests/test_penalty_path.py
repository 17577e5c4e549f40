import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from cohortlens.plans import penalty_path


@pytest.fixture(scope="module")
def rows(spark):
    random = np.random.default_rng(3)
    x = random.normal(size=(400, 6)) * [1, 2, 3, 1, 1, 0]
    y = x @ [2.0, 0.0, -1.0, 0.0, 0.5, 0.0] + 3 + random.normal(size=400)
    data = [(int(i % 5), float(v), *map(float, r)) for i, (r, v) in enumerate(zip(x, y))]
    names = [f"x{i}" for i in range(6)]
    frame = spark.createDataFrame(data, ["fold", "label", *names]).repartition(3)
    return VectorAssembler(inputCols=names, outputCol="features").transform(frame)


@pytest.mark.parametrize("mix", [1.0, 0.3])
def test_path_equals_the_library_fit(rows, mix):
    sums = sum(np.array(r.sums).reshape(8, 8) for r in penalty_path.moments(rows, 6).collect())
    for (intercept, coef), penalty in zip(
        penalty_path.path(sums, mix, np.array([0.5, 0.1, 0.01]), False), (0.5, 0.1, 0.01)
    ):
        fit = LinearRegression(elasticNetParam=mix, regParam=penalty, standardization=False, tol=1e-10).fit(rows)
        # The library divides by the deviation of the label before it applies the penalty.
        assert penalty_path.optimal(sums, coef, penalty, mix, False)
        if mix == 1.0:
            assert np.allclose(coef, fit.coefficients.toArray(), atol=2e-3)
            assert abs(intercept - fit.intercept) < 5e-3


def test_cross_validated_error_equals_direct_fits(rows):
    tried, _ = penalty_path.cross_validate(rows, 6, [1.0], steps=4)
    got = {r.step: r.mse for r in tried.collect()}
    table = rows.toPandas()
    x = np.stack([v.toArray() for v in table.features])
    y, fold = table.label.to_numpy(), table.fold.to_numpy()
    full = np.column_stack((np.ones(len(y)), x, y))
    chosen = penalty_path.penalties(full.T @ full, 1.0, 4, 1e-3, False)
    errors = np.zeros(4)
    for f in range(5):
        train = full[fold != f]
        for i, (b0, b) in enumerate(penalty_path.path(train.T @ train, 1.0, chosen, False)):
            errors[i] += ((y[fold == f] - b0 - x[fold == f] @ b) ** 2).sum()
    assert np.allclose([got[i] for i in range(4)], errors / len(y))


def test_select_drops_what_does_not_matter(rows):
    best = penalty_path.select(rows, 6, [0.5, 1.0], steps=30)
    assert best["coef"][5] == 0 and best["coef"][0] > 1.5 and best["mse"] < 1.3
