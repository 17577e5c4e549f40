"""Cross-validated logistic fits in shared passes: optimality, the library's scores, and the number of passes."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from cohortlens.checks import models as checked
from cohortlens.operators.blocks import packed
from cohortlens.plans import logistic_folds as L
from cohortlens.plans import models as M


def rows(spark, n=700, width=5, folds=3):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, width)) * [1, 2, 0.5, 1, 1]
    x[:, 4] = 1.0
    y = (1 / (1 + np.exp(-(x[:, 0] - 0.4 * x[:, 1] + 0.3))) > rng.random(n)).astype(int)
    fold = np.arange(n) % folds
    made = [(int(f), int(b), Vectors.dense(a)) for f, b, a in zip(fold, y, x)]
    return spark.createDataFrame(made, ["fold", "label", "features"]).repartition(4), x, y, fold


@pytest.mark.parametrize("penalty", [1e-3, 0.05])
def test_fits_meet_the_optimality_conditions(spark, penalty):
    df, x, y, fold = rows(spark)
    labels = {f: (int((fold == f).sum()), int(y[fold == f].sum())) for f in range(3)}
    found = L.fit(packed(df, fold="fold"), 5, [0, 1, 2], penalty, [0.0, 0.5, 1.0], labels)
    for (f, mix), beta in found.items():
        a, b = x[fold != f], y[fold != f]
        p = 1 / (1 + np.exp(-(beta[0] + a @ beta[1:])))
        slope = a.T @ (p - b) / len(b) + penalty * (1 - mix) * beta[1:]
        on = beta[1:] != 0
        assert abs((p - b).mean()) < 1e-6
        assert np.abs(slope[on] + penalty * mix * np.sign(beta[1:][on])).max(initial=0) < 1e-6
        assert (np.abs(slope[~on]) <= penalty * mix + 1e-6).all()


def test_scores_equal_the_librarys(spark):
    df, *_ = rows(spark)
    tried = M.cross_validated(M.logistic(700), {"elasticNetParam": [0.0, 0.5]}, folds=3).fit(df).avgMetrics
    assert L.accuracies(df, 5, 1 / 700, [0.0, 0.5], 3) == pytest.approx(tried, abs=2e-3)


def test_rows_of_one_label_and_empty_folds(spark):
    df, *_ = rows(spark)
    ones = df.filter("label = 1")
    assert L.accuracies(ones, 5, 0.01, [0.0, 0.5], 3) == [1.0, 1.0]
    with pytest.raises(ValueError, match="fold 3"):
        L.accuracies(df, 5, 0.01, [0.5], 4)


def test_the_query_takes_no_job_per_fold(spark, tables, monkeypatch):
    """One fit of the library per fold and mix took hundreds of passes."""
    df, *_ = rows(spark, folds=10)
    monkeypatch.setattr(checked, "data", lambda t: df.selectExpr("*", "false AS is_dev"))
    monkeypatch.setattr(checked, "FULL", checked.FULL[:5])
    passes = []
    counted = L.summed
    monkeypatch.setattr(L, "summed", lambda *a, **k: passes.append(1) or counted(*a, **k))
    assert len(checked.cv_score(tables).collect()) == 2
    assert 3 <= len(passes) <= 25
