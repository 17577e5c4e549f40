"""Correlations by both ways, landmarks and the quantile transform against numpy."""

import numpy as np
import pandas as pd
import pytest

from cohortlens.operators import stats
from cohortlens.plans import transforms


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame(rng.normal(1e6, 1, (300, 4)), columns=list("abcd"))
    frame["b"] += frame["a"]
    frame.loc[::7, "b"] = np.nan
    frame["e"] = 5.0
    frame["f"] = rng.integers(0, 4, 300).astype(float)
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in "abcdef")).repartition(5), frame


def test_both_ways_of_correlation(numbers, monkeypatch):
    rows, frame = numbers
    want = frame.corr()
    for few in (20, 1):
        monkeypatch.setattr(stats, "FEW", few)
        got = {(r.column_a, r.column_b): r.corr for r in stats.corr_pairs(rows, list("abcdef")).collect()}
        assert len(got) == 15
        for (a, b), v in got.items():
            if "e" in (a, b):
                assert v is None
            else:
                assert v == pytest.approx(want.loc[a, b], abs=2e-6)
    assert stats.corr_pairs(rows, ["a"]).count() == 0


@pytest.mark.parametrize("n", [2, 11, 1000])
def test_landmarks_are_exact(numbers, n):
    rows, frame = numbers
    found = stats.exact_landmarks(rows, list("abef"), n).collect()
    got = {c: [r.value for r in sorted(found, key=lambda r: r.i) if r.column_name == c] for c in "abef"}
    for c, values in got.items():
        want = np.nanquantile(frame[c], np.arange(n) / (n - 1))
        assert len(values) == n and np.allclose(values, want, rtol=0, atol=1e-8)


def test_the_transform_leaves_unknown_values_unknown(spark):
    rows = spark.createDataFrame([(float(i) if i % 5 else None, None) for i in range(50)], "x double, y double")
    got = transforms.quantile_normal(rows, ["x", "y"]).toPandas()
    assert got["x"].isna().sum() == 10 and got["y"].isna().all()
    assert transforms.quantile_normal(rows.limit(0), ["x"]).count() == 0
