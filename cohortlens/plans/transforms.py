"""Quantile-to-normal transform of numeric columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.stats import exact_landmarks

# Coefficients of a public rational approximation of the inverse normal distribution.
CENTRE_NUM = [
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
]
CENTRE_DEN = [
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
]
TAIL_NUM = [
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
]
TAIL_DEN = [
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0,
]
TAIL = 0.02425
# Fixed value: outputs are clipped at the normal quantile of this share and of its complement.
EDGE = 1e-7


def _polynomial(coefficients: list[float], x: Column) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + c
    return value


def inverse_normal(share: Column) -> Column:
    """Standard normal quantile as a column expression."""
    p = F.greatest(F.least(share, F.lit(1 - EDGE)), F.lit(EDGE))
    d = p - 0.5
    centre = d * _polynomial(CENTRE_NUM, d * d) / _polynomial(CENTRE_DEN, d * d)
    q = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _polynomial(TAIL_NUM, q) / _polynomial(TAIL_DEN, q)
    return (
        F.when(p < TAIL, tail).when(p > 1 - TAIL, -tail).otherwise(centre)
    )


def quantile_normal(df: DataFrame, columns: list[str], landmarks: int = 1000) -> DataFrame:
    """Replace each column by the normal quantile of its interpolated rank.

    The ranks come from a fixed number of quantile landmarks per column, however large the input is. The
    landmarks are exact, so repeated runs give the same figures.
    A value equal to several landmarks takes the middle of their ranks. Looking a value up among the
    landmarks is a binary search over Arrow batches; the normal quantile is a built-in expression.
    """
    found: dict[str, list[float]] = {}
    # ``landmarks`` rows per column.
    for row in sorted(exact_landmarks(df, columns, landmarks).collect(), key=lambda r: (r.column_name, r.i)):
        found.setdefault(row.column_name, []).append(row.value)

    def rank(marks: list[float]):
        points = np.asarray(marks)

        @F.pandas_udf("double")
        def share_of(values: pd.Series) -> pd.Series:
            x = values.to_numpy(dtype=float)
            below = np.searchsorted(points, x, "left")
            upto = np.searchsorted(points, x, "right")
            low = points[np.clip(below - 1, 0, len(points) - 1)]
            high = points[np.clip(below, 0, len(points) - 1)]
            gap = np.where(high > low, high - low, 1.0)
            between = np.clip(below - 1 + (x - low) / gap, 0, len(points) - 1)
            spot = np.where(upto > below, (below + upto - 1) / 2.0, between)
            return pd.Series(np.where(np.isnan(x), np.nan, spot / (len(points) - 1)))

        return share_of

    known = [c for c in columns if c in found]
    ranked = df.withColumns({c: rank(found[c])(F.col(c).cast("double")) for c in known})
    return ranked.withColumns({c: F.when(F.col(c).isNotNull() & ~F.isnan(c), inverse_normal(F.col(c))) for c in known})
