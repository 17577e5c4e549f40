"""Registered queries of the logistic model by Newton steps, which SQL takes one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.checks.models import _LABEL, _rounded, FULL, HISTORY, SEMESTER, data
from cohortlens.checks.registry import check, part
from cohortlens.plans import evaluation as E
from cohortlens.plans import models as M
from cohortlens.plans import newton
from cohortlens.sources.readers import Tables

# Steps that SQL takes, more than the fit needs: further ones change nothing.
STEPS = 9


def _known(columns: list[str]) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)


def _vector(columns: list[str]) -> str:
    return "[1.0::DOUBLE, " + ", ".join(f"CAST({c} AS DOUBLE)" for c in columns) + "]"


def _steps(name: str, columns: list[str]) -> str:
    """Parts of the whole fit on ``columns``; the name of the part with the last coefficients."""
    width = len(columns) + 1
    part(
        f"v_{name}_rows",
        f"""SELECT CAST({_LABEL} AS DOUBLE) AS y, {_vector(columns)} AS x FROM v_features
WHERE semester_index <= {SEMESTER} AND NOT is_dev AND {_LABEL} IS NOT NULL AND {_known(columns)}""",
    )
    part(f"v_{name}_b0", f"SELECT [{', '.join(['0.0::DOUBLE'] * width)}] AS b")
    for step in range(STEPS + 1):
        before = f"v_{name}_b{step}"
        part(
            f"v_{name}_p{step}",
            f"SELECT x, y, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM v_{name}_rows, {before}",
        )
        part(
            f"v_{name}_g{step}",
            f"""SELECT i, s + CASE WHEN i > 1 THEN b[i] ELSE 0 END AS g FROM (
  SELECT i, sum((p - y) * x[i]) AS s FROM v_{name}_p{step}, range(1, {width + 1}) t(i) GROUP BY i), {before}""",
        )
        if step == STEPS:
            break
        part(
            f"v_{name}_h{step}",
            f"""SELECT i, list(h ORDER BY j) AS h FROM (
  SELECT i, j, sum(p * (1 - p) * x[i] * x[j]) + CASE WHEN i = j AND i > 1 THEN 1 ELSE 0 END AS h
  FROM v_{name}_p{step}, range(1, {width + 1}) s(i), range(1, {width + 1}) t(j) GROUP BY i, j) GROUP BY i""",
        )
        # Elimination without exchanges, which a positive definite matrix allows.
        part(
            f"v_{name}_b{step + 1}",
            f"""SELECT [v - m[i][{width + 1}] for v, i in b] AS b FROM {before}, (
  WITH RECURSIVE e(k, m) AS (
    SELECT CAST(1 AS BIGINT), list(list_append(h.h, g.g) ORDER BY h.i)
    FROM v_{name}_h{step} h JOIN v_{name}_g{step} g ON g.i = h.i
    UNION ALL
    SELECT k + 1, [CASE WHEN i = k THEN [v / row[k] for v in row]
      ELSE [v - row[k] * m[k][j] / m[k][k] for v, j in row] END for row, i in m]
    FROM e WHERE k <= {width})
  SELECT m FROM e WHERE k = {width + 1})""",
        )
    return f"v_{name}_b{STEPS}"


def _ranked(name: str, columns: list[str]) -> str:
    return f"""SELECT feature, round(b[f + 1], 6) + 0.0 AS coef, round(g.g, 6) + 0.0 AS gradient
FROM (SELECT unnest([{", ".join(repr(c) for c in columns)}]) AS feature, unnest(range(1, {len(columns) + 1})) AS f),
  v_{name}_b{STEPS}, v_{name}_g{STEPS} g WHERE g.i = f + 1"""


_FULL = _steps("newton", FULL)
_steps("history", HISTORY)


def _fit(t: Tables, columns: list[str]) -> tuple[newton.Fit, DataFrame]:
    rows = data(t, columns)
    return newton.fit(M.train_part(rows), len(columns)), rows


@check("logistic_newton", _ranked("newton", FULL))
def logistic_newton(t: Tables) -> DataFrame:
    """Coefficients on all features, and the gradient of the penalised loss at them."""
    return _rounded(newton.ranking(*_fit(t, FULL), FULL), ["coef", "gradient"])


@check("coef_ranking", f"SELECT feature, coef FROM ({_ranked('history', HISTORY)})")
def coef_ranking(t: Tables) -> DataFrame:
    return _rounded(newton.ranking(*_fit(t, HISTORY), HISTORY).drop("gradient"), ["coef"])


@check(
    "logistic_confusion",
    f"""SELECT is_dev, count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp,
  count(*) FILTER (NOT p AND y) AS fn, count(*) FILTER (NOT p AND NOT y) AS tn FROM (
  SELECT is_dev, {_LABEL} = 1 AS y, 1 / (1 + exp(-list_dot_product({_vector(FULL)}, b))) > 0.5 AS p
  FROM v_features, {_FULL} WHERE semester_index <= {SEMESTER} AND (is_dev OR ({_known(FULL)}))) GROUP BY is_dev""",
)
def logistic_confusion(t: Tables) -> DataFrame:
    """Counts of the confusion matrix of both parts, by the fit of ``logistic_newton``."""
    model, rows = _fit(t, FULL)
    return E.confusion_cells(newton.predict(model, rows), ["is_dev"]).select("is_dev", "tp", "fp", "fn", "tn")
