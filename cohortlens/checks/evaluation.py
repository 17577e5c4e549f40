"""Registered queries of the evaluation metrics, on a deterministic score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.checks import views as V
from cohortlens.checks.registry import check
from cohortlens.functions import expressions as X
from cohortlens.plans import evaluation as E
from cohortlens.sources import domain as D
from cohortlens.sources.readers import Tables


def predicted(t: Tables) -> DataFrame:
    return D.scored(t).withColumn("prediction", E.threshold("score"))


@check(
    "threshold_labels",
    """SELECT emplid, score, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS at_half,
  CASE WHEN score > 0.6 THEN 1 ELSE 0 END AS at_six_tenths FROM v_scored""",
)
def threshold_labels(t: Tables) -> DataFrame:
    return D.scored(t).select(
        "emplid",
        "score",
        E.threshold("score", 0.5).alias("at_half"),
        E.threshold("score", 0.6).alias("at_six_tenths"),
    )


@check(
    "confusion",
    """SELECT l.v AS label, p.v AS prediction, count(s.emplid) AS n
FROM (VALUES (0), (1)) AS l(v), (VALUES (0), (1)) AS p(v), v_pred s
WHERE s.label = l.v AND s.prediction = p.v GROUP BY 1, 2""",
)
def confusion(t: Tables) -> DataFrame:
    return E.confusion(predicted(t))


@check(
    "accuracy",
    f"""SELECT is_dev, count(*) AS n, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy
FROM (SELECT *, {V.DEV} AS is_dev FROM v_pred) GROUP BY 1""",
)
def accuracy(t: Tables) -> DataFrame:
    return E.accuracy(predicted(t).withColumn("is_dev", X.is_dev("emplid")), ["is_dev"])


@check(
    "prf",
    """SELECT tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(tp + fn AS DOUBLE) AS recall,
  2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) AS f1 FROM v_cells""",
)
def prf(t: Tables) -> DataFrame:
    return E.precision_recall_f1(predicted(t))


@check(
    "roc_auc",
    """SELECT round((sum(CASE WHEN label = 1 THEN r ELSE 0 END) - p * (p + 1) / 2.0) / (p * CAST(n AS DOUBLE)), 6)
  AS roc_auc
FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r,
    count(*) FILTER (label = 1) OVER () AS p, count(*) FILTER (label = 0) OVER () AS n FROM v_scored)
GROUP BY p, n""",
)
def roc_auc(t: Tables) -> DataFrame:
    return E.roc_auc(D.scored(t)).select(X.rounded("roc_auc").alias("roc_auc"))


@check(
    "roc_on_labels",
    """SELECT round((tp / CAST(tp + fn AS DOUBLE) + tn / CAST(tn + fp AS DOUBLE)) / 2, 6) AS roc_on_labels
FROM v_cells""",
)
def roc_on_labels(t: Tables) -> DataFrame:
    return E.roc_on_labels(predicted(t)).select(X.rounded("roc_on_labels").alias("roc_on_labels"))


_CLASSES = """SELECT '0' AS class, tn / CAST(tn + fn AS DOUBLE) AS p, tn / CAST(tn + fp AS DOUBLE) AS r,
  2 * tn / CAST(2 * tn + fp + fn AS DOUBLE) AS f, tn + fp AS support FROM v_cells
UNION ALL SELECT '1', tp / CAST(tp + fp AS DOUBLE), tp / CAST(tp + fn AS DOUBLE),
  2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), tp + fn FROM v_cells"""


@check(
    "class_report",
    f"""WITH k AS MATERIALIZED ({_CLASSES})
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM k
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6),
  CAST(sum(support) AS BIGINT) FROM k
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6),
  round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM k""",
)
def class_report(t: Tables) -> DataFrame:
    report = E.class_report(predicted(t))
    return report.withColumns({c: X.rounded(c) for c in ("precision", "recall", "f1")})


@check(
    "ppv_npv",
    "SELECT tp / CAST(tp + fp AS DOUBLE) AS ppv, tn / CAST(tn + fn AS DOUBLE) AS npv FROM v_cells",
)
def ppv_npv(t: Tables) -> DataFrame:
    return E.predictive_values(predicted(t))


@check(
    "baseline_lift",
    """SELECT round(y, 6) AS base_rate, round(greatest(y, 1 - y), 6) AS majority_accuracy,
  round(z, 6) AS zero_accuracy, round(a, 6) AS accuracy, round(a - (1 - y), 6) + 0.0 AS lift
FROM (SELECT (tp + fn) / CAST(tp + fp + fn + tn AS DOUBLE) AS y,
  (tn + fp) / CAST(tp + fp + fn + tn AS DOUBLE) AS z, (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS a
  FROM v_cells)""",
)
def baseline_lift(t: Tables) -> DataFrame:
    found = E.baseline_lift(predicted(t))
    return found.select(*[X.rounded(c).alias(c) for c in found.columns])


@check(
    "accuracy_matrix",
    f"""SELECT *, dev_accuracy - lag(dev_accuracy) OVER (ORDER BY t) AS dev_gain FROM (
SELECT s.t, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FILTER (is_dev) AS dev_accuracy,
  avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FILTER (NOT is_dev) AS train_accuracy
FROM (SELECT p.label, p.prediction, {V.semester("term_code - cohort")} AS semester_index,
    substr(md5(concat(p.emplid, '|42')), 1, 4) < '199a' AS is_dev
  FROM v_enrol e JOIN v_pred p ON p.emplid = e.emplid WHERE term_code >= cohort) r
JOIN (SELECT DISTINCT {V.semester("term_code - cohort")} AS t FROM v_enrol WHERE term_code >= cohort) s
  ON r.semester_index <= s.t
GROUP BY 1)""",
)
def accuracy_matrix(t: Tables) -> DataFrame:
    rows = (
        D.enrolments(t, science=False)
        .filter(F.col("term_code") >= F.col("cohort"))
        .select("emplid", X.semester_index(F.col("term_code") - F.col("cohort")).alias("t"))
    )
    marked = predicted(t).withColumn("is_dev", X.is_dev("emplid"))
    return E.accuracy_matrix(rows.join(marked, "emplid"))
