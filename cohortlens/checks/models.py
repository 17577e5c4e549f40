"""Registered queries of the models: fitted on the whole feature table, checked by rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.checks import views as V
from cohortlens.checks.registry import check, part
from cohortlens.checks.student import features
from cohortlens.operators.encode import encoded_names
from cohortlens.plans import evaluation as E
from cohortlens.plans import logistic_folds
from cohortlens.plans import models as M
from cohortlens.plans import network as N
from cohortlens.plans import penalty_path as P
from cohortlens.plans import sampling, sparse_sgd, students, transforms
from cohortlens.session import cut_lineage
from cohortlens.sources.readers import Tables

YEARS = 4.0
SEMESTER = 3
SETS = M.feature_sets(V.ENCODING)
FULL = SETS["full"]
HISTORY = SETS["history"]
DEMOGRAPHIC = {*encoded_names(V.ENCODING), "gpa_hs"}
KEYS = ["emplid", "cohort", "term_code", "plan_cd", "gendr_m"]


def data(t: Tables, columns: list[str] = FULL, balance: bool = False, folds: int = 10) -> DataFrame:
    return M.held(
        M.seq_data(features(t), SEMESTER, YEARS, columns, balance, encoding=V.ENCODING, folds=folds)
    )


def judged(t: Tables, name: str, estimator, cut: float = 0.5) -> DataFrame:
    return M.evaluate(name, estimator, data(t), len(FULL), cut)[1]


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + 0.0 for c in columns})


# The training rows of the sampling queries, with the ids their draws depend on.
_LABEL = M.response(YEARS)
part(
    "v_train_rows",
    f"""SELECT md5(concat_ws('|', {", ".join(f"CAST({k} AS VARCHAR)" for k in KEYS)})) AS row_id,
  CAST({_LABEL} AS INT) AS label, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FULL)}
FROM v_features WHERE semester_index <= {SEMESTER} AND NOT is_dev""",
)
part(
    "v_minor",
    """SELECT CASE WHEN one <= zero THEN 1 ELSE 0 END AS minor, least(one, zero) AS small,
  abs(one - zero) AS wanted
FROM (SELECT count(*) FILTER (WHERE label = 1) AS one, count(*) FILTER (WHERE label = 0) AS zero FROM v_train_rows)""",
)
part(
    "v_copies",
    """SELECT *, wanted // small + CASE WHEN place <= wanted % small THEN 1 ELSE 0 END AS copies FROM (
  SELECT r.*, m.small, m.wanted, row_number() OVER (ORDER BY
    CAST('0x' || substr(md5(row_id || '|0'), 1, 15) AS BIGINT),
    CAST('0x' || substr(md5(row_id || '|1'), 1, 15) AS BIGINT)) AS place
  FROM v_train_rows r JOIN v_minor m ON r.label = m.minor)""",
)
_SHOWN = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in FULL)
_KEPT = f"SELECT row_id, label, FALSE AS synthetic, {_SHOWN} FROM v_train_rows"
_DRAW = "(CAST('0x' || substr(md5(row_id || '|' || draw || '|{}'), 1, 8) AS BIGINT) + 1) / 4294967296.0::DOUBLE"


_GAP = "round(" + " + ".join(f"(x.{c} - y.{c}) * (x.{c} - y.{c})" for c in FULL) + ", 9)"


def _interpolated(counted: str) -> str:
    """Synthetic rows of a subquery with ``copies`` per minority row."""
    return f"""SELECT a.row_id, a.label, TRUE AS synthetic,
  {", ".join(f"round(a.{c} + (b.{c} - a.{c}) * (1 - a.u2), 6) + 0.0 AS {c}" for c in FULL)}
FROM (
  SELECT *, {_DRAW.format(1)} AS u1, {_DRAW.format(2)} AS u2
  FROM (SELECT *, unnest(range(1, copies + 1)) AS draw FROM {counted} WHERE copies > 0)
) a JOIN (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY gap, row_id) AS pick FROM (
    SELECT x.row_id AS key, y.*, {_GAP} AS gap FROM v_copies x JOIN v_copies y ON x.row_id <> y.row_id)
) b ON b.key = a.row_id
  AND b.pick = CAST(1 + floor((1 - a.u1) * least({sampling.NEIGHBOURS}, a.small - 1)) AS INT)"""


@check(
    "assemble",
    f"""SELECT cohort, emplid, is_dev, CAST({_LABEL} AS INT) AS label,
  [{", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0" for c in FULL)}] AS features
FROM v_features WHERE semester_index <= {SEMESTER}
  AND (is_dev OR ({" AND ".join(f"{c} IS NOT NULL" for c in FULL)}))""",
)
def assemble(t: Tables) -> DataFrame:
    rows = M.seq_data(features(t), SEMESTER, YEARS, FULL, encoding=V.ENCODING)
    values = F.transform(M.vector_to_array("features"), lambda x: F.round(x, 6) + 0.0)
    return rows.select("cohort", "emplid", "is_dev", "label", values.alias("features"))


def _training_rows(t: Tables) -> DataFrame:
    return students.chunk(features(t), SEMESTER, V.ENCODING).filter(~F.col("is_dev"))


@check(
    "smote",
    f"{_KEPT} UNION ALL {_interpolated('v_copies')}",
)
def smote(t: Tables) -> DataFrame:
    return _rounded(sampling.smote(_training_rows(t), KEYS, FULL, _LABEL), FULL)


@check(
    "oversample",
    f"""{_KEPT} UNION ALL
SELECT row_id, label, TRUE AS synthetic, {_SHOWN}
FROM (SELECT *, unnest(range(1, copies + 1)) AS draw FROM v_copies WHERE copies > 0)""",
)
def oversample(t: Tables) -> DataFrame:
    return _rounded(sampling.random_oversample(_training_rows(t), KEYS, FULL, _LABEL), FULL)


part(
    "v_hard",
    f"""SELECT c.* EXCLUDE (copies), CAST(round(h.hardness / sum(h.hardness) OVER () * c.wanted) AS BIGINT) AS copies
FROM v_copies c JOIN (
  SELECT key, count(*) / {float(sampling.NEIGHBOURS)}::DOUBLE AS hardness FROM (
    SELECT x.row_id AS key, y.label <> x.label AS other,
      row_number() OVER (PARTITION BY x.row_id ORDER BY {_GAP}, y.row_id) AS rank
    FROM v_copies x JOIN v_train_rows y ON x.row_id <> y.row_id)
  WHERE rank <= {sampling.NEIGHBOURS} AND other GROUP BY key) h ON h.key = c.row_id""",
)


@check("adasyn", f"{_KEPT} UNION ALL {_interpolated('v_hard')}")
def adasyn(t: Tables) -> DataFrame:
    return _rounded(sampling.adasyn(_training_rows(t), KEYS, FULL, _LABEL), FULL)


# The landmark quantile transform: shares of 1,000 landmarks, then the rational approximation.
_SCALED = students.SCALED_PERFORMANCE
_MARKS = 1000
part(
    "v_scaled_values",
    " UNION ALL ".join(f"SELECT '{c}' AS c, CAST({c} AS DOUBLE) AS x FROM v_features" for c in _SCALED),
)
part(
    "v_marks",
    f"""SELECT c, unnest(quantile_cont(x, [{", ".join(repr(i / (_MARKS - 1)) for i in range(_MARKS))}])) AS mark
FROM v_scaled_values WHERE x IS NOT NULL GROUP BY c""",
)


def _poly(coefficients: list[float], x: str) -> str:
    value = f"({coefficients[0]!r}::DOUBLE)"
    for c in coefficients[1:]:
        value = f"({value} * {x} + ({c!r}::DOUBLE))"
    return value


_T = transforms
part(
    "v_ranked",
    f"""SELECT c, x, CASE WHEN upto > below THEN (below + upto - 1) / 2.0::DOUBLE
  ELSE greatest(0.0::DOUBLE, least({_MARKS - 1}.0::DOUBLE, below - 1 + (x - low) / CASE WHEN high > low THEN high - low ELSE 1.0::DOUBLE END))
  END / {float(_MARKS - 1)!r}::DOUBLE AS share
FROM (SELECT v.c, v.x, count(*) FILTER (m.mark < v.x) AS below, count(*) FILTER (m.mark <= v.x) AS upto,
    coalesce(max(m.mark) FILTER (m.mark < v.x), min(m.mark)) AS low,
    coalesce(min(m.mark) FILTER (m.mark >= v.x), max(m.mark)) AS high
  FROM (SELECT DISTINCT c, x FROM v_scaled_values WHERE x IS NOT NULL) v JOIN v_marks m ON m.c = v.c GROUP BY v.c, v.x)""",
)
part(
    "v_normal",
    f"""SELECT c, x, round(CASE WHEN p < {_T.TAIL} THEN t WHEN p > 1 - {_T.TAIL} THEN -t ELSE z END, 6) + 0.0 AS y FROM (
  SELECT c, x, p, d * {_poly(_T.CENTRE_NUM, "(d * d)")} / {_poly(_T.CENTRE_DEN, "(d * d)")} AS z,
    {_poly(_T.TAIL_NUM, "q")} / {_poly(_T.TAIL_DEN, "q")} AS t
  FROM (SELECT c, x, p, p - 0.5 AS d, sqrt(-2 * ln(least(p, 1 - p))) AS q FROM (
    SELECT c, x, greatest(least(share, 1 - {_T.EDGE!r}::DOUBLE), {_T.EDGE!r}::DOUBLE) AS p FROM v_ranked)))""",
)


@check(
    "quantile_normal",
    f"""SELECT f.emplid, f.cohort, f.term_code, f.plan_cd, {", ".join(f"n{i}.y AS {c}" for i, c in enumerate(_SCALED))}
FROM v_features f {" ".join(
    f"LEFT JOIN v_normal n{i} ON n{i}.c = '{c}' AND n{i}.x = CAST(f.{c} AS DOUBLE)" for i, c in enumerate(_SCALED)
)}""",
)
def quantile_normal(t: Tables) -> DataFrame:
    # Written once, as the landmarks and the result both read them.
    rows = cut_lineage(features(t).select("emplid", "cohort", "term_code", "plan_cd", *_SCALED))
    return _rounded(transforms.quantile_normal(rows, _SCALED), _SCALED)


@check("logistic_t")
def logistic_t(t: Tables) -> DataFrame:
    rows = data(t)
    return M.evaluate("logistic", M.logistic(M.train_part(rows).count()), rows, len(FULL))[1]


@check("logistic_balanced")
def logistic_balanced(t: Tables) -> DataFrame:
    rows = data(t, balance=True)
    return M.evaluate("logistic", M.logistic(M.train_part(rows).count()), rows, len(FULL))[1]


# The grids and rounds of the covered models.
FOREST_GRID = {"featureSubsetStrategy": ["1", "sqrt"]}
MIXES = [0.1, 0.5, 0.7, 0.9, 0.95, 0.975, 0.99, 0.995, 1.0]
NET_FOLDS = 100


@check("forest_t")
def forest_t(t: Tables) -> DataFrame:
    return judged(t, "forest", M.ForestSearch(FOREST_GRID["featureSubsetStrategy"], trees=100, depth=10))


@check("gbt_shallow")
def gbt_shallow(t: Tables) -> DataFrame:
    return judged(t, "gbt_shallow", M.boosted(100, depth=3, step=0.1))


@check("elastic_net")
def elastic_net(t: Tables) -> DataFrame:
    """The metrics of the chosen fit with the chosen mix and penalty."""
    best, predictions = M.elastic_net(data(t, folds=NET_FOLDS), len(FULL), MIXES)
    return M.judge(predictions).select(
        F.lit(best["mix"]).alias("mix"), F.lit(best["penalty"]).alias("penalty"), "*"
    )


@check("elastic_net_optimality", "SELECT TRUE AS optimal")
def elastic_net_optimality(t: Tables) -> DataFrame:
    """Whether the chosen fit meets the optimality conditions of its own problem on the training rows."""
    best, _ = M.elastic_net(data(t, folds=NET_FOLDS), len(FULL), MIXES)
    optimal = P.optimal(best["sums"], best["coef"], best["penalty"], best["mix"], scale=True)
    return t.spark.createDataFrame([(bool(optimal),)], "optimal boolean")


@check("mlp_t")
def mlp_t(t: Tables) -> DataFrame:
    return judged(t, "mlp", M.perceptron(len(FULL)))


# Inner units, classes of the last layer, and epochs of the covered network.
UNITS, CLASSES, EPOCHS = 256, 128, 6


@check("network_t")
def network_t(t: Tables) -> DataFrame:
    """The network on balanced training rows: metrics of both parts and the loss of the last epoch."""
    rows = data(t, balance=True)
    net, losses = N.fit(M.train_part(rows), [len(FULL), UNITS, CLASSES], ["cohort", "emplid"], EPOCHS)
    return M.judge(N.predict(net, rows)).withColumn("loss", F.lit(losses[-1][1]))


@check("sgd_elastic")
def sgd_elastic(t: Tables) -> DataFrame:
    """Weights by stochastic descent with half of the penalty on their sizes, half on their squares."""
    beta = sparse_sgd.fit(M.train_part(data(t)), len(FULL), penalty=0.01, mix=0.5)
    rows = [(c, float(v), bool(v != 0)) for c, v in zip(FULL, beta[1:])]
    return t.spark.createDataFrame(rows, "feature string, coef double, selected boolean")


@check("cv_score")
def cv_score(t: Tables) -> DataFrame:
    rows = M.train_part(data(t))
    mixes = [0.0, 0.5]
    # The penalty of ``M.logistic`` over all training rows.
    scores = list(zip(mixes, logistic_folds.accuracies(rows, len(FULL), 1.0 / max(rows.count(), 1), mixes)))
    return t.spark.createDataFrame(scores, "mix double, accuracy double")


@check("evaluate")
def evaluate(t: Tables) -> DataFrame:
    rows = data(t, HISTORY)
    n = M.train_part(rows).count()
    return M.evaluate("logistic", M.logistic(n), rows, len(HISTORY))[1].unionByName(
        M.evaluate("tree", M.tree(maxDepth=5), rows, len(HISTORY))[1]
    )


def _tree_predictions(t: Tables) -> DataFrame:
    rows = data(t, HISTORY)
    model = M.tree(maxDepth=5).fit(M.train_part(rows))
    return M.predict(model, rows)


@check("evaluate_predictions")
def evaluate_predictions(t: Tables) -> DataFrame:
    """Every student's score and prediction."""
    return _tree_predictions(t)


@check("evaluate_classes")
def evaluate_classes(t: Tables) -> DataFrame:
    """The report by class of the dev part."""
    return E.class_report(_tree_predictions(t).filter("is_dev"))


@check("lasso_select")
def lasso_select(t: Tables) -> DataFrame:
    return M.lasso_select(data(t), FULL)


@check("accuracy_by_semester")
def accuracy_by_semester(t: Tables) -> DataFrame:
    """All demographic columns at the start, the full list later, with balanced training rows."""
    table = M.held(features(t))
    static = [c for c in FULL if c in DEMOGRAPHIC]
    steps = {0: static, 1: FULL, 2: FULL, 3: FULL, 4: FULL}
    return M.accuracy_by_semester(table, list(steps), YEARS, steps, V.ENCODING, balance=True)
