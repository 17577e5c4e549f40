"""Graduation models on the sequential chunks, fitted by Spark ML."""

from __future__ import annotations

import time
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.expressions import fold_of, ratio
from cohortlens.functions.labels import DEMOGRAPHIC_ENCODING
from cohortlens.operators.encode import encoded_names
from cohortlens.plans import perceptron_fit
from cohortlens.plans.course import GRADE_FLAGS
from cohortlens.plans.evaluation import (
    confusion_cells,
    roc_auc,
    roc_on_labels,
    threshold,
    with_gain,
)
from cohortlens.plans.penalty_path import select
from cohortlens.plans.sampling import smote
from cohortlens.plans.shared_forest import Forest, ForestSearch
from cohortlens.plans.students import chunk
from cohortlens.session import checkpoint_root, hold

# Semesters whose rows are held and fitted side by side: a fit is many short jobs that leave most cores idle.
STEPS_AT_ONCE = 5

_SHORT = [
    "major_change_cnt",
    "summer",
    "term_gpa",
    "bcmp_term_gpa",
    "completion_rate",
    "load_index_exclude",
    "load_index_only",
    "dfw_rate",
    "gpa_hs",
]


def feature_sets(encoding=DEMOGRAPHIC_ENCODING) -> dict[str, list[str]]:
    """Named feature lists: everything known, grades history, cumulative, and short."""
    names = encoded_names(encoding)
    cumulative = ["cum_summer", "cum_winter", "cum_gpa", "bcmp_cum_gpa"]
    loads = ["load_index_exclude", "load_index_only", "dfw_rate", "gpa_hs"]
    return {
        "full": [*_SHORT, *names, "t_comp", "t_read", "t_math"],
        "history": [
            "major_change_cnt", *GRADE_FLAGS, "summer", "winter", *cumulative, "completion_rate", *loads,
        ],
        "cumulative": ["major_change_cnt", "summer", "winter", *cumulative, *loads],
        "short": [*_SHORT, "gendr_m"],
    }


def response(years: float) -> str:
    return f"grad_in_{str(float(years)).replace('.', '_')}"


def seq_data(
    features: DataFrame,
    t: int,
    years: float,
    columns: list[str],
    balance: bool = False,
    encoding=DEMOGRAPHIC_ENCODING,
    folds: int = 10,
) -> DataFrame:
    """Rows known by semester ``t`` as (cohort, emplid, is_dev, label, fold, features).

    Incomplete rows leave the training part only. An incomplete dev row stays and makes the assembling
    fail, because accuracy over the complete ones alone would be another figure; ``incomplete_dev`` lists
    such rows. With ``balance`` the training part also holds synthetic minority rows, without a student.
    """
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    rows = chunk(features, t, encoding).filter(F.col("is_dev") | whole)
    label = F.col(response(years)).cast("int").alias("label")
    real = rows.select("cohort", "emplid", "is_dev", label, *columns)
    if balance:
        keys = [c for c in ("emplid", "cohort", "term_code", "plan_cd", "gendr_m") if c in rows.columns]
        grown = smote(rows.filter(~F.col("is_dev")), keys, columns, response(years))
        made = grown.filter("synthetic").select(
            F.lit(None).cast("int").alias("cohort"),
            F.lit(None).cast("string").alias("emplid"),
            F.lit(False).alias("is_dev"),
            "label",
            *columns,
            fold_of(["row_id"], folds).alias("fold"),
        )
        real = real.withColumn("fold", fold_of(["emplid"], folds)).unionByName(made)
    else:
        real = real.withColumn("fold", fold_of(["emplid"], folds))
    return VectorAssembler(inputCols=columns, outputCol="features").transform(real).select(
        "cohort", "emplid", "is_dev", "label", "fold", "features"
    )


def incomplete_dev(
    features: DataFrame, t: int, columns: list[str], encoding=DEMOGRAPHIC_ENCODING
) -> DataFrame:
    """Dev rows known by semester ``t`` that lack a feature: (emplid, cohort, missing), by name."""
    missing = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]), lambda c: c.isNotNull()
    )
    rows = chunk(features, t, encoding).filter("is_dev")
    return rows.select("emplid", "cohort", missing.alias("missing")).filter(F.size("missing") > 0)


def logistic(rows: int, inverse_penalty: float = 1.0, **options) -> LogisticRegression:
    """L2 logistic regression; the summed-loss penalty 1/C becomes 1/(C n) for the mean loss."""
    return LogisticRegression(
        regParam=1.0 / (inverse_penalty * max(rows, 1)), standardization=False, maxIter=100, **options
    )


def tree(**options) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(seed=42, **options)


def forest(trees: int = 100, **options) -> RandomForestClassifier:
    options = {"featureSubsetStrategy": "sqrt", **options}
    return RandomForestClassifier(numTrees=trees, seed=42, **options)


def boosted(trees: int = 100, depth: int = 3, step: float = 0.1) -> GBTClassifier:
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, seed=42)


class Perceptron:
    """The library's network fitted by its own method, with the sums of a round taken in numpy."""

    def __init__(self, layers: list[int], rounds: int, seed: int = 42):
        self.layers, self.rounds = layers, rounds
        self._estimator = MultilayerPerceptronClassifier(layers=layers, maxIter=rounds, seed=seed)

    def fit(self, data: DataFrame) -> Model:
        drawn = self._estimator.copy({self._estimator.maxIter: 0})
        # Two rows without a fit: the library draws the starting weights, and takes the final ones.
        rows = [(float(y), Vectors.dense([float(y)] * self.layers[0])) for y in (0, 1)]
        two = data.sparkSession.createDataFrame(rows, ["label", "features"]).coalesce(1)
        start = np.asarray(drawn.fit(two).weights)
        found = perceptron_fit.fit(data, self.layers, start, self.rounds)
        model = drawn.setInitialWeights(Vectors.dense(found)).fit(two)
        model.clear(model.getParam("initialWeights"))
        return model._set(maxIter=self.rounds)


def perceptron(inputs: int, hidden: tuple[int, ...] = (256, 128), rounds: int = 100) -> Perceptron:
    return Perceptron([inputs, *hidden, 2], rounds)


def cross_validated(
    estimator: Estimator, grid: dict[str, list], folds: int = 10, metric: str = "accuracy", parallel: int = 8
) -> CrossValidator:
    """Grid search over folds given by the student hash, so no student is on both sides."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    judge = (
        RegressionEvaluator(labelCol="label", metricName=metric)
        if isinstance(estimator, LinearRegression)
        else MulticlassClassificationEvaluator(labelCol="label", metricName=metric)
    )
    return CrossValidator(
        estimator=estimator,
        estimatorParamMaps=builder.build(),
        evaluator=judge,
        numFolds=folds,
        foldCol="fold",
        parallelism=parallel,
    )


def held(data: DataFrame) -> DataFrame:
    """Keep assembled rows for the many passes of a fit."""
    return hold(data)


def train_part(data: DataFrame) -> DataFrame:
    return data.filter(~F.col("is_dev"))


def predict(model: Model, data: DataFrame, cut: float = 0.5) -> DataFrame:
    """(cohort, emplid, is_dev, label, score, prediction); the score is a probability or a value."""
    scored = model.transform(data)
    if "probability" in scored.columns:
        score = vector_to_array("probability")[1]
    else:
        score = F.col("prediction")
    rows = scored.select("cohort", "emplid", "is_dev", "label", score.alias("score"))
    return rows.withColumn("prediction", threshold("score", cut))


def chosen_parameters(model: Model) -> str:
    """The parameters a grid search settled on, or those set by the caller, as ``name=value`` by name."""
    if isinstance(model, Forest):
        return model.parameters
    fitted = model
    names = set()
    if isinstance(model, CrossValidatorModel):
        names = {p.name for choice in model.getEstimatorParamMaps() for p in choice}
        fitted = model.bestModel
    else:
        names = {p.name for p in fitted.params if fitted.isSet(p)}
    values = {p.name: fitted.getOrDefault(p) for p in fitted.params if p.name in names and fitted.isDefined(p)}
    return ", ".join(f"{k}={v}" for k, v in sorted(values.items()))


def judge(predictions: DataFrame) -> DataFrame:
    """One row: counts of the confusion matrix and metrics of the dev and the train part."""
    cells = confusion_cells(predictions, ["is_dev"])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    judged = (
        cells.select(
            "is_dev",
            "tp",
            "fp",
            "fn",
            "tn",
            (tp + fp + fn + tn).alias("n"),
            ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
            ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
            ratio(tp, tp + fp).alias("precision"),
            ratio(tp, tp + fn).alias("recall"),
        )
        .join(F.broadcast(roc_auc(predictions, by=["is_dev"])), "is_dev", "left")
        .join(F.broadcast(roc_on_labels(predictions, by=["is_dev"])), "is_dev", "left")
    )
    metrics = "n tp fp fn tn accuracy f1 precision recall roc_auc roc_on_labels".split()
    return judged.agg(
        *[
            F.max(F.when(F.col("is_dev") == dev, F.col(m))).alias(f"{side}_{m}")
            for side, dev in (("dev", True), ("train", False))
            for m in metrics
        ]
    )


def evaluate(
    name: str, estimator: Estimator, data: DataFrame, n_features: int, cut: float = 0.5
) -> tuple[Model, DataFrame]:
    """Fit on the training part; chosen parameters, confusion counts and metrics of both parts as one row.

    ``predict(model, data)`` gives the predictions by student and ``class_report`` their report by class.
    """
    started = time.time()
    model = estimator.fit(train_part(data))
    seconds = time.time() - started
    predictions = held(predict(model, data, cut))
    figures = judge(predictions).select(
        F.lit(name).alias("model"), F.lit(n_features).alias("n_features"),
        F.lit(chosen_parameters(model)).alias("parameters"), "*", F.lit(seconds).alias("fit_seconds"),
    )
    row = data.sparkSession.createDataFrame([figures.first()], figures.schema)
    predictions.unpersist()
    return model, row


def accuracy_by_semester(
    features: DataFrame, steps: list[int], years: float, columns: dict[int, list[str]] | list[str],
    encoding=DEMOGRAPHIC_ENCODING, balance: bool = False,
) -> DataFrame:
    """Dev and train accuracy of the logistic model per semester, with the gain of each step.

    The semesters share nothing but ``features``, so a few of them are prepared and fitted at a time.
    """
    spark = features.sparkSession
    checkpoint_root(spark)

    def step(t: int) -> DataFrame:
        chosen = columns[t] if isinstance(columns, dict) else columns
        data = held(seq_data(features, t, years, chosen, balance, encoding))
        _, row = evaluate(f"t{t}", logistic(train_part(data).count()), data, len(chosen))
        data.unpersist()
        return row.select(F.lit(t).alias("t"), "dev_accuracy", "train_accuracy")

    with ThreadPool(max(min(STEPS_AT_ONCE, len(steps)), 1)) as pool:
        rows = pool.map(inheritable_thread_target(spark)(step), steps, chunksize=1)
    return with_gain(reduce(DataFrame.unionByName, rows))


def coefficients(model: Model, columns: list[str]) -> DataFrame:
    """(feature, coef) of a linear model; as many rows as features."""
    spark = SparkSession.active()
    values = [(c, float(v)) for c, v in zip(columns, model.coefficients.toArray())]
    return spark.createDataFrame(values, "feature string, coef double")


def lasso_select(data: DataFrame, columns: list[str], steps: int = 100) -> DataFrame:
    """Cross-validated lasso: (feature, coef, selected, penalty), selected = non-zero coefficient.

    The whole path of ``steps`` penalties is tried on every fold.
    """
    best = select(train_part(data), len(columns), [1.0], steps)
    rows = [(c, float(v), abs(float(v)) > 1e-5, best["penalty"]) for c, v in zip(columns, best["coef"])]
    return data.sparkSession.createDataFrame(
        rows, "feature string, coef double, selected boolean, penalty double"
    )


def elastic_net(
    data: DataFrame, features: int, mixes: list[float], steps: int = 100, cut: float = 0.6
) -> tuple[dict, DataFrame]:
    """The cross-validated choice of mix and penalty, and the predictions of its fit to all train rows."""
    best = select(train_part(data), features, mixes, steps, scale=True)
    weights = F.array(*[F.lit(float(v)) for v in best["coef"]])
    terms = F.zip_with(vector_to_array("features"), weights, lambda x, w: x * w)
    score = F.lit(float(best["intercept"])) + F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    rows = data.select("cohort", "emplid", "is_dev", "label", score.alias("score"))
    return best, rows.withColumn("prediction", threshold("score", cut))
