"""Logistic regression by Newton steps: each step is one aggregate over the rows.

A task sums the loss, the gradient and the curvature of its rows into one small matrix; Spark adds these up
cell by cell, and the step is solved on the driver, whatever the number of rows. A handful of steps reaches
the optimum to the last digits, so the result depends neither on a stopping rule nor on the partitioning
beyond rounding.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.plans.evaluation import threshold

ROUNDS = 100
TOLERANCE = 1e-9


class Fit(NamedTuple):
    """Coefficients, and the gradient of the penalised loss there (intercept first)."""

    intercept: float
    coef: np.ndarray
    gradient: np.ndarray
    rounds: int


def _sums(rows: DataFrame, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature at ``beta`` (intercept first), without the penalty."""
    width = len(beta)

    def partial(frames):
        total = np.zeros(1 + width + width * width)
        for frame in frames:
            if not len(frame):
                continue
            x = np.column_stack((np.ones(len(frame)), np.stack(frame["x"].to_numpy())))
            y = frame["y"].to_numpy()
            z = x @ beta
            p = 0.5 * (1.0 + np.tanh(0.5 * z))
            total[0] += (np.logaddexp(0.0, z) - y * z).sum()
            total[1 : 1 + width] += x.T @ (p - y)
            total[1 + width :] += ((x.T * (p * (1.0 - p))) @ x).ravel()
        yield pd.DataFrame({"at": np.arange(len(total)), "v": total})

    cells = rows.mapInPandas(partial, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    flat = np.zeros(1 + width + width * width)
    for row in cells.collect():
        flat[row["at"]] = row["v"]
    return flat[0], flat[1 : 1 + width], flat[1 + width :].reshape(width, width)


def fit(data: DataFrame, features: int, inverse_penalty: float = 1.0, rounds: int = ROUNDS) -> Fit:
    """Minimise the summed log loss plus |coef|^2 / (2 ``inverse_penalty``); the intercept is free.

    ``data`` holds ``features`` (a vector) and ``label`` (0 or 1; rows without a label take no part) and is read
    once per step, so the caller keeps it. With rows of one label only, or none, the coefficients are 0 and the
    intercept is infinite towards that label, or 0. A step that raises the loss is halved. A fit that does not settle
    within ``rounds`` is an error.
    """
    rows = data.filter(F.col("label").isNotNull()).select(
        vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")
    )
    labels = rows.agg(F.min("y").alias("low"), F.max("y").alias("high"), F.count("y").alias("n")).first()
    width = features + 1
    if not labels["n"] or labels["low"] == labels["high"]:
        intercept = np.inf * (2 * labels["low"] - 1) if labels["n"] else 0.0
        return Fit(float(intercept), np.zeros(features), np.zeros(width), 0)
    penalty = np.full(width, 1.0 / inverse_penalty)
    penalty[0] = 0.0

    def at(beta: np.ndarray):
        loss, gradient, curvature = _sums(rows, beta)
        return (
            loss + 0.5 * (penalty * beta * beta).sum(),
            gradient + penalty * beta,
            curvature + np.diag(penalty),
        )

    beta = np.zeros(width)
    loss, gradient, curvature = at(beta)
    limit = TOLERANCE * max(np.abs(gradient).max(), 1.0)
    for done in range(rounds):
        if np.abs(gradient).max() <= limit:
            return Fit(float(beta[0]), beta[1:], gradient, done)
        step = np.linalg.lstsq(curvature, -gradient, rcond=None)[0]
        tried = at(beta + step)
        # Near the optimum the loss no longer tells steps apart.
        while tried[0] > loss + 1e-12 * abs(loss) and np.abs(step).max() > 1e-15:
            step = step / 2
            tried = at(beta + step)
        beta = beta + step
        loss, gradient, curvature = tried
    raise RuntimeError(f"no optimum within {rounds} steps")


def predict(model: Fit, data: DataFrame, cut: float = 0.5) -> DataFrame:
    """(cohort, emplid, is_dev, label, score, prediction), without leaving the JVM."""
    weights = F.array(*[F.lit(float(v)) for v in model.coef])
    terms = F.zip_with(vector_to_array("features"), weights, lambda x, w: x * w)
    z = F.lit(model.intercept) + F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    rows = data.select("cohort", "emplid", "is_dev", "label", (1 / (1 + F.exp(-z))).alias("score"))
    return rows.withColumn("prediction", threshold("score", cut))


def ranking(model: Fit, data: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, coef, gradient), largest coefficient first; as many rows as features."""
    found = sorted(zip(columns, model.coef, model.gradient[1:]), key=lambda r: (-r[1], r[0]))
    rows = [(name, float(c), float(g)) for name, c, g in found]
    return data.sparkSession.createDataFrame(rows, "feature string, coef double, gradient double")
