"""Penalised linear fits from moments: whole penalty paths for every fold and mix after one pass over the rows.

The rows are read once and become one small matrix of sums per fold. The sums of a training part are the
total less its fold, and the error on the fold left out follows from that fold's sums too, so a path costs
the same however many rows there are. Paths of different folds and mixes run as separate tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-4
ROUNDS = 1000


def moments(data: DataFrame, features: int) -> DataFrame:
    """(fold, sums): per fold the sums of products of (1, features..., label), row by row in one array."""
    rows = data.select(
        "fold", F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x")
    )
    width = features + 2

    def partial(frames):
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            if not len(frame):
                continue
            x = np.column_stack(
                (np.ones(len(frame)), np.stack(frame["x"].to_numpy()), frame["label"].to_numpy())
            )
            for fold in np.unique(frame["fold"]):
                own = x[(frame["fold"] == fold).to_numpy()]
                sums[fold] = sums.get(fold, 0) + own.T @ own
        if sums:
            yield pd.DataFrame(
                {"fold": [int(f) for f in sums], "sums": [s.ravel() for s in sums.values()]}
            )

    parts = rows.mapInPandas(partial, "fold int, sums array<double>")
    # One array per fold and task is added up, cell by cell.
    cells = parts.select("fold", F.posexplode("sums").alias("at", "v")).groupBy("fold", "at")
    added = cells.agg(F.sum("v").alias("v"))
    ordered = F.sort_array(F.collect_list(F.struct("at", "v")))
    summed = added.groupBy("fold").agg(ordered.alias("c"))
    return summed.select("fold", F.transform("c", lambda c: c["v"]).alias("sums")).filter(
        F.size("sums") == width * width
    )


def centred(sums: np.ndarray, scale: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray]:
    """Covariances among features and with the label, feature means, label mean, and scales."""
    n = sums[0, 0]
    mean, label = sums[0, 1:-1] / n, sums[0, -1] / n
    gram = sums[1:-1, 1:-1] / n - np.outer(mean, mean)
    cross = sums[1:-1, -1] / n - mean * label
    spread = np.sqrt(np.clip(np.diag(gram), 0, None))
    spread[spread < 1e-12] = 1.0
    if not scale:
        spread = np.ones_like(spread)
    return gram / np.outer(spread, spread), cross / spread, mean, label, spread


def descend(gram: np.ndarray, cross: np.ndarray, penalty: float, mix: float, start: np.ndarray) -> np.ndarray:
    """Coordinate descent for one penalty, from the solution of the one before.

    Rounds go over the coefficients that are not zero; a round over all follows whenever these settle.
    """
    beta = start.copy()
    left = cross - gram @ beta
    weight, l1 = np.diag(gram), penalty * mix
    size = weight + penalty * (1 - mix)
    limit = TOLERANCE * max(float(np.abs(cross).max(initial=0.0)), 1e-12)
    usable = np.flatnonzero(size > 1e-12).tolist()
    among, every = usable, True
    for _ in range(ROUNDS):
        most = 0.0
        for j in among:
            z = left[j] + weight[j] * beta[j]
            new = (z - l1 if z > l1 else z + l1 if z < -l1 else 0.0) / size[j]
            step = new - beta[j]
            if step:
                left -= gram[j] * step
                beta[j] = new
                most = max(most, abs(step) * size[j])
        if most >= limit:
            among, every = [j for j in usable if beta[j]], False
        elif every:
            break
        else:
            among, every = usable, True
    return beta


def path(sums: np.ndarray, mix: float, penalties: np.ndarray, scale: bool):
    """(intercept, coefficients) for each penalty, from large to small."""
    gram, cross, mean, label, spread = centred(sums, scale)
    beta = np.zeros(len(cross))
    for penalty in penalties:
        beta = descend(gram, cross, penalty, mix, beta)
        found = beta / spread
        yield label - float(mean @ found), found


def penalties(sums: np.ndarray, mix: float, steps: int, span: float, scale: bool) -> np.ndarray:
    """Log-spaced, from the one that makes every coefficient zero."""
    _, cross, *_ = centred(sums, scale)
    top = float(np.abs(cross).max(initial=0.0)) / max(mix, 1e-3) or 1.0
    return top * np.logspace(0, np.log10(span), steps)


def cross_validate(
    data: DataFrame,
    features: int,
    mixes: list[float],
    steps: int = 100,
    span: float = 1e-3,
    scale: bool = False,
) -> tuple[DataFrame, np.ndarray]:
    """(mix, step, penalty, mse) over all folds, and the total sums."""
    width = features + 2
    folds = moments(data, features).collect()  # one matrix of 50 x 50 or so per fold
    sums = {r.fold: np.array(r.sums).reshape(width, width) for r in folds}
    total = sum(sums.values())
    spark = data.sparkSession

    def run(frames):
        for frame in frames:
            for fold, mix in zip(frame["fold"], frame["mix"]):
                own = sums[fold]
                chosen = penalties(total, mix, steps, span, scale)
                errors = []
                for intercept, beta in path(total - own, mix, chosen, scale):
                    b = np.concatenate(([intercept], beta, [-1.0]))
                    errors.append(float(b @ own @ b))
                yield pd.DataFrame(
                    {"mix": mix, "step": range(steps), "penalty": chosen, "sse": errors, "n": own[0, 0]}
                )

    tasks = spark.createDataFrame(
        [(f, float(m)) for f in sums if total[0, 0] > sums[f][0, 0] for m in mixes], "fold int, mix double"
    )
    tried = tasks.repartition(max(len(sums), 1), "fold", "mix").mapInPandas(
        run, "mix double, step int, penalty double, sse double, n double"
    )
    return tried.groupBy("mix", "step", "penalty").agg(
        (F.sum("sse") / F.sum("n")).alias("mse")
    ), total


def select(
    data: DataFrame, features: int, mixes: list[float], steps: int = 100, span: float = 1e-3, scale: bool = False
) -> dict:
    """The choice of the smallest error and its fit to all rows."""
    tried, total = cross_validate(data, features, mixes, steps, span, scale)
    best = tried.orderBy("mse", F.desc("penalty"), "mix").first()
    chosen = penalties(total, best.mix, steps, span, scale)[: best.step + 1]
    *_, (intercept, beta) = path(total, best.mix, chosen, scale)
    return {
        "mix": best.mix, "penalty": best.penalty, "mse": best.mse, "intercept": intercept, "coef": beta, "sums": total,
    }


def optimal(
    sums: np.ndarray, coef: np.ndarray, penalty: float, mix: float, scale: bool, slack: float = 1e-3
) -> bool:
    """Do coefficients meet the subgradient conditions, up to a share of the largest covariance?"""
    gram, cross, _, _, spread = centred(sums, scale)
    beta = coef * spread
    slope = cross - gram @ beta - penalty * (1 - mix) * beta
    limit = slack * max(float(np.abs(cross).max(initial=0.0)), 1e-12)
    active = beta != 0
    inside = np.abs(slope[~active]) <= penalty * mix + limit
    return bool(inside.all() and (np.abs(slope[active] - penalty * mix * np.sign(beta[active])) <= limit).all())
