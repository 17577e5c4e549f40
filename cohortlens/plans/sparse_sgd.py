"""Logistic regression with an elastic-net penalty by stochastic descent, shard by shard with averaging.

Equal rows are numbered; shards of bounded size and the order within them come from a hash of the row and its number,
so a third of all rows being copies spreads evenly, and partitions that are run again, or another partitioning, take the
same steps. In a round every shard walks over its
rows from the common weights, and the weights of all shards are averaged by rows; a weight that shards with half of
the rows have at 0 is 0. The L1 penalty is applied
cumulatively: a weight pays what all steps so far could have taken off, and stops at 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import cut_lineage

SHARD_ROWS = 4096
RATE = 0.5


def walk(x, y, beta, rate: float, penalty: float, mix: float) -> np.ndarray:
    """One pass over rows in their order from ``beta`` (intercept first)."""
    beta = beta.copy()
    owed, paid = 0.0, np.zeros(len(beta) - 1)
    for row, label in zip(x, y):
        z = beta[0] + row @ beta[1:]
        # A step never goes beyond what the row's own curvature allows.
        step = min(rate, 4.0 / (1.0 + row @ row))
        slope = step * (0.5 * (1.0 + math.tanh(0.5 * z)) - label)
        beta[0] -= slope
        moved = (beta[1:] - slope * row) / (1.0 + step * penalty * (1.0 - mix))
        owed += step * penalty * mix
        kept = np.where(moved > 0, np.maximum(0.0, moved - (owed + paid)), np.minimum(0.0, moved + (owed - paid)))
        paid += kept - moved
        beta[1:] = kept
    return beta


def sharded(data: DataFrame, seed: int) -> DataFrame:
    """Rows as (x, y, place, shard), shards of about ``SHARD_ROWS`` rows."""
    rows = data.filter(F.col("label").isNotNull()).select(
        vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")
    )
    single = cut_lineage(rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    shards = max(1, -(-(single.agg(F.sum("n")).first()[0] or 0) // SHARD_ROWS))
    # Copies are numbered in two steps, so that no task makes all copies of one row.
    lots = single.withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SHARD_ROWS).cast("int"))))
    dealt = lots.repartition(F.xxhash64("x", "y", "lot"))
    held = F.least(F.lit(SHARD_ROWS), F.col("n") - F.col("lot") * SHARD_ROWS).cast("int")
    numbered = dealt.withColumn("copy", F.explode(F.sequence(F.lit(1), held)))
    named = ["x", "y", "lot", "copy"]
    return numbered.select(
        "x",
        "y",
        F.xxhash64(*named, F.lit(seed)).alias("place"),
        F.pmod(F.xxhash64(*named, F.lit(seed + 1)), F.lit(shards)).cast("int").alias("shard"),
    )


def fit(
    data: DataFrame, features: int, penalty: float, mix: float, rounds: int = 30, seed: int = 42
) -> np.ndarray:
    """(intercept, coefficients...) near the least mean log loss + penalty (mix |w| + (1 - mix) |w|^2 / 2).

    The rate falls with the rounds. Without rows all weights are 0. Features should have similar scales.
    """
    rows = cut_lineage(sharded(data, seed))
    beta = np.zeros(features + 1)
    for done in range(rounds):
        start, rate = beta, RATE / (1.0 + done) / 4.0

        def run(shard: pd.DataFrame) -> pd.DataFrame:
            shard = shard.sort_values("place")
            made, n = walk(np.stack(shard["x"]), shard["y"].to_numpy(), start, rate, penalty, mix), float(len(shard))
            none = np.where(made == 0, n, 0.0)
            return pd.DataFrame({"at": np.arange(len(made)), "v": made * n, "none": none, "n": n})

        parts = rows.groupBy("shard").applyInPandas(run, "at int, v double, none double, n double")
        mean = F.when(2 * F.sum("none") >= F.sum("n"), 0.0).otherwise(F.sum("v") / F.sum("n"))
        found = parts.groupBy("at").agg(mean.alias("v")).collect()
        if not found:
            return beta
        beta = np.zeros(features + 1)
        for r in found:
            beta[r["at"]] = r["v"]
    return beta
