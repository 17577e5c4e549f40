"""Assembled rows packed into small matrices, for fits that read them many times and sum in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import hold

# Rows in a matrix: few enough that what a network makes of them stays in a core's cache.
ROWS = 512


def packed(data: DataFrame, kind: str = "float64", fold: str | None = None) -> DataFrame:
    """(fold, x, y): features and labels of up to ``ROWS`` rows as bytes, all of one fold; kept for many passes.

    Without ``fold`` all rows are of fold 0. Rows without a label take no part.
    """
    rows = data.filter(F.col("label").isNotNull()).select(
        (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"),
        vector_to_array("features").alias("x"),
        F.col("label").cast("int").alias("y"),
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x, y = np.stack(frame["x"].to_numpy()).astype(kind), frame["y"].to_numpy(np.int32)
            folds = frame["fold"].to_numpy()
            parts = []
            for f in np.unique(folds):
                at = np.flatnonzero(folds == f)
                parts += [(int(f), at[i : i + ROWS]) for i in range(0, len(at), ROWS)]
            yield pd.DataFrame(
                {"fold": [f for f, _ in parts], "x": [x[at].tobytes() for _, at in parts], "y": [y[at].tobytes() for _, at in parts]}
            )

    return hold(rows.mapInPandas(run, "fold int, x binary, y binary"))


def summed(
    blocks: DataFrame, size: int, part: Callable[[int, np.ndarray, np.ndarray], np.ndarray], kind: str = "float64"
) -> np.ndarray:
    """``part(fold, x, y)`` added up over all blocks: one vector of ``size`` doubles a task, added as a tree."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for frame in frames:
            for fold, x, y in zip(frame["fold"], frame["x"], frame["y"]):
                label = np.frombuffer(y, np.int32)
                total += part(fold, np.frombuffer(x, kind).reshape(len(label), -1), label)
        yield pd.DataFrame({"total": [total.tobytes()]})

    vectors = blocks.mapInPandas(run, "total binary").rdd.map(lambda r: np.frombuffer(r["total"]))
    return vectors.treeAggregate(np.zeros(size), np.add, np.add)
