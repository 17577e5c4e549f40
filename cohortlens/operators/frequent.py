"""Frequent values of columns: mergeable summaries propose them, one recount makes their numbers exact.

A task keeps a bounded number of counters per column. Whenever there are more, the largest count beyond the
bound is taken off all of them, so a counter is at most rows / (counters + 1) too low. The counters of all tasks
add up with the same share of error; what may reach the wanted share is counted exactly. Values are never
shuffled as rows, however many distinct ones there are.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import cut_lineage

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _trimmed(counts: pd.Series, counters: int) -> pd.Series:
    if len(counts) <= counters:
        return counts
    left = counts - counts.nlargest(counters + 1).iloc[-1]
    return left[left > 0]


def summaries(frames, names: list[str], text: list[bool], counters: int):
    """Counters of one task: (at, text, number, n), and per column a row without value for its total."""
    kept = [pd.Series(dtype="int64") for _ in names]
    totals = [0] * len(names)
    for frame in frames:
        for at, name in enumerate(names):
            found = frame[name].value_counts()
            totals[at] += int(found.sum())
            both = pd.concat([kept[at], found])
            kept[at] = _trimmed(both.groupby(level=0).sum(), counters)
    parts = []
    for at, counts in enumerate(kept):
        values = [*counts.index, None]
        parts += [
            (at, v if text[at] else None, None if text[at] or v is None else float(v), int(n))
            for v, n in zip(values, [*counts, totals[at]])
        ]
    yield pd.DataFrame(
        {
            "at": pd.Series([p[0] for p in parts], dtype="int32"),
            "text": pd.Series([p[1] for p in parts], dtype=object),
            "number": pd.Series([p[2] for p in parts], dtype="float64").astype(object).where(
                pd.Series([p[2] is not None for p in parts], dtype=bool), None
            ),
            "n": pd.Series([p[3] for p in parts], dtype="int64"),
        }
    )


def frequent_values(df: DataFrame, columns: list[str], share: float = 0.01) -> DataFrame:
    """Every value that at least ``share`` of a column's known values have, with its exact count.

    Returns (column_name, rank, value_text, value_number, n, known): numbers in ``value_number``, all else as text;
    rank 1 is the most frequent, ties go to the smaller value. Nulls and NaN are unknown. A column has at most
    1 / ``share`` such values, and at most three times as many are counted again. An unknown column gives no rows.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    kinds = dict(df.dtypes)
    text = [not kinds[c].startswith(NUMERIC) for c in columns]
    names = [f"c{i}" for i in range(len(columns))]
    plain = df.select(
        *[
            F.col(c).cast("string").alias(n)
            if t
            else F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(n)
            for c, n, t in zip(columns, names, text)
        ]
    )
    counters = math.ceil(2 / share)
    shape = "at int, text string, number double, n bigint"
    merged = cut_lineage(
        plain.mapInPandas(lambda frames: summaries(frames, names, text, counters), shape)
        .groupBy("at", "text", (F.col("number") + 0.0).alias("number"))
        .agg(F.sum("n").alias("n"))
    )
    valued = F.col("text").isNotNull() | F.col("number").isNotNull()
    totals = merged.filter(~valued).select("at", F.col("n").alias("known"))
    missed = F.col("known") / (counters + 1)
    # At most 3 / share values per column, since all counters of one add up to no more than its known values.
    proposed = (
        merged.filter(valued)
        .join(F.broadcast(totals), "at")
        .filter(F.col("n") + missed + 1 >= F.col("known") * share)
        .select("at", "text", "number", "known")
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("at"),
                (F.col(n) if t else F.lit(None).cast("string")).alias("text"),
                (F.lit(None).cast("double") if t else F.col(n) + 0.0).alias("number"),
            )
            for i, (n, t) in enumerate(zip(names, text))
        ]
    )
    seen = plain.select(F.explode(cells).alias("x")).select("x.*").alias("a")
    same = (
        (F.col("a.at") == F.col("b.at"))
        & F.col("a.text").eqNullSafe(F.col("b.text"))
        & F.col("a.number").eqNullSafe(F.col("b.number"))
    )
    counted = (
        seen.join(F.broadcast(proposed.alias("b")), same)
        .groupBy("a.at", "a.text", "a.number")
        .agg(F.count(F.lit(1)).alias("n"), F.first("known").alias("known"))
        .filter(F.col("n") >= F.col("known") * share)
    )
    order = Window.partitionBy("at").orderBy(F.desc("n"), "number", "text")
    return counted.withColumn("rank", F.row_number().over(order)).select(
        F.get(F.array(*[F.lit(c) for c in columns]), "at").alias("column_name"),
        "rank",
        F.col("text").alias("value_text"),
        F.col("number").alias("value_number"),
        "n",
        "known",
    )
