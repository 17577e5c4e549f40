"""Column statistics. Each function is one or two aggregates over the whole input."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.expressions import ratio, rounded
from cohortlens.operators.ordered import running_totals
from cohortlens.session import cut_lineage

QUARTILES = [0.25, 0.5, 0.75]
# Columns whose pairs are one plain aggregate.
FEW = 20


def _melt(wide: DataFrame, columns: list[str], parts: dict[str, str]) -> DataFrame:
    """One row per column from a one-row frame holding ``<column>__<part>`` cells."""
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            *[F.col(f"{c}__{p}").cast(kind).alias(p) for p, kind in parts.items()],
        )
        for c in columns
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or df.columns
    wide = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"{c}__null_count") for c in columns]
    )
    return _melt(wide, columns, {"null_count": "bigint"})


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and sample standard deviation per column, nulls skipped."""
    wide = df.agg(
        *[rounded(F.avg(c)).alias(f"{c}__mean") for c in columns],
        *[rounded(F.stddev_samp(c)).alias(f"{c}__std") for c in columns],
    )
    return _melt(wide, columns, {"mean": "double", "std": "double"})


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def base_rate(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Share of ones of a 0/1 column."""
    return df.groupBy(*(by or [])).agg(
        F.count(column).alias("n"), ratio(F.sum(column), F.count(column)).alias("base_rate")
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n) for the non-null values of numeric columns."""
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"))
                for c in columns
            ]
        )
    )
    return (
        df.select(cells.alias("x"))
        .select("x.*")
        .filter(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """Linearly interpolated quantiles, exact at any size.

    Values are counted first, then located by their running counts, so no task and no aggregation
    buffer has to hold a whole column.
    """
    # Written once: sizes, cut points and running counts then read the counts, not the input.
    counted = cut_lineage(value_counts(df, columns))
    sizes = counted.groupBy("column_name").agg(F.sum("n").alias("total"))
    located = running_totals(counted, "value", ["n"], ["column_name"]).join(
        F.broadcast(sizes), "column_name"
    )
    ends = []
    for i, share in enumerate(shares):
        position = F.lit(share) * (F.col("total") - 1)
        for end, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            inside = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
            ends.append(F.max(F.when(inside, F.col("value"))).alias(f"{end}{i}"))
    picked = located.groupBy("column_name", "total").agg(*ends)
    values = []
    for i, share in enumerate(shares):
        position = F.lit(share) * (F.col("total") - 1)
        low, high = F.col(f"lo{i}"), F.col(f"hi{i}")
        values.append((low + (high - low) * (position - F.floor(position))).alias(f"q{i}"))
    return picked.select("column_name", *values)


def exact_landmarks(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """(column_name, i, value): the quantiles at i / (n - 1), exact at any size, interpolated.

    A distinct value knows from its running count which landmarks lie on it, so the landmarks come from
    the counted values directly, ``n`` rows per column.
    """
    counted = cut_lineage(value_counts(df, columns))
    sizes = counted.groupBy("column_name").agg(F.sum("n").alias("total"))
    located = running_totals(counted, "value", ["n"], ["column_name"]).join(
        F.broadcast(sizes), "column_name"
    )
    first, last = F.col("n_before"), F.col("n_before") + F.col("n")
    step = F.greatest(F.col("total") - 1, F.lit(1)) / F.lit(float(n - 1))
    # One more on either side, so that no rounding loses a landmark.
    near = F.sequence(
        F.greatest(F.floor((first - 1) / step) - 1, F.lit(0)).cast("int"),
        F.least(F.ceil(last / step) + 1, F.lit(n - 1)).cast("int"),
    )
    spot = F.col("i") / F.lit(float(n - 1)) * (F.col("total") - 1)
    ends = located.withColumn("i", F.explode(near)).withColumn("spot", spot)

    def at(rank):
        return F.max(F.when((first <= rank) & (rank < last), F.col("value")))

    found = ends.groupBy("column_name", "i", "spot").agg(
        at(F.floor("spot")).alias("low"), at(F.ceil("spot")).alias("high")
    )
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("spot") - F.floor("spot"))
    return found.filter(F.col("low").isNotNull()).select("column_name", "i", value.alias("value"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, std, min, quartiles and max per numeric column."""
    wide = df.agg(
        *[F.count(c).alias(f"{c}__count") for c in columns],
        *[rounded(F.avg(c)).alias(f"{c}__mean") for c in columns],
        *[rounded(F.stddev_samp(c)).alias(f"{c}__std") for c in columns],
        *[F.min(c).alias(f"{c}__min") for c in columns],
        *[F.max(c).alias(f"{c}__max") for c in columns],
    )
    moments = _melt(
        wide,
        columns,
        {"count": "bigint", "mean": "double", "std": "double", "min": "double", "max": "double"},
    )
    quartiles = exact_quantiles(df, columns, QUARTILES).select(
        "column_name",
        *[rounded(f"q{i}").alias(f"p{int(s * 100)}") for i, s in enumerate(QUARTILES)],
    )
    return moments.join(quartiles, "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def corr_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every column pair (lower triangle), pairwise complete.

    Up to ``FEW`` columns it is one aggregate of built-in correlations, combined map-side, in one run of the
    input; the number of pairs would make the plan of more columns too large.
    """
    if len(columns) > FEW:
        return _corr_of_many(df, columns)
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, corr double")
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])

    def spread(c: str, other: str):
        return F.stddev_pop(F.when(F.col(other).isNotNull(), F.col(c)))

    # Undefined where a column does not vary.
    one = numbers.agg(
        *[
            F.when(
                (spread(a, b) > 0) & (spread(b, a) > 0),
                F.covar_pop(a, b) / F.nullif(spread(a, b) * spread(b, a), F.lit(0.0)),
            ).alias(f"p{k}")
            for k, (a, b) in enumerate(pairs)
        ]
    )
    cells = [
        F.struct(F.lit(b).alias("column_a"), F.lit(a).alias("column_b"), F.col(f"p{k}").alias("corr"))
        for k, (a, b) in enumerate(pairs)
    ]
    found = one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return found.withColumn("corr", rounded("corr"))


def _corr_of_many(df: DataFrame, columns: list[str]) -> DataFrame:
    """``corr_pairs`` from moments that each task sums up as matrices.

    Rows become (pair, a, b) batch by batch only as per-partition moments, so one small row per pair and
    task is shuffled, and the number of pairs is no matter of plan size. Values are shifted by one known row
    of figures, which keeps the sums of squares well away from cancellation.
    """
    shift = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centre = np.array([float(shift[c] or 0.0) for c in columns])
    pairs = list(combinations(range(len(columns)), 2))
    first, second = (np.array([p[i] for p in pairs], int) for i in (0, 1))

    def moments(frames):
        total = np.zeros((6, len(columns), len(columns)))
        for frame in frames:
            x = frame.to_numpy(dtype=float) - centre
            here = ~np.isnan(x)
            x, h = np.where(here, x, 0.0), here.astype(float)
            total += [h.T @ h, x.T @ h, h.T @ x, (x * x).T @ h, h.T @ (x * x), x.T @ x]
        cells = total[:, first, second]
        yield pd.DataFrame({"pair": np.arange(len(pairs)), **{f"m{i}": cells[i] for i in range(6)}})

    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    schema = "pair int, " + ", ".join(f"m{i} double" for i in range(6))
    sums = numbers.mapInPandas(moments, schema).groupBy("pair").agg(
        *[F.sum(f"m{i}").alias(f"m{i}") for i in range(6)]
    )
    n, x, y, xx, yy, xy = (F.col(f"m{i}") for i in range(6))
    spread_x, spread_y = xx - x * x / n, yy - y * y / n
    flat = (n < 2) | (spread_x <= xx * 1e-14) | (spread_y <= yy * 1e-14)
    value = F.when(~flat, (xy - x * y / n) / F.sqrt(spread_x * spread_y))
    names = F.array(*[F.lit(c) for c in columns])
    which = lambda index: F.get(
        names, F.get(F.lit([int(i) for i in index]), F.col("pair"))
    )
    return sums.select(
        which(second).alias("column_a"), which(first).alias("column_b"), rounded(value).alias("corr")
    )


def histogram(df: DataFrame, column: str, width: float, start: float = 0.0) -> DataFrame:
    """Counts per bin of fixed width: bin ``i`` covers [start + i*width, start + (i+1)*width)."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.floor((F.col(column) - start) / width).cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bin", (F.lit(start) + F.col("bin") * F.lit(width)).alias("bin_start"), "n")
    )


def profile_columns(df: DataFrame, columns: list[str], limit: float = 0.9) -> DataFrame:
    """Per column: counts, moments, range, and how many other columns repeat it (|corr| > limit)."""
    wide = df.agg(
        *[F.count(c).alias(f"{c}__count") for c in columns],
        *[F.count_if(F.col(c).isNull()).alias(f"{c}__null_count") for c in columns],
        *[rounded(F.avg(c)).alias(f"{c}__mean") for c in columns],
        *[rounded(F.stddev_samp(c)).alias(f"{c}__std") for c in columns],
        *[F.min(c).alias(f"{c}__min") for c in columns],
        *[F.max(c).alias(f"{c}__max") for c in columns],
    )
    moments = _melt(
        wide,
        columns,
        {
            "count": "bigint",
            "null_count": "bigint",
            "mean": "double",
            "std": "double",
            "min": "double",
            "max": "double",
        },
    )
    strong = corr_pairs(df, columns).filter(F.abs("corr") > limit)
    repeated = (
        strong.select(F.explode(F.array("column_a", "column_b")).alias("column_name"))
        .groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("similar_columns"))
    )
    return moments.join(repeated, "column_name", "left").na.fill(0, ["similar_columns"])
