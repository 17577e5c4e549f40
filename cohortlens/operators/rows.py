"""Projection, filter and join helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upper_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def column_slice(df: DataFrame, start: int, stop: int | None = None) -> DataFrame:
    return df.select(*df.columns[start:stop])


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: name, type and the table's row count (one pass that reads no column)."""
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("column_type"),
        )
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select("row_count", F.explode(F.array(*entries)).alias("e")).select(
        "e.position", "e.column_name", "e.column_type", "row_count"
    )


def finite(c: str) -> Column:
    """Null for NaN and infinite values."""
    value = F.col(c)
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~bad, value).alias(c)


def complete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without null, NaN or infinity in ``columns`` (all by default)."""
    floating = {n for n, kind in df.dtypes if kind in ("double", "float")}
    cleaned = df.select(*[finite(c) if c in floating else F.col(c) for c in df.columns])
    return cleaned.na.drop("any", subset=columns)


def min_support(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows whose key occurs at least ``least`` times.

    Counting combines before its shuffle, and the semi join leaves a very frequent key to be split by
    adaptive execution; a window count would put that key into one task.
    """
    kept = df.groupBy(key).count().filter(F.col("count") >= least).select(key)
    return df.join(kept, key, "left_semi")


def lookup(df: DataFrame, column: str, value, order: list[str], limit: int | None = None) -> DataFrame:
    """Rows of one key in a full order, optionally only the first ``limit``."""
    found = df.filter(F.col(column) == value).orderBy(*order)
    return found if limit is None else found.limit(limit)


def inner_with_cohort(
    grades: DataFrame, cohort: DataFrame, key: str, distinct: bool = True
) -> DataFrame:
    """Grades of students that belong to a cohort, the cohort column first.

    ``distinct=False`` keeps repeated cohort rows, which multiply the grades.
    """
    side = cohort.distinct() if distinct else cohort
    others = [c for c in grades.columns if c != key]
    return grades.join(side, key).select(
        *[c for c in side.columns if c != key], key, *others
    )
