"""One-hot encoding with declared categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.expressions import slug


def dummy_name(prefix: str, label: str) -> str:
    return slug(f"{prefix}_{label}" if prefix else label)


def quoted(value) -> str:
    """A SQL literal."""
    if not isinstance(value, str):
        return repr(value)
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def dummies(
    column: str, categories: list[str], prefix: str = "", drop_first: bool = False
) -> list[Column]:
    """0/1 columns per category; a null value is 0 everywhere."""
    kept = categories[1:] if drop_first else categories
    return [
        F.expr(f"CASE WHEN `{column}` = {quoted(c)} THEN 1 ELSE 0 END AS {dummy_name(prefix, str(c))}")
        for c in kept
    ]


def one_hot(df: DataFrame, encoding: list[tuple[str, str, list[str]]]) -> DataFrame:
    """Replace each encoded column by its dummy block."""
    sources = [c for c, _, _ in encoding]
    block = [d for c, prefix, labels in encoding for d in dummies(c, labels, prefix)]
    return df.select(*[c for c in df.columns if c not in sources], *block)


def encoded_names(encoding: list[tuple[str, str, list[str]]]) -> list[str]:
    return [dummy_name(prefix, label) for _, prefix, labels in encoding for label in labels]


def export_names(encoding: list[tuple[str, str, list[str]]]) -> dict[str, str]:
    """Internal slug -> original label, for renaming at a sink."""
    return {
        dummy_name(prefix, label): f"{prefix}_{label}" if prefix else label
        for _, prefix, labels in encoding
        for label in labels
    }


def categories(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column that are not null, as a frame: their number may be anything."""
    return df.select(column).na.drop().distinct()
