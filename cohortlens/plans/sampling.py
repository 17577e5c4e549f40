"""Balancing a training set: SMOTE, ADASYN and random over-sampling.

Draws come from hashes of row keys, so a retried task produces the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.expressions import hash_uniform
from cohortlens.operators.balls import nearest_vectors
from cohortlens.operators.ordered import ordinal
from cohortlens.session import cut_lineage

# Fixed value: neighbours considered per minority row.
NEIGHBOURS = 5


def _row_id(keys: list[str]) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))


def _draw_order(seed: int) -> Column:
    """Sixty bits of a keyed digest of the row, as a number."""
    digest = F.md5(F.concat("row_id", F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _class_sizes(rows: DataFrame, label: str) -> tuple[int, int, int]:
    """(minority label, minority size, majority size)."""
    size = rows.agg(
        F.count_if(F.col(label) == 1).alias("one"), F.count_if(F.col(label) == 0).alias("zero")
    ).first()
    return (1, size["one"], size["zero"]) if size["one"] <= size["zero"] else (0, size["zero"], size["one"])


def _identified(rows: DataFrame, keys: list[str], features: list[str], label: str) -> DataFrame:
    return cut_lineage(
        rows.select(
            _row_id(keys).alias("row_id"),
            F.col(label).cast("int").alias("label"),
            F.array(*[F.col(c).cast("double") for c in features]).alias("vector"),
        )
    )


def _even_copies(minority: DataFrame, size: int, wanted: int) -> DataFrame:
    """Spread ``wanted`` copies over the rows; the remainder goes to the first rows in hash order."""
    numbered = ordinal(
        minority.withColumns({"_order": _draw_order(0), "_tie": _draw_order(1)}),
        "_order",
        "_tie",
    )
    extra = F.when(F.col("ordinal") < wanted % size, 1).otherwise(0)
    return numbered.withColumn("copies", F.lit(wanted // size) + extra).drop(
        "_order", "_tie", "ordinal"
    )


def _interpolate(counted: DataFrame, minority: DataFrame, size: int, k: int) -> DataFrame:
    """Synthetic rows: a minority row moved part of the way to one of its minority neighbours."""
    near = min(k, size - 1)
    links = nearest_vectors(minority, "row_id", "vector", near).select(
        F.col("key").alias("row_id"), "neighbour", F.col("rank").alias("pick")
    )
    draws = (
        counted.filter("copies > 0")
        .withColumn("draw", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies").cast("bigint"))))
        .withColumn(
            "pick", (1 + F.floor((1 - hash_uniform(["row_id", "draw"], 1)) * near)).cast("int")
        )
        .withColumn("share", 1 - hash_uniform(["row_id", "draw"], 2))
    )
    other = minority.select(F.col("row_id").alias("neighbour"), F.col("vector").alias("towards"))
    return (
        draws.join(links, ["row_id", "pick"])
        .join(other, "neighbour")
        .select(
            "row_id",
            "label",
            F.zip_with(
                "vector", "towards", lambda a, b: a + (b - a) * F.col("share")
            ).alias("vector"),
            F.lit(True).alias("synthetic"),
        )
    )


def _spread(rows: DataFrame, features: list[str]) -> DataFrame:
    return rows.select(
        "row_id", "label", "synthetic", *[F.col("vector")[i].alias(c) for i, c in enumerate(features)]
    )


def smote(
    rows: DataFrame, keys: list[str], features: list[str], label: str, k: int = NEIGHBOURS
) -> DataFrame:
    """The rows plus interpolated minority rows, so that both classes have the same size.

    ``keys`` must identify a row. Returns (row_id, label, synthetic, features...); a synthetic row
    carries the id of the row it started from.
    """
    everything = _identified(rows, keys, features, label)
    minor, small, large = _class_sizes(everything, "label")
    kept = everything.withColumn("synthetic", F.lit(False))
    if small < 2 or small == large:
        return _spread(kept, features)
    minority = cut_lineage(everything.filter(F.col("label") == minor))
    counted = _even_copies(minority, small, large - small)
    return _spread(kept.unionByName(_interpolate(counted, minority, small, k)), features)


def adasyn(
    rows: DataFrame, keys: list[str], features: list[str], label: str, k: int = NEIGHBOURS
) -> DataFrame:
    """Like ``smote``, but with more copies where more of a row's neighbours are majority rows."""
    everything = _identified(rows, keys, features, label)
    minor, small, large = _class_sizes(everything, "label")
    kept = everything.withColumn("synthetic", F.lit(False))
    if small < 2 or small == large:
        return _spread(kept, features)
    minority = cut_lineage(everything.filter(F.col("label") == minor))
    marked = everything.withColumn("_wanted", F.col("label") == minor)
    near = nearest_vectors(marked, "row_id", "vector", k, wanted="_wanted")
    others = everything.filter(F.col("label") != minor).select(F.col("row_id").alias("neighbour"))
    hardness = (
        near.join(others, "neighbour", "left_semi")
        .groupBy(F.col("key").alias("row_id"))
        .agg((F.count(F.lit(1)) / F.lit(float(k))).alias("hardness"))
    )
    weighted = cut_lineage(minority.join(hardness, "row_id"))
    total = weighted.agg(F.sum("hardness")).first()[0]
    if not total:
        return _spread(kept, features)
    counted = weighted.withColumn(
        "copies", F.round(F.col("hardness") / F.lit(total) * (large - small)).cast("bigint")
    ).drop("hardness")
    return _spread(kept.unionByName(_interpolate(counted, minority, small, k)), features)


def random_oversample(rows: DataFrame, keys: list[str], features: list[str], label: str) -> DataFrame:
    """The rows plus repeated minority rows, so that both classes have the same size."""
    everything = _identified(rows, keys, features, label)
    minor, small, large = _class_sizes(everything, "label")
    kept = everything.withColumn("synthetic", F.lit(False))
    if small == 0 or small == large:
        return _spread(kept, features)
    counted = _even_copies(everything.filter(F.col("label") == minor), small, large - small)
    repeated = counted.filter("copies > 0").select(
        "row_id",
        "label",
        "vector",
        F.lit(True).alias("synthetic"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies").cast("bigint"))).alias("_n"),
    ).drop("_n")
    return _spread(kept.unionByName(repeated), features)
