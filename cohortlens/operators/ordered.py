"""Global order without a global sort in one task.

Both operators cut the value range into as many buckets as there are shuffle partitions, add up the
buckets (a table of that many rows) and finish each bucket on its own. Cut points are approximate
quantiles, which may come out differently when they are computed again, so they are pinned before use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import cut_lineage, shuffle_partitions

ACCURACY = 10_000


def quantile_points(column: str, shares: list[float]) -> Column:
    """Approximate quantiles of a numeric column as one array."""
    listed = ", ".join(f"{s!r}D" for s in shares)
    return F.expr(f"percentile_approx(`{column}`, array({listed}), {ACCURACY})")


def _cuts(order: str, buckets: int) -> Column:
    return quantile_points(order, [i / buckets for i in range(1, buckets)])


def below(cuts: Column, value: Column, most: int) -> Column:
    """How many of the sorted ``cuts`` are smaller, by binary search; ``most`` bounds their number."""
    steps = [1 << i for i in range(max(most, 1).bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) < value), at + step
        ).otherwise(at),
    )


def running_totals(
    df: DataFrame, order: str, sums: list[str], by: list[str] | None = None
) -> DataFrame:
    """Add ``<c>_before``: the total of ``c`` over all smaller ``order`` values in the same ``by``.

    ``order`` must be numeric and unique within ``by`` (group by it first), and ``by`` must be a small
    set such as column names, folds or splits, because one row of cut points per value is broadcast.
    """
    by = by or []
    buckets = shuffle_partitions(df.sparkSession)
    cuts = _cuts(order, buckets).alias("_cuts")
    if by:
        source = df.join(F.broadcast(cut_lineage(df.groupBy(*by).agg(cuts))), by)
    else:
        source = df.withColumn("_cuts", F.lit(df.agg(cuts).first()["_cuts"] or []))
    marked = source.withColumn("_bucket", below(F.col("_cuts"), F.col(order), buckets)).drop("_cuts")
    totals = marked.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    # One row per range and ``by``.
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums],
    )
    smaller = (
        Window.partitionBy(*by, "_bucket")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return marked.join(F.broadcast(offsets), [*by, "_bucket"]).select(
        *df.columns,
        *[
            (F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(smaller), F.lit(0))).alias(f"{c}_before")
            for c in sums
        ],
    )


def ordinal(df: DataFrame, order: str, tie: str, name: str = "ordinal") -> DataFrame:
    """Number all rows 0, 1, 2 ... by (order, tie), both numeric and non-null, ``tie`` unique.

    A value shared by many rows becomes a cut point and so a bucket of its own, which is cut again by
    ``tie`` into slots, as many as its share of the rows asks for. The input is written first: counting
    and numbering must see identical rows.
    """
    df = cut_lineage(df)
    buckets = shuffle_partitions(df.sparkSession)
    row = df.agg(_cuts(order, buckets).alias("cuts"), F.count(F.lit(1)).alias("n")).first()
    cuts = F.lit(row["cuts"] or [])
    marked = df.withColumn("_rank", below(cuts, F.col(order), buckets)).withColumn(
        "_equal", F.coalesce(F.get(cuts, F.col("_rank")) == F.col(order), F.lit(False))
    )
    marked = marked.withColumn("_bucket", 2 * F.col("_rank") + F.col("_equal").cast("int"))
    # The slots of all heavy values together are at most twice the buckets, and so are their cuts.
    slots = F.ceil(F.col("_n") * buckets / F.lit(max(row["n"], 1))).cast("int")
    inner = (
        marked.filter("_equal")
        .groupBy("_bucket")
        .agg(_cuts(tie, buckets).alias("_every"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_slots", slots)
        .select(
            "_bucket",
            F.when(
                F.col("_slots") > 1,
                F.transform(
                    F.sequence(F.lit(1), F.col("_slots") - 1),
                    lambda i: F.get("_every", F.floor(i * buckets / F.col("_slots")).cast("int") - 1),
                ),
            )
            .otherwise(F.array().cast("array<bigint>"))
            .alias("_inner"),
        )
    )
    placed = marked.join(F.broadcast(cut_lineage(inner)), "_bucket", "left").withColumn(
        "_slot", F.when(F.col("_equal"), below(F.col("_inner"), F.col(tie), buckets)).otherwise(0)
    )
    counts = placed.groupBy("_bucket", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(*before)
    wholes = counts.groupBy("_bucket").agg(F.sum("_n").alias("_n")).select(
        "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_whole")
    )
    inside = Window.partitionBy("_bucket").orderBy("_slot").rowsBetween(*before)
    parts = counts.select(
        "_bucket", "_slot", F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_part")
    )
    offsets = parts.join(F.broadcast(wholes), "_bucket")
    within = Window.partitionBy("_bucket", "_slot").orderBy(order, tie)
    return placed.join(offsets, ["_bucket", "_slot"]).select(
        *df.columns,
        (F.col("_whole") + F.col("_part") + F.row_number().over(within) - 1).alias(name),
    )
