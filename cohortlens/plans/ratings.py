"""Rating tables: cleaning, thinning, density, support and error tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.expressions import fold_of, is_test, ratio
from cohortlens.operators.rows import min_support

ITEM_SUPPORT = 10
USER_SUPPORT = 20


def implicit(ratings: DataFrame) -> DataFrame:
    return ratings.filter(F.col("rating") == 0)


def explicit(ratings: DataFrame) -> DataFrame:
    return ratings.filter(F.col("rating") > 0)


def clean(ratings: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Explicit ratings of known items."""
    return explicit(ratings).join(catalogue, "item", "left_semi").select("user", "item", "rating")


def thin(ratings: DataFrame, items: int = ITEM_SUPPORT, users: int = USER_SUPPORT) -> DataFrame:
    """Drop rare items, then users with few of the remaining ratings; one pass each, in that order."""
    return min_support(min_support(ratings, "item", items), "user", users).select(
        "user", "item", "rating"
    )


def density(ratings: DataFrame, stage: str) -> DataFrame:
    """Users, items, ratings, and the share of filled cells in percent."""
    sizes = ratings.agg(
        F.count_distinct("user").alias("n_users"),
        F.count_distinct("item").alias("n_items"),
        F.count(F.lit(1)).alias("n_ratings"),
    )
    cells = F.col("n_users").cast("double") * F.col("n_items")
    return sizes.select(
        F.lit(stage).alias("stage"),
        "n_users",
        "n_items",
        "n_ratings",
        (ratio("n_ratings", cells) * 100).alias("density_pct"),
    )


def split_rows(ratings: DataFrame) -> DataFrame:
    """Mark about 25 % of the rows as test by a hash of the row key."""
    return ratings.withColumn("is_test", is_test(["user", "item"]))


def holdout(ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test part of one split, as fold 0."""
    marked = split_rows(ratings).withColumn("fold", F.lit(0))
    return (
        marked.filter(~F.col("is_test")).drop("is_test"),
        marked.filter("is_test").drop("is_test"),
    )


def folded(ratings: DataFrame, folds: int) -> tuple[DataFrame, DataFrame]:
    """All folds at once: test rows carry their fold, training rows are repeated for the others."""
    marked = ratings.withColumn("fold", fold_of(["user", "item"], folds))
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))
    train = marked.withColumn("fold", F.explode(others))
    return train, marked


def rmse(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    return predictions.groupBy(*(by or [])).agg(
        F.sqrt(F.avg(F.pow(F.col("est") - F.col("rating"), 2))).alias("rmse")
    )


def prediction_support(predictions: DataFrame, train: DataFrame) -> DataFrame:
    """Absolute error of each prediction, with the training support of its user and its item."""
    per_user = train.groupBy("fold", "user").agg(F.count(F.lit(1)).alias("n_user"))
    per_item = train.groupBy("fold", "item").agg(F.count(F.lit(1)).alias("n_item"))
    return (
        predictions.join(per_user, ["fold", "user"], "left")
        .join(per_item, ["fold", "item"], "left")
        .select(
            "user",
            "item",
            "rating",
            "est",
            F.coalesce("n_user", F.lit(0)).alias("n_user"),
            F.coalesce("n_item", F.lit(0)).alias("n_item"),
            F.abs(F.col("est") - F.col("rating")).alias("err"),
        )
    )


def best_worst(errors: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` smallest and ``n`` largest errors, each by a bounded top-n over all partitions."""
    best = errors.orderBy("err", "user", "item").limit(n)
    worst = errors.orderBy(F.desc("err"), "user", "item").limit(n)
    return best.withColumn("side", F.lit("best")).unionByName(
        worst.withColumn("side", F.lit("worst"))
    )
