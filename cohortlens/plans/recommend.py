"""Recommenders over rows (fold, user, item, rating).

``fold`` separates independent fits, so a cross-validation is one job per algorithm, not one per
fold. Estimates are clipped to the rating scale.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.expressions import hash_uniform
from cohortlens.operators.neighbours import rater_neighbours, similar_entities
from cohortlens.operators.ordered import ordinal
from cohortlens.plans import co_clusters
from cohortlens.plans.least_squares import ALS
from cohortlens.plans.ratings import folded, rmse
from cohortlens.session import checkpoint_root, cut_lineage, drop_step, hold, shuffle_partitions

# Rating scale and the default parameters of the compared algorithms.
SCALE = (1, 10)
BIAS_ROUNDS = 10
ITEM_PENALTY = 10
USER_PENALTY = 15
NEIGHBOURS = 40
CLUSTERS = 3
CLUSTER_ROUNDS = 20
# Fits that share the executors.
FITS_AT_ONCE = 6

ROUNDS_PER_CUT = 5
RANKS_PER_SLICE = 1024
# Rows that the ratings of one pass reach through similar items, at most.
REACHED_EACH = 100_000_000


def clip(estimate: Column) -> Column:
    return F.greatest(F.least(estimate, F.lit(float(SCALE[1]))), F.lit(float(SCALE[0])))


def fold_means(train: DataFrame) -> DataFrame:
    """Mean and population deviation per fold: as many rows as folds."""
    return train.groupBy("fold").agg(
        F.avg("rating").alias("mean"), F.stddev_pop("rating").alias("spread")
    )


def normal_predictor(train: DataFrame, test: DataFrame, seed: int = 42) -> DataFrame:
    """A normal draw with the training mean and deviation, seeded by the row key."""
    u, v = hash_uniform(["user", "item"], seed), hash_uniform(["user", "item"], seed + 1)
    draw = F.sqrt(-2 * F.log(u)) * F.cos(v * (2 * 3.141592653589793))
    return test.join(F.broadcast(fold_means(train)), "fold").select(
        "fold", "user", "item", "rating", clip(F.col("mean") + F.col("spread") * draw).alias("est")
    )


def bias_baseline(train: DataFrame, rounds: int = BIAS_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """User and item biases by alternating penalised means: (fold, user, b_user), (fold, item, b_item).

    Both steps combine before their shuffle. Every round reads the deviations twice, so they are written once
    and kept in two layouts, by user and by item, each in the order of its key: a round then moves its sums
    but no deviations. Lineage is cut every few rounds.
    """
    deviations = cut_lineage(
        train.join(F.broadcast(fold_means(train)), "fold").select(
            "fold", "user", "item", (F.col("rating") - F.col("mean")).alias("dev")
        )
    )
    parts = shuffle_partitions(train.sparkSession)

    def laid_out(side: str) -> DataFrame:
        # A null key joins nothing.
        known = deviations.filter(F.col("fold").isNotNull() & F.col(side).isNotNull())
        return hold(known.repartition(parts, "fold", side).sortWithinPartitions("fold", side))

    def step(rows: DataFrame, side: str, penalty: int) -> DataFrame:
        return rows.groupBy("fold", side).agg(
            (F.sum("left") / (F.lit(penalty) + F.count(F.lit(1)))).alias(f"b_{side}")
        )

    # Rows of all users, those without one too, count in the first round.
    users, items = laid_out("user"), laid_out("item")
    by_user = None
    for n in range(1, rounds + 1):
        rows = deviations.withColumn("left", F.col("dev"))
        if by_user is not None:
            rows = users.join(by_user.hint("merge"), ["fold", "user"]).withColumn(
                "left", F.col("dev") - F.col("b_user")
            )
        by_item = step(rows, "item", ITEM_PENALTY)
        if n == rounds:
            by_item = cut_lineage(by_item)
        rows = items.join(by_item.hint("merge"), ["fold", "item"]).withColumn(
            "left", F.col("dev") - F.col("b_item")
        )
        by_user = step(rows, "user", USER_PENALTY)
        if n % ROUNDS_PER_CUT == 0 or n == rounds:
            by_user = cut_lineage(by_user)
    return by_user, by_item


def with_baseline(
    rows: DataFrame, train: DataFrame, by_user: DataFrame, by_item: DataFrame
) -> DataFrame:
    """Add ``mean`` and ``base`` = mean + biases; an unknown user or item has bias 0."""
    return (
        rows.join(F.broadcast(fold_means(train).drop("spread")), "fold")
        .join(by_user, ["fold", "user"], "left")
        .join(by_item, ["fold", "item"], "left")
        .withColumn(
            "base",
            F.col("mean") + F.coalesce("b_user", F.lit(0.0)) + F.coalesce("b_item", F.lit(0.0)),
        )
    )


def baseline_predict(
    train: DataFrame, test: DataFrame, biases: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    by_user, by_item = biases or bias_baseline(train)
    return with_baseline(test, train, by_user, by_item).select(
        "fold", "user", "item", "rating", clip(F.col("base")).alias("est")
    )


def knn_predict(
    train: DataFrame,
    test: DataFrame,
    biases: tuple[DataFrame, DataFrame] | None = None,
    k: int = NEIGHBOURS,
    measure: str = "msd",
) -> DataFrame:
    """Similarity-weighted mean over the nearest raters of the item, plain and around the baseline.

    Returns ``est_basic`` (no neighbour: the mean) and ``est_baseline`` (no neighbour: the baseline).
    """
    by_user, by_item = biases or bias_baseline(train)
    known = cut_lineage(
        with_baseline(train, train, by_user, by_item).select(
            "fold", "user", "item", "rating", (F.col("rating") - F.col("base")).alias("resid")
        )
    )

    def means(near: DataFrame) -> DataFrame:
        return near.groupBy("fold", "user", "item").agg(
            (F.sum(F.col("sim") * F.col("rating")) / F.sum("sim")).alias("knn_mean"),
            (F.sum(F.col("sim") * F.col("resid")) / F.sum("sim")).alias("knn_resid"),
            F.count(F.lit(1)).alias("n_neighbours"),
        )

    weighted = rater_neighbours(known, test.select("fold", "user", "item"), ["fold"], k, measure, means)
    return (
        with_baseline(test, train, by_user, by_item)
        .join(weighted, ["fold", "user", "item"], "left")
        .select(
            "fold",
            "user",
            "item",
            "rating",
            F.coalesce("n_neighbours", F.lit(0)).alias("n_neighbours"),
            clip(F.coalesce("knn_mean", "mean")).alias("est_basic"),
            clip(F.col("base") + F.coalesce("knn_resid", F.lit(0.0))).alias("est_baseline"),
        )
    )


def als_predict(
    train: DataFrame,
    test: DataFrame,
    folds: int = 1,
    biases: tuple[DataFrame, DataFrame] | None = None,
    rank: int = 10,
    rounds: int = 10,
    penalty: float = 0.1,
) -> DataFrame:
    """Matrix factorisation of what the baseline leaves over, added back to the baseline.

    ``user`` and ``item`` must be integers. One fit per fold.
    """
    known, asked = _residues(train, test, biases or bias_baseline(train))
    return _als_estimates(known, asked, folds, [(rounds, penalty, rank)]).drop("choice")


def _residues(
    train: DataFrame, test: DataFrame, biases: tuple[DataFrame, DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """What the baseline leaves of the training rows, and the test rows with it; written once for many fits."""
    known = with_baseline(train, train, *biases).select(
        "fold", "user", "item", (F.col("rating") - F.col("base")).alias("resid")
    )
    asked = with_baseline(test, train, *biases).select("fold", "user", "item", "rating", "base")
    return cut_lineage(known), cut_lineage(asked)


def _als_estimates(
    known: DataFrame, asked: DataFrame, folds: int, choices: list[tuple[int, float, int]]
) -> DataFrame:
    """(choice, fold, user, item, rating, est): one fit per fold and (rounds, penalty, rank), some side by side."""
    checkpoint_root(known.sparkSession)
    # Choices that differ in rounds alone are one fit.
    fits: dict[tuple[float, int], list[int]] = {}
    for n, (_, penalty, rank) in enumerate(choices):
        fits.setdefault((penalty, rank), []).append(n)

    def estimates(some: list[int], fold: int) -> DataFrame:
        _, penalty, rank = choices[some[0]]
        here = F.col("fold") == fold
        found = ALS(rank, [choices[n][0] for n in some], penalty).fit(known.filter(here), asked.filter(here))
        rows = [
            found[choices[n][0]].select(
                F.lit(n).alias("choice"),
                "fold",
                "user",
                "item",
                "rating",
                clip(F.col("base") + F.coalesce(F.nanvl("factor", F.lit(0.0)), F.lit(0.0))).alias("est"),
            )
            for n in some
        ]
        return cut_lineage(reduce(DataFrame.unionByName, rows))

    tasks = [(some, fold) for some in fits.values() for fold in range(folds)]
    # The longest first.
    tasks.sort(key=lambda task: -choices[task[0][0]][2])
    with ThreadPool(min(FITS_AT_ONCE, len(tasks))) as pool:
        run = inheritable_thread_target(known.sparkSession)(lambda task: estimates(*task))
        return reduce(DataFrame.unionByName, pool.map(run, tasks, chunksize=1))


def als_grid(
    ratings: DataFrame, rounds: list[int], penalties: list[float], ranks: list[int], folds: int = 3
) -> DataFrame:
    """Cross-validated RMSE per parameter choice, best first. The baseline is fitted once."""
    train, test = folded(ratings, folds)
    biases = bias_baseline(train)
    choices = [(n, penalty, rank) for n in rounds for penalty in penalties for rank in ranks]
    found = rmse(_als_estimates(*_residues(train, test, biases), folds, choices), ["choice", "fold"])
    tried = F.array(*[F.struct(*[F.lit(v) for v in choice]) for choice in choices])
    names = ["rounds", "penalty", "rank"]
    rows = found.groupBy("choice").agg(F.avg("rmse").alias("rmse")).select(
        *[F.get(tried, F.col("choice"))[f"col{i}"].alias(c) for i, c in enumerate(names, 1)], "rmse"
    )
    return rows.orderBy("rmse", "rounds", "penalty", "rank")


def _cluster_stats(rows: DataFrame, clusters: DataFrame, side: str, other: str) -> DataFrame:
    """Per ``side`` entity and cluster of the other side: count, sum of ratings, sum of residues."""
    cells = []
    for c in range(CLUSTERS):
        here = f"FILTER (WHERE c_{other} = {c})"
        cells += [
            F.expr(f"count(*) {here} AS n{c}"),
            F.expr(f"coalesce(sum(rating) {here}, 0) AS r{c}"),
            F.expr(f"coalesce(sum(left) {here}, 0) AS x{c}"),
        ]
    return rows.join(clusters, ["fold", other]).groupBy("fold", side).agg(*cells)


def _cluster_means(stats: DataFrame, clusters: DataFrame, means: DataFrame) -> DataFrame:
    """One row per fold: co-cluster means ``m<u><i>``, user cluster ``u<u>`` and item cluster ``i<i>``."""
    span = range(CLUSTERS)
    sums = [
        F.expr(f"coalesce(sum({c}{i}) FILTER (WHERE c_user = {u}), 0) AS {c}{u}{i}")
        for u in span
        for i in span
        for c in "rn"
    ]

    def mean(cells: list[tuple[int, int]], name: str) -> str:
        total = " + ".join(f"r{u}{i}" for u, i in cells)
        count = " + ".join(f"n{u}{i}" for u, i in cells)
        return f"coalesce(try_divide(double({total}), double({count})), mean) AS {name}"

    return (
        stats.join(clusters, ["fold", "user"])
        .groupBy("fold")
        .agg(*sums)
        .join(F.broadcast(means), "fold")
        .selectExpr(
            "fold",
            *[mean([(u, i)], f"m{u}{i}") for u in span for i in span],
            *[mean([(u, i) for i in span], f"u{u}") for u in span],
            *[mean([(u, i) for u in span], f"i{i}") for i in span],
        )
    )


def _assign(stats: DataFrame, centres: DataFrame, side: str) -> DataFrame:
    """Cluster with the smallest squared error, from the per-entity sums alone."""
    errors = []
    for own in range(CLUSTERS):
        terms = []
        for c in range(CLUSTERS):
            u, i = (own, c) if side == "user" else (c, own)
            shift = f"(m{u}{i} - u{u} - i{i})"
            terms.append(f"{shift} * {shift} * n{c} - 2 * {shift} * x{c}")
        errors.append(" + ".join(terms))
    return (
        stats.join(F.broadcast(centres), "fold")
        .selectExpr("fold", side, f"array({', '.join(errors)}) AS errors")
        .selectExpr(
            "fold", side, f"int(array_position(errors, array_min(errors)) - 1) AS c_{side}"
        )
    )


def _first_cluster(side: str) -> Column:
    return F.floor((1 - hash_uniform([side], 42)) * CLUSTERS).cast("int")


def _clusters_by_joins(rows: DataFrame, means: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters of users and of items, and their means, for ratings of any number."""

    def start(side: str) -> DataFrame:
        return rows.select("fold", side).distinct().withColumn(f"c_{side}", _first_cluster(side))

    users, items = cut_lineage(start("user")), cut_lineage(start("item"))
    for _ in range(rounds):
        old = users, items
        stats = _cluster_stats(rows, items, "user", "item")
        centres = _cluster_means(stats, users, means)
        users = cut_lineage(_assign(stats, centres, "user"))
        items = cut_lineage(_assign(_cluster_stats(rows, users, "item", "user"), centres, "item"))
        for spent in old:
            drop_step(spent)
    return users, items, _cluster_means(_cluster_stats(rows, items, "user", "item"), users, means)


def co_cluster_predict(train: DataFrame, test: DataFrame, rounds: int = CLUSTER_ROUNDS) -> DataFrame:
    """Co-clustering: users and items are reassigned in turn to the cluster that fits best.

    A reassignment needs only per-entity sums by cluster, and the cluster means are one row per fold. Folds that
    one task can hold go through their rounds there.
    """
    means = cut_lineage(fold_means(train).drop("spread"))
    by_user = train.groupBy("fold", "user").agg(F.avg("rating").alias("user_mean"))
    by_item = train.groupBy("fold", "item").agg(F.avg("rating").alias("item_mean"))
    rows = cut_lineage(
        train.join(by_user, ["fold", "user"])
        .join(by_item, ["fold", "item"])
        .withColumn("left", F.col("rating") - F.col("user_mean") - F.col("item_mean"))
        .select("fold", "user", "item", "rating", "left")
    )

    if co_clusters.fits(rows):
        begun = rows.withColumns({f"c_{side}": _first_cluster(side) for side in ("user", "item")})
        users, items, centres = co_clusters.clusters(begun, [tuple(r) for r in means.collect()], CLUSTERS, rounds)
    else:
        users, items, centres = _clusters_by_joins(rows, means, rounds)

    def at(name: Callable[[int, int], str]) -> Column:
        picked = F.lit(None).cast("double")
        for u in range(CLUSTERS):
            for i in range(CLUSTERS):
                cell = (F.col("c_user") == u) & (F.col("c_item") == i)
                picked = F.when(cell, F.col(name(u, i))).otherwise(picked)
        return picked

    both = (
        at(lambda u, i: f"m{u}{i}")
        + F.col("user_mean")
        - at(lambda u, i: f"u{u}")
        + F.col("item_mean")
        - at(lambda u, i: f"i{i}")
    )
    return (
        test.join(users.join(by_user, ["fold", "user"]), ["fold", "user"], "left")
        .join(items.join(by_item, ["fold", "item"]), ["fold", "item"], "left")
        .join(F.broadcast(centres), "fold")
        .join(F.broadcast(means), "fold")
        .select(
            "fold",
            "user",
            "item",
            "rating",
            F.col("c_user"),
            F.col("c_item"),
            clip(F.coalesce(both, "user_mean", "item_mean", "mean")).alias("est"),
        )
    )


def leaderboard(ratings: DataFrame, folds: int = 3, more: dict[str, Callable] | None = None) -> DataFrame:
    """Mean cross-validated RMSE of the algorithms, best first; ``more`` adds estimates by name.

    A function in ``more`` takes the train and the test rows of all folds.
    """
    train, test = folded(ratings, folds)
    train, test = cut_lineage(train), cut_lineage(test)
    biases = bias_baseline(train)
    near = cut_lineage(knn_predict(train, test, biases))
    estimates = {
        "als": als_predict(train, test, folds, biases, rounds=20),
        "normal": normal_predictor(train, test),
        "knn_baseline": near.withColumn("est", F.col("est_baseline")),
        "knn_basic": near.withColumn("est", F.col("est_basic")),
        "baseline": baseline_predict(train, test, biases),
        "co_cluster": co_cluster_predict(train, test),
    }
    estimates |= {name: f(train, test) for name, f in (more or {}).items()}
    rows = None
    for name, predictions in estimates.items():
        row = rmse(predictions, ["fold"]).select(F.lit(name).alias("algorithm"), "fold", "rmse")
        rows = row if rows is None else rows.unionByName(row)
    return (
        rows.groupBy("algorithm").agg(F.avg("rmse").alias("test_rmse")).orderBy("test_rmse", "algorithm")
    )


def unseen_items(ratings: DataFrame, user) -> DataFrame:
    """Items of the rating table that one user has not rated."""
    return (
        ratings.select("item")
        .distinct()
        .join(ratings.filter(F.col("user") == user).select("item"), "item", "left_anti")
    )


def knn_predict_items(
    train: DataFrame,
    test: DataFrame,
    biases: tuple[DataFrame, DataFrame] | None = None,
    k: int = NEIGHBOURS,
    measure: str = "msd",
) -> DataFrame:
    """``knn_predict`` over the most similar items that the user has rated: users and items change places."""

    other = {"user": "item", "item": "user"}

    def swap(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(c).alias(other.get(c, c)) for c in rows.columns])

    by_user, by_item = biases or bias_baseline(train)
    turned = (
        by_item.withColumnsRenamed({"item": "user", "b_item": "b_user"}),
        by_user.withColumnsRenamed({"user": "item", "b_user": "b_item"}),
    )
    return swap(knn_predict(swap(train), swap(test), turned, k, measure))


def personal_top(
    ratings: DataFrame, k: int = 10, near: int = NEIGHBOURS, measure: str = "msd"
) -> DataFrame:
    """Each user's ``k`` best unseen items: (user, item, est, n_neighbours, position).

    Items are reached from a user's ratings through the ``near`` most similar items of every item, so
    there are ratings x ``near`` rows at most and no user x item product. The estimate is the
    similarity-weighted mean of the user's ratings of the neighbours; ties go to more neighbours, then to
    the smaller item.
    """
    links = similar_entities(ratings, "item", "user", "rating", near, measure).select(
        F.col("entity").alias("item"), F.col("neighbour").alias("rated"), "sim"
    )
    passes = max(1, -(-ratings.count() * near // REACHED_EACH))
    if passes > 1:
        # Every pass meets the links where they are.
        parts = shuffle_partitions(ratings.sparkSession)
        links = hold(links.repartition(parts, "rated").sortWithinPartitions("rated")).hint("merge")
    order = Window.partitionBy("user").orderBy(F.desc("est"), F.desc("n_neighbours"), "item")

    def best(own: DataFrame) -> DataFrame:
        reached = own.select("user", F.col("item").alias("rated"), "rating").join(links, "rated")
        scored = reached.groupBy("user", "item").agg(
            F.round(F.sum(F.col("sim") * F.col("rating")) / F.sum("sim"), 6).alias("est"),
            F.count(F.lit(1)).alias("n_neighbours"),
        )
        unseen = scored.join(own.select("user", "item"), ["user", "item"], "left_anti")
        return unseen.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)

    if passes == 1:
        return best(ratings)
    # Users share nothing but the links, so some of them are done at a time, and disk holds what these reach.
    part_of = F.pmod(F.xxhash64("user", F.lit(1)), F.lit(passes))
    return reduce(DataFrame.unionByName, [cut_lineage(best(ratings.filter(part_of == n))) for n in range(passes)])


def top_unseen(
    ratings: DataFrame, item_scores: DataFrame, k: int = 10, users: DataFrame | None = None
) -> DataFrame:
    """For every user the ``k`` best-scored items not rated yet: (user, item, score, position).

    ``users`` lists the users (column ``user``); without it, those of ``ratings``. A user without ratings
    gets the first ``k``.

    Items are numbered by score once. A user's k-th unseen item then sits at rank k - 1 + m, where m
    counts the rated items ranked below it, so only ``k + m`` ranks per user are listed and the rated
    ones removed: no user x item product. Ranks are counted in slices, so that a user with very many
    ratings is not one group. ``item_scores`` holds (item, score), ``item`` numeric.
    """
    ranked = cut_lineage(
        ordinal(item_scores.withColumn("_order", -F.col("score")), "_order", "item", "rank").select(
            "item", "score", "rank"
        )
    )
    seen = cut_lineage(
        ratings.select("user", "item")
        .distinct()
        .join(ranked.select("item", "rank"), "item")
        .select("user", "rank", F.floor(F.col("rank") / RANKS_PER_SLICE).alias("slice"))
    )
    earlier = (
        Window.partitionBy("user").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    slices = (
        seen.groupBy("user", "slice")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("user", "slice").orderBy("rank")
    rated_below = F.col("before") + F.row_number().over(inside) - 1
    found = (
        seen.join(slices, ["user", "slice"])
        .withColumn("unseen_below", F.col("rank") - rated_below)
        .groupBy("user")
        .agg(F.count_if(F.col("unseen_below") < k).alias("m"))
    )
    everybody = (ratings if users is None else users).select("user").distinct()
    depth = everybody.join(found, "user", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    last = ranked.agg(F.max("rank").alias("last")).scalar()
    # Listed slice by slice, so that no row carries an array of all ranks of a heavy user.
    zero, per = F.lit(0).cast("bigint"), F.lit(RANKS_PER_SLICE).cast("bigint")
    first = F.col("slice") * per
    listed = (
        depth.withColumn("upto", F.least(F.col("m") + k - 1, last))
        .filter(F.col("upto") >= 0)
        .select("user", "upto", F.explode(F.sequence(zero, F.floor(F.col("upto") / per))).alias("slice"))
        .select("user", F.explode(F.sequence(first, F.least("upto", first + per - 1))).alias("rank"))
        .join(seen.select("user", "rank"), ["user", "rank"], "left_anti")
    )
    order = Window.partitionBy("user").orderBy("rank")
    return (
        listed.withColumn("position", F.row_number().over(order))
        .join(ranked, "rank")
        .select("user", "item", "score", "position")
    )
