"""Bucketed order and blocked neighbours against brute force, with heavy ties and several blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import balls, neighbours, ordered, stats
from cohortlens.plans import evaluation, recommend


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ENTITIES", 9)
    monkeypatch.setattr(neighbours, "STEP_PAIRS", 50)


def frame(spark, seed=3, users=40, items=25, rows=400):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {"user": rng.integers(0, users, rows), "item": rng.integers(0, items, rows)}
    ).drop_duplicates()
    pdf["rating"] = rng.integers(1, 11, len(pdf))
    return pdf, spark.createDataFrame(pdf)


def test_running_totals(spark):
    pdf = pd.DataFrame({"k": [0, 1] * 150, "v": range(300), "n": [i % 7 for i in range(300)]})
    got = ordered.running_totals(spark.createDataFrame(pdf), "v", ["n"], ["k"]).toPandas()
    pdf["expected"] = pdf.groupby("k")["n"].cumsum() - pdf["n"]
    merged = got.merge(pdf, on=["k", "v"])
    assert len(merged) == 300 and (merged.n_before == merged.expected).all()


def test_ordinal_with_a_value_holding_most_rows(spark):
    rng = np.random.default_rng(1)
    v = np.where(rng.random(500) < 0.6, 5.0, rng.integers(0, 12, 500).astype(float))
    pdf = pd.DataFrame({"v": v, "i": rng.permutation(500)})
    got = ordered.ordinal(spark.createDataFrame(pdf), "v", "i").toPandas()
    expected = pdf.sort_values(["v", "i"]).reset_index(drop=True)
    got = got.sort_values("ordinal").reset_index(drop=True)
    assert got.ordinal.tolist() == list(range(500))
    assert got.i.tolist() == expected.i.tolist()


def test_exact_quantiles(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 2, 2, 9, 10, None], "b": [0.0, 0, 0, 5, 5, 7, 8]})
    got = stats.exact_quantiles(spark.createDataFrame(pdf), ["a", "b"], [0.25, 0.5, 0.9]).toPandas()
    for _, row in got.iterrows():
        expected = pdf[row.column_name].dropna().quantile([0.25, 0.5, 0.9]).tolist()
        assert [row.q0, row.q1, row.q2] == pytest.approx(expected)


def test_roc_auc_with_ties(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"label": rng.integers(0, 2, 300), "score": rng.integers(0, 20, 300) / 20})
    pos, neg = pdf[pdf.label == 1].score.to_numpy(), pdf[pdf.label == 0].score.to_numpy()
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    got = evaluation.roc_auc(spark.createDataFrame(pdf)).first()[0]
    assert got == pytest.approx(wins / (len(pos) * len(neg)))


@pytest.mark.parametrize("measure", ["msd", "cosine"])
def test_similar_entities(spark, small_blocks, measure):
    pdf, df = frame(spark)
    got = neighbours.similar_entities(df, "user", "item", "rating", 4, measure).toPandas()
    pairs = pdf.merge(pdf, on="item")
    pairs = pairs[pairs.user_x != pairs.user_y]
    x, y = pairs.rating_x, pairs.rating_y
    pairs = pairs.assign(sq=(x - y) ** 2, xy=x * y, xx=x * x, yy=y * y, n=1)
    sums = pairs.groupby(["user_x", "user_y"])[["sq", "xy", "xx", "yy", "n"]].sum().reset_index()
    sums["sim"] = (
        1 / (sums.sq / sums.n + 1) if measure == "msd" else sums.xy / np.sqrt(sums.xx * sums.yy)
    )
    best = sums.sort_values(["user_x", "sim", "user_y"], ascending=[True, False, True])
    best = best.groupby("user_x").head(4)
    got = got.sort_values(["entity", "rank"])
    assert got.entity.tolist() == best.user_x.tolist()
    assert got.neighbour.tolist() == best.user_y.tolist()
    assert got.sim.tolist() == pytest.approx(best.sim.tolist())


def test_knn_estimates_do_not_depend_on_blocks(spark, monkeypatch):
    pdf, df = frame(spark, rows=600)
    marked = df.selectExpr("0 AS fold", "user", "item", "rating")
    train, test = marked.filter("(user + item) % 4 <> 0"), marked.filter("(user + item) % 4 = 0")
    biases = recommend.bias_baseline(train, rounds=2)
    order = ["user", "item"]
    whole = recommend.knn_predict(train, test, biases, k=3).toPandas().sort_values(order)
    monkeypatch.setattr(neighbours, "BLOCK_ENTITIES", 7)
    monkeypatch.setattr(neighbours, "STEP_PAIRS", 30)
    blocked = recommend.knn_predict(train, test, biases, k=3).toPandas().sort_values(order)
    assert len(whole) == test.count() and whole.n_neighbours.max() == 3
    assert whole.est_basic.tolist() == pytest.approx(blocked.est_basic.tolist())
    assert whole.est_baseline.tolist() == pytest.approx(blocked.est_baseline.tolist())


def brute_nearest(keys, points, asked, k):
    """(key, neighbour, distance2, rank) over all pairs."""
    found = []
    for i in np.flatnonzero(asked):
        gap = np.round(((points - points[i]) ** 2).sum(1), 9)
        others = sorted((g, key) for j, (g, key) in enumerate(zip(gap, keys)) if j != i)[:k]
        found += [(keys[i], key, g, n + 1) for n, (g, key) in enumerate(others)]
    return sorted(found)


def clustered(seed, n, centres, width):
    """Well separated clusters, a third of all rows being one repeated vector."""
    rng = np.random.default_rng(seed)
    points = rng.normal(0, 40, (centres, width))[rng.integers(0, centres, n)] + rng.normal(0, 1, (n, width))
    points[rng.permutation(n)[: n // 3]] = points[0]
    return points


@pytest.mark.parametrize(
    "points",
    [
        np.random.default_rng(2).integers(0, 4, (40, 3)).astype(float),
        np.random.default_rng(3).normal(1000, 1, (150, 8)),
        clustered(4, 300, 12, 5),
        np.zeros((30, 2)),
        np.array([[1.0], [2.0], [4.0]]),
        np.array([[1.0, 2.0]]),
    ],
    ids=["ties", "far from the origin", "clusters with copies", "one vector", "fewer than k", "one row"],
)
def test_nearest_vectors(spark, monkeypatch, points):
    monkeypatch.setattr(balls, "BLOCK_POINTS", 20)
    monkeypatch.setattr(balls, "STEP_CELLS", 50)
    keys = [f"k{i:03d}" for i in np.random.default_rng(5).permutation(len(points))]
    # In the last case of many, most blocks hold no row that is asked for.
    asked = np.arange(len(points)) % (40 if len(points) == 300 else 2) == 0
    df = spark.createDataFrame(
        [(k, p.tolist(), bool(w)) for k, p, w in zip(keys, points, asked)],
        "i string, v array<double>, w boolean",
    )
    wanted = None if len(points) == 150 else "w"
    got = balls.nearest_vectors(df, "i", "v", 5, wanted).collect()
    expected = brute_nearest(keys, points, asked | (wanted is None), 5)
    assert sorted((r.key, r.neighbour, r["rank"]) for r in got) == sorted((a, b, n) for a, b, _, n in expected)
    found = {(r.key, r["rank"]): r.distance2 for r in got}
    assert all(found[a, n] == pytest.approx(g, abs=1e-6) for a, _, g, n in expected)


def test_nearest_vectors_leave_unusable_rows_out(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [3.0, 4.0])]
    got = balls.nearest_vectors(spark.createDataFrame(rows, "i int, v array<double>"), "i", "v", 2).collect()
    assert sorted(map(tuple, got)) == [(1, 6, 25.0, 1), (6, 1, 25.0, 1)]
    assert balls.nearest_vectors(spark.createDataFrame([], "i int, v array<double>"), "i", "v", 2).count() == 0


def test_few_balls_are_opened_where_vectors_cluster(spark):
    points = clustered(6, 2000, 40, 4)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "i int, v array<double>")
    made = balls.search(df, "i", "v", 5, F.lit(True))
    opened = made.visits.agg(F.avg(F.size("_opened"))).first()[0]
    # Copies are one point, so about 1,334 points and 36 pivots.
    assert made.classes.count() == len(np.unique(points, axis=0)) and made.balls == 36
    assert opened < made.balls / 4


def test_few_balls_are_opened_where_one_coordinate_is_wide_and_others_are_categories(spark):
    rng = np.random.default_rng(7)
    categories = [np.eye(3)[rng.integers(0, 3, 3000)] for _ in range(3)]
    points = np.hstack([rng.integers(0, 60, (3000, 1)), *categories, rng.random((3000, 1))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "i int, v array<double>")
    made = balls.search(df, "i", "v", 5, F.lit(True))
    opened = made.visits.agg(F.avg(F.size("_opened"))).first()[0]
    assert made.balls == 54 and opened < made.balls / 10
    got = balls.nearest_vectors(df, "i", "v", 5, None).filter("key < 60").collect()
    expected = brute_nearest(list(range(3000)), points, np.arange(3000) < 60, 5)
    assert sorted((r.key, r.neighbour, r["rank"]) for r in got) == sorted((a, b, n) for a, b, _, n in expected)


def test_top_unseen_with_a_user_who_rated_almost_everything(spark, monkeypatch):
    monkeypatch.setattr(recommend, "RANKS_PER_SLICE", 4)
    rng = np.random.default_rng(4)
    rated = {(0, i) for i in range(30) if i not in (3, 17, 29)}
    rated |= {(int(u), int(i)) for u, i in zip(rng.integers(1, 9, 80), rng.integers(0, 30, 80))}
    scores = {i: float(rng.integers(0, 6)) for i in range(30)}
    got = recommend.top_unseen(
        spark.createDataFrame([(u, i, 5) for u, i in rated], "user int, item int, rating int"),
        spark.createDataFrame(list(scores.items()), "item int, score double"),
        5,
        spark.createDataFrame([(u,) for u in range(12)], "user int"),
    ).toPandas()
    for user in range(12):
        left = [i for i in range(30) if (user, i) not in rated]
        expected = sorted(left, key=lambda i: (-scores[i], i))[:5]
        mine = got[got.user == user].sort_values("position")
        assert mine.item.tolist() == expected
