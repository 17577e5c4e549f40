"""Histogram trees against plain growth in numpy, whatever the partitions."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortlens.plans import histogram_trees as H

N, WIDTH, FOLDS = 240, 6, 4


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (N, WIDTH)).astype(float)
    x[:, 5] = x[:, 2]  # equal gains
    y = ((x[:, 0] > 4) ^ (x[:, 1] + rng.normal(0, 2, N) > 5)).astype(int)
    listed = [(i, int(y[i]), i % FOLDS, x[i].tolist()) for i in range(N)]
    frame = spark.createDataFrame(listed, "id int, label int, fold int, x array<double>")
    data = frame.select("id", "label", "fold", array_to_vector("x").alias("features"))
    return H.binned(data.repartition(5), WIDTH, bins=8), x, y


def plain_bins(x, cuts):
    return np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], 1)


def grow(b, s0, s1, depth, offer, score, good, node=1, out=None):
    """Depth-first growth on all rows at once: node -> (feature, bin, s0, s1)."""
    out = {} if out is None else out
    best = None
    if node.bit_length() <= depth:
        for f in offer(node):
            for cut in sorted(set(b[:, f])):
                left = b[:, f] <= cut
                a = s0[left].sum(), s1[left].sum()
                c = s0[~left].sum(), s1[~left].sum()
                if not (good(*a) and good(*c)):
                    continue
                gain = score(*map(float, a)) + score(*map(float, c)) - score(float(s0.sum()), float(s1.sum()))
                if gain > H.LEAST_GAIN and (best is None or gain > best[0]):
                    best = gain, f, cut, left
    if best is None:
        out[node] = (None, None, int(s0.sum()), int(s1.sum()))
        return out
    _, f, cut, left = best
    out[node] = (f, cut, int(s0.sum()), int(s1.sum()))
    grow(b[left], s0[left], s1[left], depth, offer, score, good, 2 * node, out)
    grow(b[~left], s0[~left], s1[~left], depth, offer, score, good, 2 * node + 1, out)
    return out


def table(tree, depth):
    leaves, open_, out = set(tree.leaves(depth)), [1], {}
    while open_:
        n = open_.pop()
        sums = tuple(int(v) for v in tree.sums[n])
        if n in leaves:
            out[n] = (None, None, *sums)
        else:
            out[n] = (int(tree.feature[n]), int(tree.bin[n]), *sums)
            open_ += [2 * n, 2 * n + 1]
    return out


def predict(tree, b):
    out = []
    for r in b:
        n = 1
        while tree[n][0] is not None:
            n = 2 * n + (r[tree[n][0]] > tree[n][1])
        out.append(n)
    return out


def test_grid_search_is_that_of_single_fits(rows):
    (frame, cuts), x, y = rows
    b = plain_bins(x, cuts)
    grid = H.grid_search(frame, WIDTH, [2, 5], [1, 3], FOLDS, bins=8)
    fold = np.arange(N) % FOLDS
    gini = lambda p, q: (p * p + q * q) / (p + q)
    accuracy = {}
    for choice in (2, 5):
        for depth in (1, 3):
            offer = lambda n, c=choice: H.offered_features(c, n, WIDTH)
            scores = []
            for own in range(-1, FOLDS):
                m = fold != own
                tree = grow(b[m], 1 - y[m], y[m], depth, offer, gini, lambda p, q: p + q > 0)
                assert table(grid.trees[choice, own], depth) == tree
                if own >= 0:
                    reached = predict(tree, b[~m])
                    scores.append(np.mean([(tree[n][3] > tree[n][2]) == t for n, t in zip(reached, y[~m])]))
            accuracy[choice, depth] = float(np.mean(scores))
    assert grid.accuracy == pytest.approx(accuracy)
    assert (grid.choice, grid.depth) == max(accuracy, key=lambda k: round(accuracy[k], 12))
    found = {r.id: r for r in H.tree_predictions(frame, grid.best, grid.depth).collect()}
    tree = table(grid.best, grid.depth)
    for i, n in enumerate(predict(tree, b)):
        assert found[i].prediction == int(tree[n][3] > tree[n][2])


def test_growth_takes_one_pass_a_level(spark, rows):
    (frame, _), _, _ = rows
    seen = spark.sparkContext.statusTracker().getJobIdsForGroup
    spark.sparkContext.setJobGroup("few", "folds and choices do not add jobs")
    H.grid_search(frame, WIDTH, [2], [2], 2, bins=8)
    few = len(seen("few"))
    spark.sparkContext.setJobGroup("many", "folds and choices do not add jobs")
    H.grid_search(frame, WIDTH, [2, 3, 5], [1, 2], FOLDS, bins=8)
    many = len(seen("many"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert many <= few + 4


def test_boosting_is_plain_second_order_boosting(rows):
    (frame, cuts), x, y = rows
    b = plain_bins(x, cuts)
    for parts in (1, 7):
        model = H.boost(frame.repartition(parts), WIDTH, rounds=4, depth=2, rate=0.6, bins=8)
        margin = np.zeros(N)
        score = lambda g, h: (g / H.UNIT) * (g / H.UNIT) / (h / H.UNIT + 1)
        for tree, value in zip(model.trees, model.values):
            p = H.sigmoid(margin)
            g = np.rint((p - y) * H.UNIT).astype(np.int64)
            h = np.rint(p * (1 - p) * H.UNIT).astype(np.int64)
            plain = grow(b, g, h, 2, lambda n: range(WIDTH), score, lambda g, h: h >= H.UNIT)
            assert table(tree, 2) == plain
            leaf = {n: -0.6 * (t[2] / H.UNIT) / (t[3] / H.UNIT + 1) for n, t in plain.items()}
            margin = margin + np.array([leaf[n] for n in predict(plain, b)])
        found = {r.id: r.score for r in H.boosted_predictions(frame, model).collect()}
        assert np.allclose([found[i] for i in range(N)], H.sigmoid(margin), atol=1e-12)
        rounds = H.boosted_predictions(frame, model, every_round=True)
        assert rounds.groupBy("round").count().count() == 4


def test_pure_and_empty_rows(spark):
    frame = spark.createDataFrame([(1, 1, 0, [1.0, 2.0])] * 3, "id int, label int, fold int, x array<double>")
    data = frame.select("id", "label", "fold", array_to_vector("x").alias("features"))
    pure, _ = H.binned(data, 2)
    grid = H.grid_search(pure, 2, [1], [3], 2)
    assert grid.best.leaves(3) == [1] and grid.best.sums[1].tolist() == [0, 3]
    none, cuts = H.binned(data.limit(0), 2)
    assert cuts == [[], []]
    assert H.grid_search(none, 2, [1], [3], 2).accuracy == {(1, 3): 0.0}
    assert H.boosted_predictions(none, H.boost(none, 2, 1, 2, 0.5)).count() == 0


def test_boosting_passes_walk_through_the_latest_trees_only(rows, monkeypatch):
    (frame, _), _, _ = rows
    whole = H.boost(frame, WIDTH, 5, 2, 0.6, bins=8)
    written, cut_lineage = [], H.cut_lineage
    monkeypatch.setattr(H, "cut_lineage", lambda df: written.append(cut_lineage(df)) or written[-1])
    monkeypatch.setattr(H, "ROUNDS_PER_CUT", 2)
    parts = H.boost(frame, WIDTH, 5, 2, 0.6, bins=8)
    # Rows keep their log odds after the rounds 2 and 4.
    assert len(written) == 2
    for n, got in zip((2, 4), written):
        kept = got.toPandas()
        assert kept["margin"].tolist() == whole.margins(H._matrix(kept["bins"]))[n - 1].tolist()
    assert all((a == b).all() for a, b in zip(whole.values, parts.values))


def test_histogram_sums_are_exact():
    rng = np.random.default_rng(1)
    flat, s = rng.integers(0, 7, (50, 3)), rng.integers(1 << 50, 1 << 51, 50)
    expected = np.zeros(7, np.int64)
    np.add.at(expected, flat, np.broadcast_to(s[:, None], flat.shape))
    assert H._summed(flat, s, 7).tolist() == expected.tolist()
