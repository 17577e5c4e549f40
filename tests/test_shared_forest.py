"""Forests of a grid search that grow together."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortlens.plans import models as M
from cohortlens.plans import shared_forest as S


@pytest.fixture(scope="module")
def rows(spark):
    x = [F.round(F.rand(i) * 8, 1) for i in range(4)]
    made = spark.range(600, numPartitions=3).select(
        F.lit(1).alias("cohort"), F.col("id").cast("string").alias("emplid"), *[c.alias(f"x{i}") for i, c in enumerate(x)]
    )
    made = made.withColumn("label", ((F.col("x0") > 4) != (F.col("x1") > 5)).cast("int"))
    features = array_to_vector(F.array(*[F.col(f"x{i}") for i in range(4)])).alias("features")
    return made.select("cohort", "emplid", "label", (F.crc32("emplid") % 4).cast("int").alias("fold"), features).cache()


def test_all_fits_share_a_pass_per_level(spark, rows, monkeypatch):
    """One forest after the other took as many passes as the grid has folds and choices."""
    grown = []
    grow = S.grow
    monkeypatch.setattr(S, "grow", lambda spread, fits, *a: grown.append(fits) or grow(spread, fits, *a))
    search = M.ForestSearch(["1", "sqrt"], trees=10, depth=5, folds=4)
    model = search.fit(rows)
    assert grown == [[(w, fold) for w in (1, 2) for fold in range(-1, 4)]]
    assert model.trees.feature.shape == (2 * (4 + 1) * 10, 32)
    found = M.predict(model, rows.withColumn("is_dev", F.lit(False))).toPandas()
    assert (found["label"] == found["prediction"]).mean() > 0.9
    assert max(search.accuracy) > 0.8
    assert M.chosen_parameters(model) == f"featureSubsetStrategy={('1', 'sqrt')[int(np.argmax(search.accuracy))]}"


def test_partitions_do_not_matter(rows, monkeypatch):
    search = M.ForestSearch(["sqrt"], trees=3, depth=4, folds=4)
    one = search.fit(rows).trees
    monkeypatch.setattr(S, "ROWS_A_PART", 200)
    monkeypatch.setattr(S, "BLOCK", 50)
    other = search.fit(rows.repartition(5)).trees
    for name in ("feature", "bin", "share"):
        assert (getattr(one, name) == getattr(other, name)).all()


def test_trees_are_those_of_a_plain_growth(rows):
    """Every node is cut where a walk over all its rows finds the best cut."""
    search = M.ForestSearch(["sqrt"], trees=4, depth=3, folds=4)
    model = search.fit(rows)
    draw = F.xxhash64("cohort", "emplid", "label", M.vector_to_array("features"))
    frame = rows.select("label", "fold", draw.alias("draw"), M.vector_to_array("features").alias("x")).toPandas()
    x = S._bins(np.stack(frame["x"].to_list()), model.cuts)
    label, draws = frame["label"].to_numpy(), frame["draw"].to_numpy().view(np.uint64)
    for fold in range(-1, 4):
        for j in range(4):
            t = (fold + 1) * 4 + j
            times = S.times_drawn(draws, j) * (frame["fold"].to_numpy() != fold)

            def grow(node: int, at: np.ndarray) -> None:
                w, y = times[at], label[at]
                share = (w * y).sum() / w.sum()
                level = node.bit_length() - 1
                best = (1e-9, None)
                names = S.offered(2, j, level, 4)[node - (1 << level)] if level < 3 else []
                for f in names:
                    for b in range(S.BINS):
                        left = x[at, f] <= b
                        n = [w[left].sum(), w[~left].sum()]
                        if min(n) > 0:
                            score = sum(
                                ((w * y)[s].sum() ** 2 + (w * (1 - y))[s].sum() ** 2) / k for s, k in zip((left, ~left), n)
                            )
                            gain = round(score - ((w * y).sum() ** 2 + (w * (1 - y)).sum() ** 2) / w.sum(), 9)
                            if gain > best[0]:
                                best = (gain, (f, b))
                if best[1] is None:
                    assert level == 3 or model.trees.bin[t, node] == S.NO_CUT
                    end = node << (3 - level)
                    assert model.trees.share[t, end] == pytest.approx(share, abs=1e-6)
                    return
                assert (model.trees.feature[t, node], model.trees.bin[t, node]) == best[1]
                left = x[at, best[1][0]] <= best[1][1]
                grow(2 * node, at[left])
                grow(2 * node + 1, at[~left])

            grow(1, np.flatnonzero(times))


def test_rare_values_can_be_cut(spark):
    values = [(float(i < 3), float(i)) for i in range(400)]
    rows = spark.createDataFrame([(list(v),) for v in values], "_x array<double>")
    few, many = S.cut_points(rows, 2)
    assert few.tolist() == [0.0] and len(many) == 31


def test_null_labels_are_an_error(rows):
    with pytest.raises(Exception, match="must not be null"):
        M.ForestSearch(["1"], trees=1, depth=1, folds=4).fit(rows.withColumn("label", F.lit(None).cast("int")))
