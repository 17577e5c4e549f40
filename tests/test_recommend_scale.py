"""Grids of fits run side by side and equal single fits."""

import threading

import pytest

from cohortlens.plans import recommend as M
from cohortlens.plans.ratings import folded, rmse


def test_grid_fits_side_by_side(spark, monkeypatch):
    listed = [(u, i, 1 + (u * 3 + i * 5) % 10) for u in range(12) for i in range(9) if (u + i) % 3]
    ratings = spark.createDataFrame(listed, "user int, item int, rating int")
    running, most, lock = [0], [0], threading.Lock()

    class Counted(M.ALS):
        def fit(self, *args):
            with lock:
                running[0] += 1
                most[0] = max(most[0], running[0])
            try:
                return super().fit(*args)
            finally:
                with lock:
                    running[0] -= 1

    monkeypatch.setattr(M, "ALS", Counted)
    got = M.als_grid(ratings, [1, 2], [0.1], [2], 2).collect()
    assert most[0] > 1
    assert sorted((r.rounds, r.penalty, r["rank"]) for r in got) == [(1, 0.1, 2), (2, 0.1, 2)]
    train, test = folded(ratings, 2)
    for r in got:
        own = rmse(M.als_predict(train, test, 2, None, r["rank"], r.rounds, r.penalty), ["fold"]).collect()
        assert r.rmse == pytest.approx(sum(x.rmse for x in own) / 2, abs=1e-5)
