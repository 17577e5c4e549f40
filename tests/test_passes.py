"""Neighbours and personal lists made in several passes equal those of one pass, and passes leave no shuffles."""

import time
from pathlib import Path

import numpy as np
import pytest

from cohortlens.operators import neighbours as N
from cohortlens.plans import recommend as M


@pytest.fixture(scope="module")
def ratings(spark):
    rng = np.random.default_rng(4)
    pairs = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 60, 900), rng.zipf(1.4, 900) % 50)})
    rows = [(0, u, i, int(rng.integers(1, 11))) for u, i in pairs]
    return spark.createDataFrame(rows, "fold int, user bigint, item bigint, rating int")


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.fixture
def small(monkeypatch):
    def shrink():
        for name, value in {"STEP_PAIRS": 700, "PASS_ENTRIES": 2000, "PASS_SHARE": 1}.items():
            monkeypatch.setattr(N, name, value)
        monkeypatch.setattr(M, "REACHED_EACH", 9000)

    return shrink


def test_passes_give_the_same_rows(spark, ratings, small):
    train, test = ratings.filter("(user + item) % 4 > 0"), ratings.filter("(user + item) % 4 = 0")
    once = [rows(M.knn_predict(train, test)), rows(M.personal_top(ratings, 5, 6))]
    small()
    made = []
    count = N._block_count
    N._block_count = lambda *a: made.append(count(*a)) or made[-1]
    try:
        again = [rows(M.knn_predict(train, test)), rows(M.personal_top(ratings, 5, 6))]
    finally:
        N._block_count = count
    assert all(passes > 1 for _, passes in made) and len(made) == 2
    assert again == once and len(once[0]) == test.count()


def test_finished_queries_leave_no_shuffle_files(spark, tmp_path):
    """A pass's shuffles would otherwise stay until the driver collects garbage."""
    import cohortlens.session as session

    session.apply_settings(spark)
    sc = spark.sparkContext
    folders = list(sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())

    def files():
        return {f for folder in folders for f in Path(folder.getPath()).rglob("shuffle_*.data")}

    before = files()
    spark.range(100_000).repartition(3, "id").write.parquet(str(tmp_path / "out"))
    # They are removed in the background.
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
