from pathlib import Path

from cohortlens.checks.all import QUERIES
from cohortlens.session import checkpoint_root, cut_lineage, hold, release
from tests.conftest import SMALL


def test_release_leaves_no_scratch_tables_and_no_held_rows(spark):
    release(spark)
    root = Path(checkpoint_root(spark).removeprefix("file:"))
    before = set(root.iterdir())
    QUERIES["topk_recs"](spark, SMALL).collect()
    kept = hold(spark.range(10))
    assert kept.count() == 10 and cut_lineage(spark.range(3)).count() == 3
    assert set(root.iterdir()) - before and kept.is_cached
    release(spark)
    assert set(root.iterdir()) <= before and not kept.storageLevel.useMemory


def test_release_of_one_session_leaves_the_tables_of_another(spark):
    mine, other = cut_lineage(spark.range(3)), cut_lineage(spark.newSession().range(4))
    release(other.sparkSession)
    assert mine.count() == 3
    release(spark)
