"""Bias rounds over deviations that lie where they are needed."""

from __future__ import annotations

import numpy as np
import pytest

from cohortlens.plans import recommend as M


def test_rounds_read_two_kept_layouts(spark, monkeypatch):
    """Each round brought the deviations to its key anew; results stay those of the plain rounds."""
    kept, hold = [], M.hold
    monkeypatch.setattr(M, "hold", lambda df: kept.append(df) or hold(df))
    rows = [(0, u, i, (u * 7 + i * 3) % 10 + 1) for u in range(12) for i in range(9) if (u + i) % 3]
    rows.append((0, None, 4, 9))
    train = spark.createDataFrame(rows, "fold int, user bigint, item bigint, rating int")
    by_user, by_item = M.bias_baseline(train, 3)
    plans = [df._jdf.queryExecution().analyzed().toString() for df in kept]
    assert [("Repartition" in p and "Sort" in p) for p in plans] == [True, True]

    mean = np.mean([r[3] for r in rows])
    user, item = {}, {}
    for n in range(3):
        known = [r for r in rows if n == 0 or r[1] is not None]
        for i in {r[2] for r in known}:
            own = [r[3] - mean - user.get(r[1], 0) for r in known if r[2] == i]
            item[i] = sum(own) / (M.ITEM_PENALTY + len(own))
        for u in {r[1] for r in rows}:
            own = [r[3] - mean - item[r[2]] for r in rows if r[1] == u]
            user[u] = sum(own) / (M.USER_PENALTY + len(own))
    assert {r.item: r.b_item for r in by_item.collect()} == pytest.approx(item)
    assert {r.user: r.b_user for r in by_user.collect()} == pytest.approx(user)
