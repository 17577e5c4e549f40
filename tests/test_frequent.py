"""Frequent values against plain counting: hot values, many distinct ones, ties, unknown values."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest

from cohortlens.operators import frequent


def plain(rows, columns, share):
    found = []
    for c in columns:
        known = [r[c] for r in rows if r[c] is not None and r[c] == r[c]]
        counts = sorted(Counter(known).items(), key=lambda x: (-x[1], x[0]))
        kept = [(v, n) for v, n in counts if n >= share * len(known)]
        found += [(c, i + 1, v, n, len(known)) for i, (v, n) in enumerate(kept)]
    return sorted(found, key=lambda r: r[:2])


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    n = 3000
    hot = np.where(rng.random(n) < 1 / 3, 7, rng.integers(100, 10**9, n))
    made = [
        {
            "hot": int(hot[i]),
            "zipf": f"w{int(rng.zipf(1.4)) % 400}",
            "ties": i % 20,
            "gaps": [None, float("nan"), -0.0, 0.0, 1.5, 2.5][i % 6],
            "alone": i,
            "none": None,
            "flag": i % 3 == 0,
        }
        for i in range(n)
    ]
    return made


SHAPE = "hot bigint, zipf string, ties int, gaps double, alone bigint, none double, flag boolean"


@pytest.mark.parametrize("share", [0.05, 0.01, 0.34])
def test_equals_plain_counting(spark, rows, share):
    columns = ["hot", "zipf", "ties", "gaps", "alone", "none", "flag"]
    df = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], SHAPE).repartition(6)
    got = [
        (r.column_name, r["rank"], r.value_number if r.value_text is None else r.value_text, r.n, r.known)
        for r in frequent.frequent_values(df, columns, share).collect()
    ]
    named = [{**r, "flag": str(r["flag"]).lower()} for r in rows]
    assert sorted(got, key=lambda r: r[:2]) == plain(named, columns, share)
    assert not any(r[0] in ("alone", "none") for r in got)


def test_no_rows(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert frequent.frequent_values(df, ["a", "b"]).collect() == []


def test_counters_are_bounded_and_little_too_low():
    rng = np.random.default_rng(2)
    frames = [pd.DataFrame({"c0": rng.zipf(1.3, 500).astype(float)}) for _ in range(20)]
    (made,) = frequent.summaries(frames, ["c0"], [False], 25)
    true = pd.concat(frames)["c0"].value_counts()
    counters = made[made.number.notna()]
    assert len(counters) <= 25 and made[made.number.isna()].n.tolist() == [10_000]
    low = true - counters.set_index(counters.number.astype(float)).n.reindex(true.index, fill_value=0)
    assert low.min() >= 0 and low.max() <= 10_000 / 26
