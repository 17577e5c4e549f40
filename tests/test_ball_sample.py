"""The sample that cuts are drawn from grows with the balls, not up to its bound at every size."""

import numpy as np

from cohortlens.operators import balls


def test_sample_is_as_large_as_the_balls_ask_for(spark, monkeypatch):
    monkeypatch.setattr(balls, "SAMPLE_LEAST", 64, raising=False)
    points = np.random.default_rng(1).integers(0, 50, (3000, 4)).astype(float)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "_id int, _vector array<double>")
    drawn = []
    first = balls._sample
    monkeypatch.setattr(balls, "_sample", lambda rows, n, width: drawn.append(first(rows, n, width)) or drawn[-1])
    cuts = balls._cuts(df, 900, 4)
    assert cuts.balls == 30 and drawn[0].shape == (960, 4)
    order = [r["_id"] for r in df.selectExpr("_id", "xxhash64(_id) AS h").orderBy("h", "_id").collect()]
    assert np.array_equal(drawn[0], points[order[:960]])
