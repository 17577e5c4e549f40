import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import neighbours
from cohortlens.llm.queries import QUERIES
from tests.conftest import SMALL


def brute(rows, k):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            scores = sorted((-float((x * y).sum()), i) for i, y in rows if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def ranked(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall(text_spark):
    rows = text_spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    want = brute([(r.vec_id, r.embedding) for r in rows], 20)
    got = ranked(QUERIES["op6_nearest_neighbours"](text_spark, SMALL))
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    vectors = {r.vec_id: np.array(r.embedding, float) for r in rows}
    assert all(abs(s - vectors[q] @ vectors[i]) < 1e-12 for q, g in got.items() for i, s in g)


@pytest.mark.parametrize("block", [neighbours.BLOCK, 7])
def test_odd_vectors_ties_and_copies(text_spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", min(block, 2) if block < 10 else 1024)
    random = np.random.default_rng(2)
    rows = [(i, random.integers(-3, 4, 4).astype(float).tolist()) for i in range(90)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100, 161)]
    good = [(i, v) for i, v in rows if any(v)]
    bad = [(200, None), (220, []), (240, [0.0] * 4), (260, [1.0, None, 1.0, 1.0]), (280, [1.0, float("nan"), 0.0, 0.0])]
    bad += [(300, [float("inf"), 0.0, 0.0, 1.0]), (320, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    frame = text_spark.createDataFrame(
        [(*r, 1, 2) for r in rows + bad], "vec_id bigint, embedding array<double>, rank int, score int"
    )
    # Enough probes to see every bucket: then the result is exact.
    got = ranked(neighbours.search(frame, F.col("id") % 20 == 0, k=5, tables=2, projections=2, width=4.0, probes=60))
    assert got == brute(good, 5)


def test_few_and_no_rows(text_spark):
    schema = "vec_id bigint, embedding array<float>"
    few = text_spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, -5.0])], schema)
    got = ranked(neighbours.search(few, F.col("id") % 20 == 0))
    assert got == {0: [(2, 0.0), (1, -1.0)]}
    one = text_spark.createDataFrame([(0, [1.0, 0.0])], schema)
    assert neighbours.search(one, F.col("id") % 20 == 0).count() == 0
    assert neighbours.search(one.limit(0), F.col("id") % 20 == 0).count() == 0


def spread_rows(sigma, outlier, n=2000, dimension=64):
    random = np.random.default_rng(1)
    x = random.standard_normal((n, dimension))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= np.exp(sigma * random.standard_normal(n))[:, None]
    x[7] *= outlier
    return list(enumerate(x.tolist()))


@pytest.mark.parametrize("sigma, outlier", [(0.5, 1), (0, 100)])
def test_recall_does_not_depend_on_norms(text_spark, sigma, outlier):
    rows = spread_rows(sigma, outlier)
    want = brute(rows, 20)
    frame = text_spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ranked(neighbours.search(frame, F.col("id") % 20 == 0))
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_full_recall_is_exact(text_spark):
    rows = spread_rows(0.25, 1, 600, 8)
    frame = text_spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ranked(neighbours.search(frame, F.col("id") % 20 == 0, recall=1.1))
    want = brute(rows, 20)
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want)


def test_success_is_the_share_of_vectors_in_visited_buckets():
    random = np.random.default_rng(4)
    distance = 1.3
    hit, told = [], []
    for seed in range(300):
        hashes = neighbours.Hashes(7, 2, 5, 2.0, 30)
        hashes.lines = random.standard_normal((8, 10)) / 2.0
        hashes.shifts = random.uniform(0, 1, 10)
        q = np.zeros((1, 8))
        way = random.standard_normal((1, 8))
        near = q + distance * way / np.linalg.norm(way)
        at = hashes.places(q)[0]
        cells, rest = np.floor(at), at - np.floor(at)
        offsets = [hashes.perturbations(r) for r in rest]
        other = np.floor(hashes.places(near)[0])
        hit.append(any((cells[t] + offsets[t] == other[t]).all(1).any() for t in range(2)))
        told.append(hashes.success(rest, offsets, distance))
    assert abs(np.mean(hit) - np.mean(told)) < 0.1
