import random
from itertools import combinations

import numpy as np
import pytest

from cohortlens.llm import near_dup
from cohortlens.llm.queries import QUERIES
from tests.conftest import SMALL


def brute(rows):
    sets = {}
    for key, text in rows:
        words = (text or "").encode().lower().split()
        n = min(4, len(words))
        sets[key] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    parent = {k: k for k in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {k: (len(s), find(k)) for k, s in sets.items()}


def judge(out, want):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_query_against_brute_force(text_spark):
    rows = text_spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    judge(QUERIES["op7_near_dup"](text_spark, SMALL).collect(), brute([tuple(r) for r in rows]))


@pytest.mark.parametrize("block", [near_dup.BLOCK, 4])
def test_chains_and_blocks(text_spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "STARS", 4 if block > 4 else 1)
    random.seed(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = []
    for _ in range(6):
        base = random.choices(vocabulary, k=120)
        rows.append(list(base))
        for _ in range(12):
            # Each step changes a little, so ends of the chain are not linked themselves.
            base = list(base)
            for at in random.sample(range(len(base)), random.choice([1, 2, 3])):
                base[at] = random.choice(vocabulary)
            rows.append(list(base))
    random.shuffle(rows)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    rows += [(len(rows) + i, rows[i][1].upper()) for i in range(5)]
    docs = text_spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    assert len({c for _, c in want.values()}) < len(rows) - 20
    judge(near_dup.report(docs).collect(), want)


def test_odd_documents(text_spark, odd_documents):
    out = near_dup.report(odd_documents).collect()
    assert len(out) == odd_documents.count()
    want = brute([(r.doc_id, r.text) for r in odd_documents.collect() if r.doc_id is not None])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == want
    assert [r.kept for r in out if r.doc_id is None] == [True]
    kept = near_dup.drop_copies(odd_documents)
    assert kept.columns == odd_documents.columns
    assert near_dup.report(odd_documents.limit(0)).count() == 0


def test_components_of_a_path(text_spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101)]
    found = near_dup.components(text_spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    roots = {r.node: r.root for r in found}
    assert len({roots[i] for i in range(61)}) == 1 and roots[100] == roots[101] != roots[0]


def test_signatures_estimate_similarity():
    random = np.random.default_rng(1)
    a = np.unique(random.integers(0, 1 << 63, 1000, dtype=np.uint64))
    b = np.concatenate((a[:900], np.unique(random.integers(0, 1 << 63, 100, dtype=np.uint64))))
    same = (near_dup.signature(a) == near_dup.signature(b)).mean()
    assert abs(same - 900 / 1100) < 0.17


@pytest.mark.parametrize("seed", range(2))
def test_one_key_with_several_texts(text_spark, seed):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (1, a), (4, "alone here"), (4, a + " else"), (4, None)]
    random.Random(seed).shuffle(rows)
    docs = text_spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    # Every row is a node of its own; a component is named by its smallest key.
    numbered = brute(list(enumerate(t for _, t in rows)))
    smallest = {}
    for i, (key, _) in enumerate(rows):
        root = numbered[i][1]
        smallest[root] = min(smallest.get(root, key), key)
    want = sorted((key, numbered[i][0], smallest[numbered[i][1]]) for i, (key, _) in enumerate(rows))
    got = near_dup.report(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert {r.component_id for r in got if r.doc_id in (2, 3)} == {1}
