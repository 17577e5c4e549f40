import math
import random
import re
from collections import Counter

import pytest

from cohortlens.llm import lexical
from cohortlens.llm.common import bounded_parts


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, best):
    """item -> [(doc, score)], every document against every item."""
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms(text))
    out = {}
    for item, wanted in asked.items():
        found = []
        for d, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t, k in wanted.items() if c[t]
            )
            if score > 0:
                found.append((-score, d is None, d))
        found.sort()
        if found:
            out[item] = [(d, -s) for s, _, d in found[:best]]
    return out


def ranks(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: r["rank"]):
        rows = out.setdefault(r.item_id, [])
        rows.append((r.doc_id, r.score))
        assert r["rank"] == len(rows)
    return out


@pytest.mark.parametrize("block_bytes, scores", [(1 << 20, 1 << 20), (60, 30)])
def test_against_brute_force(text_spark, odd_documents, monkeypatch, block_bytes, scores):
    monkeypatch.setattr(lexical, "SCORES", scores)
    rng = random.Random(3)
    words = ["The", "the", "état", "a1", "日本", "x", "rare", "İ", "naïve", "\x1c", "_", "end"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "-", ", ", "\n"]) for _ in range(rng.randint(0, 25))) for _ in range(150)]
    docs = [(i, t) for i, t in enumerate(texts)]
    docs += [(i + 500, texts[4]) for i in range(60)] + [(None, texts[4]), (7, None), (8, ""), (9, "state " * 5000)]
    items = [(f"q{i}", " ".join(rng.choices(words, k=rng.randint(1, 6)))) for i in range(12)]
    items += [("q1", "rare rare X"), (None, "end of the"), ("none", None), ("blank", " .,"), ("far", "zzz"), ("d", texts[4])]
    frame = text_spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS score", "2 AS n")
    asked = text_spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "1 AS rank")
    found = lexical.search(frame.repartition(5), asked, best=4, block_bytes=block_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranks(found) == brute(docs, items, 4)
    if block_bytes < 1000:
        return
    odd = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert ranks(lexical.search(odd_documents, asked, block_bytes=block_bytes)) == brute(odd, items, 10)


def test_empty_tables(text_spark):
    docs = text_spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = text_spark.createDataFrame([("q", "a")], "item_id string, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert ranks(lexical.search(docs, items)) == brute([(1, "a b")], [("q", "a")], 10)


def test_parts_are_bounded(text_spark):
    rows = [(f"u{i % 40}", 1 + i % 3) for i in range(400)] + [("heavy", 70)]
    frame = text_spark.createDataFrame(rows, "unit string, weight bigint")
    parts = list(bounded_parts(frame, ["unit"], "weight", 60))
    assert sorted((r.unit, r.weight) for p in parts for r in p) == sorted(rows)
    for p in parts:
        assert sum(r.weight for r in p) <= 60 or {r.unit for r in p} == {"heavy"}
    assert list(bounded_parts(frame.limit(0), ["unit"], "weight", 60)) == [[]]
