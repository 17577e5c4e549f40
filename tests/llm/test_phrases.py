import random
import re
from collections import Counter

import pytest

from cohortlens.llm import phrases


def brute_counts(rows, longest):
    """Counts of all phrases by language."""
    found = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    found[lang, tuple(words[i : i + size])] += 1
    return found


def brute(rows, least, longest=5, top=2000):
    f = brute_counts(rows, longest)
    totals = Counter()
    for (lang, p), n in f.items():
        if len(p) == 1:
            totals[lang] += n
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in candidates.items():
        inside = any(
            l2 == lang and len(q) > len(p) and b >= a
            and any(q[i : i + len(p)] == p for i in range(len(q)))
            for (l2, q), b in candidates.items()
        )
        if inside:
            continue
        cuts = []
        for k in range(1, len(p)):
            l, r = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((1000 * a * totals[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r, totals[lang]))
    return {
        (lang, rank): (p.decode(), -a, l, r, n, -s)
        for lang, rows in out.items()
        for rank, (s, a, p, l, r, n) in enumerate(sorted(rows)[:top], 1)
    }


def invented(seed, n):
    rng = random.Random(seed)
    words = ["The", "of", "état", "x\x0by", "new", "york", "City", "a", "b\x01", "ß", "日本", "rare"]
    weights = [12, 9, 5, 1, 6, 6, 5, 9, 2, 1, 1, 1]
    rows = []
    for i in range(n):
        parts = rng.choices(words, weights, k=rng.randint(0, 30))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ?"]) for w in parts)
        rows.append((i, rng.choice(["en", "en", "de", None]), text))
    return rows + [(n, "en", None), (n, None, ""), (0, "en", "new york new york new york"), (None, "xx", "a")]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(text_spark, monkeypatch, seed):
    monkeypatch.setattr(phrases, "BATCH_BYTES", 300)
    rows = invented(seed, 250)
    docs = text_spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    docs = docs.selectExpr("*", "'x' AS phrase", "1 AS n", "2 AS size")
    counts, _ = phrases.frequent(docs, min_count=6)
    plain = [r[1:] for r in rows]
    want = brute_counts(plain, 5)
    totals = Counter()
    for (lang, p), n in want.items():
        totals[lang] += n if len(p) == 1 else 0
    got = {(r.lang, r.phrase, r["size"]): r.n for r in counts.collect()}
    expected = {(lang, " ".join(p), len(p)): n for (lang, p), n in want.items() if n >= 6}
    expected |= {(lang, "", 0): n for lang, n in totals.items()}
    assert got == expected
    frame = phrases.collocations(counts, top=40)
    out = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect()}
    assert out == brute(plain, 6, top=40)


def test_failures_of_the_border_are_expanded(text_spark):
    # All words come from one document outside the sample, so that the sample proposes nothing of it.
    docs = text_spark.createDataFrame(
        [(i, "en", "one two three four five six. " * 9 if i == 3 else "other words") for i in range(40)],
        "doc_id bigint, lang string, text string",
    )
    outside = [
        m
        for m in range(2, 40)
        if docs.filter(f"doc_id = 3 AND pmod(xxhash64(doc_id, text), {m}) != 0").count()
    ]
    counts, failures = phrases.frequent(docs, min_count=9, sample=outside[0])
    assert failures > 0
    want = brute_counts([(r.lang, r.text) for r in docs.collect()], 5)
    got = {(r.phrase): r.n for r in counts.filter("size > 0").collect()}
    assert got == {" ".join(p): n for (_, p), n in want.items() if n >= 9}


def test_saturated_table_changes_nothing(text_spark, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_BITS", 6)
    monkeypatch.setattr(phrases, "MOST_BITS", 7)
    rows = invented(9, 120)
    docs = text_spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    counts, _ = phrases.frequent(docs, min_count=4)
    want = brute_counts([r[1:] for r in rows], 5)
    got = {(r.lang, r.phrase): r.n for r in counts.filter("size > 0").collect()}
    assert got == {(lang, " ".join(p)): n for (lang, p), n in want.items() if n >= 4}


def test_exact_scores_beyond_64_bits(text_spark):
    a, l, r, n = 10**13 + 7, 10**13 + 9, 3 * 10**13 + 1, 9 * 10**16 + 5
    rows = [("en", 0, "", n), ("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a)]
    counts = text_spark.createDataFrame(rows, "lang string, size int, phrase string, n bigint")
    assert phrases.collocations(counts).first().score == 1000 * a * n // (l * r)


def test_no_documents(text_spark):
    docs = text_spark.createDataFrame([], "doc_id bigint, lang string, text string")
    counts, failures = phrases.frequent(docs)
    assert counts.count() == 0 and failures == 0
    assert phrases.collocations(counts).count() == 0
