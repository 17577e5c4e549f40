import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import token_counts
from cohortlens.llm.queries import QUERIES, TOKENIZERS
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter.read(str(TOKENIZERS / "byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_edits_equal_a_full_count(counter):
    pieces = counter.open()
    random.seed(2)
    parts = ["a", "b", " ", "  ", "\n", "'", "s", "ve", "1", "!", "é", " the", "     ", "Σ", "\t", "ll", "re"]
    for _ in range(800):
        state = token_counts.Counted("".join(random.choices(parts, k=random.randint(0, 900))), pieces)
        for _ in range(3):
            at, gone = random.randint(-2, len(state.text) + 3), random.choice([0, 1, 3, 50, 400])
            state.edit(at, gone, "".join(random.choices(parts, k=random.choice([0, 1, 2, 30, 300]))))
            assert state.n_tokens == len(pieces.encoding.encode_ordinary(state.text))
            assert state.chars.sum() == len(state.text)
            leaves = state.tree[len(state.tree) // 2 :]
            assert np.array_equal(token_counts.build_tree(leaves), state.tree)


def test_small_edit_of_a_long_text_encodes_little(counter):
    state = token_counts.Counted("some words of a text " * 20_000, counter.open())
    state.edit(200_000, 10, "new")
    assert state.encoded <= 3 < 1000 < state.built


def test_query_against_full_counts(text_spark, counter):
    docs = {r.doc_id: r for r in text_spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    encode = counter.open().encoding.encode_ordinary
    got = QUERIES["op3_token_counts"](text_spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        d = docs[r.doc_id]
        half = len(d.text) // 2
        text = f"{d.source}: " + d.text
        text = text[:half] + text[half + 40 :] + f" {d.lang}" if len(d.text) + 100 >= len(text) - 40 else None
        assert r.n_tokens == len(encode(d.text))
        assert text is None or r.n_tokens_edited == len(encode(text))


def test_odd_documents(text_spark, counter, odd_documents):
    edit = "array(named_struct('at', CAST(NULL AS INT), 'removed', 3, 'inserted', CAST(NULL AS STRING)), NULL)"
    frame = odd_documents.withColumn("edits", F.expr(f"CASE WHEN doc_id % 2 = 0 THEN {edit} END"))
    encode = counter.open().encoding.encode_ordinary
    out = token_counts.recount(frame, counter)
    assert "n_tokens_" in out.columns
    for r in out.collect():
        text = r.text or ""
        new = text[3:] if r.doc_id is not None and r.doc_id % 2 == 0 else text
        assert (r.n_tokens_, r.edited, r.n_tokens_edited) == (len(encode(text)), new, len(encode(new)))
    state = token_counts.count(odd_documents, counter, keep=["doc_id"]).collect()
    assert all((s.tree[1] if len(s.tree) > 1 else 0) == s.n_tokens for s in state)
    assert token_counts.recount(frame.limit(0), counter).count() == 0
