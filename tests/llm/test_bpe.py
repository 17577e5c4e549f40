import hashlib
import random

import numpy as np
import pytest
import tokenizers

from cohortlens.llm import bpe
from cohortlens.llm.queries import QUERIES, TOKENIZERS, word_tokenizer
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(str(TOKENIZERS / "word_bpe_49k.json"))


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_odd_texts(library):
    random.seed(4)
    parts = list("ab'sтΣé 1!?.-<|>\n\x1c\x85") + ["<|endoftext|>", "İ", "́", "’", "the", "ing", " "]
    texts = ["".join(random.choices(parts, k=random.randint(0, 50))) for _ in range(3000)]
    texts += [None, "", "  ", "!" * 5000, "ab" * 3000, "<|startoftext|><|endoftext|>", "a<|endof"]
    texts += ["".join(chr(c) for c in range(a, a + 40) if not 0xD800 <= c < 0xE000) for a in range(0, 0x30000, 97)]
    encoder = word_tokenizer().encoder()
    for text, ids in zip(texts, encoder.encode_batch(texts)):
        want, decoded = expected(library, text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert encoder.decode(ids).decode() == decoded


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 40)
    monkeypatch.setattr(bpe, "PAIRS", 30)
    encoder = bpe.Encoder(__import__("json").loads(word_tokenizer().raw))
    random.seed(5)
    texts = [" ".join("".join(random.choices("abcdefg", k=7)) for _ in range(30)) for _ in range(40)]
    for text, ids in zip(texts, encoder.encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == expected(library, text)[0]


def test_merging_long_and_short_agrees():
    encoder = word_tokenizer().encoder()
    random.seed(6)
    for _ in range(300):
        ids = encoder.parts("".join(random.choices("aeinrst", k=random.randint(1, 40))) + encoder.end)
        assert encoder._merge_long(list(ids)) == encoder.merge(list(ids))


def test_query_and_round_trip(text_spark, library, odd_documents):
    docs = text_spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op9_bpe"](text_spark, SMALL).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids, decoded = expected(library, d.text)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    encoded = bpe.encode(odd_documents, word_tokenizer(), ids="ids")
    assert encoded.columns[-1] == "ids_"
    for r in bpe.decode(encoded, word_tokenizer(), ids="ids_").collect():
        assert (r.ids_, r.decoded) == expected(library, r.text)
    assert bpe.report(odd_documents.limit(0), word_tokenizer()).count() == 0
