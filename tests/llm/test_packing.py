import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tokenizers

from cohortlens.llm import packing
from cohortlens.llm.queries import QUERIES, TOKENIZERS, word_tokenizer
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(str(TOKENIZERS / "word_bpe_49k.json"))


def one_by_one(histogram, size):
    """Shortest-pack-first item by item."""
    packs = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fullest = min(range(len(packs)), key=lambda i: packs[i], default=None)
            if fullest is None or packs[fullest] + length > size:
                packs.append(length)
            else:
                packs[fullest] += length
    return packs


def check_plan(histogram, size, padding):
    found = packing.plan(histogram, size, padding)
    used = defaultdict(list)
    for length, n in histogram.items():
        seq, off, token = found.place(np.full(n, length), np.arange(n))
        for s, o, t in zip(seq.tolist(), off.tolist(), token.tolist()):
            if t < 0:
                used[s].append((o, length))
            else:
                done = 0
                for start, take, s2, o2 in found.cut(t, length):
                    assert start == done and take > 0
                    done += take
                    used[s2].append((o2, take))
                assert done == length
    assert sorted(used) == list(range(len(used)))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    total = sum(k * n for k, n in histogram.items())
    assert len(used) * size - total <= max(size - 1, int(padding * total) + 0)


@pytest.mark.parametrize("seed", range(30))
def test_bulk_packing_equals_one_by_one(seed):
    rng = random.Random(seed)
    size = rng.choice([8, 20, 64])
    histogram = {rng.randint(1, size - 1): rng.randint(1, 40) for _ in range(rng.randint(0, 25))}
    packs = packing.pack_histogram(histogram, size)
    items = Counter()
    for p in packs:
        assert sum(a * t for a, t in p.items) + p.space == size and p.count > 0
        for length, times in p.items:
            items[length] += times * p.count
    assert items == Counter(histogram)
    fills = Counter()
    for p in packs:
        fills[size - p.space] += p.count
    assert fills == Counter(one_by_one(histogram, size))
    check_plan(histogram | {size: 3}, size, rng.choice([0.0, 0.2]))


def test_lengths_that_fit_badly():
    check_plan({1100: 5000}, 2048, 0.0)
    check_plan({1: 100_000}, 2048, 0.0)
    check_plan({2047: 3000, 1030: 999, 7: 3}, 2048, 0.0)
    check_plan({}, 2048, 0.0)
    check_plan({5: 1}, 2048, 0.0)


def check_pieces(rows, documents, library, size):
    """Every id in one piece, offsets gapless, checksums right."""
    want = Counter()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert Counter(set(pieces)) == Counter({d for d, _ in documents})
    for doc_id, text in documents:
        want[doc_id] += 1
    texts = dict(documents)
    for doc_id, own in pieces.items():
        if want[doc_id] > 1:
            continue
        ids = [*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            data = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert zlib.crc32(data) == r.ids_crc32
            if "ids" in r:
                assert bytes(r.ids) == data
            at += r.length
        assert at == len(ids)
    placed = defaultdict(list)
    for r in rows:
        placed[r.sequence_id].append((r.offset, r.length))
    for parts in placed.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at <= size
    assert sum(r.length for r in rows) > (len(placed) - 1) * size


def test_query(text_spark, library):
    documents = [(r.doc_id, r.text) for r in text_spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    frame = QUERIES["op13_packing"](text_spark, SMALL)
    assert frame.dtypes == [
        ("doc_id", "bigint"),
        ("start", "bigint"),
        ("length", "bigint"),
        ("ids_crc32", "bigint"),
        ("doc_tokens", "bigint"),
        ("sequence_id", "bigint"),
        ("offset", "bigint"),
    ]
    check_pieces(frame.collect(), documents, library, 2048)


def test_odd_documents_in_short_sequences(text_spark, library, odd_documents):
    documents = [(r.doc_id, r.text) for r in odd_documents.collect()]
    for padding in (0.0, 1.0):
        packed = packing.pack(odd_documents, word_tokenizer(), size=16, padding=padding, with_ids=True)
        rows = packed.collect()
        if not padding:
            check_pieces(rows, documents, library, 16)
        whole = {r.sequence_id: r for r in packing.sequences(packed, 16, 7).collect()}
        for s, r in whole.items():
            own = sorted((p for p in rows if p.sequence_id == s), key=lambda p: p.offset)
            ids = np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist()
            assert r.length == len(ids)
            assert np.frombuffer(r.ids, "<u4").tolist() == ids + [7] * (16 - len(ids))
    assert packing.pack(odd_documents.limit(0), word_tokenizer()).count() == 0


def test_copies_of_one_bad_length(text_spark, library):
    text = "word " * 10
    docs = text_spark.createDataFrame([(i, text) for i in range(300)], "doc_id bigint, text string")
    check_pieces(
        packing.pack(docs.repartition(5), word_tokenizer(), size=20).collect(),
        [(i, text) for i in range(300)],
        library,
        20,
    )


def test_ids_are_those_of_the_library(library, monkeypatch):
    rng = random.Random(8)
    parts = list("aZs'9 .-_<|>~") + ["\n", "\t", "\x0b", "\x1c", "\x85", "'ll", "<|endoftext|>", "É", "the ", "WORD", "\x00"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(1500)] + [None, "", "a" * 3000, "'S'T"]
    for words in (400_000, 40):
        monkeypatch.setattr(packing.bpe, "WORDS", words)
        encoder = packing.LibraryEncoder(__import__("json").loads(word_tokenizer().raw))
        for first in range(0, len(texts), 100):
            part = texts[first : first + 100]
            for text, ids in zip(part, encoder.encode_batch(part)):
                want = library.encode(text or "", add_special_tokens=False).ids
                assert np.frombuffer(ids, "<u4").tolist() == want, text
