import hashlib
import re

from cohortlens.llm import decontaminate
from cohortlens.llm.queries import QUERIES
from tests.conftest import SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, width=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        listed = sorted(str(x) for x in found if x is not None)
        digest = hashlib.sha256(",".join(listed).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(listed), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_query_against_brute_force(text_spark):
    docs = [tuple(r) for r in text_spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in text_spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op5_decontamination"](text_spark, SMALL).collect()]
    want = brute(docs, items)
    assert sorted(got, key=str) == want and any(r[5] for r in want)


ITEMS = [
    (1, "one two three four"),
    (1, "Seven, EIGHT; nine"),
    (10, "words words"),
    (2, None),
    (3, "..."),
    (None, "footer on every"),
    (4, "a b c d e f g h i j k l m n o"),
]


def test_odd_documents_in_one_and_several_passes(text_spark, odd_documents, monkeypatch):
    bench = text_spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = [(r.doc_id, r.text) for r in odd_documents.collect()]
    want = brute(docs, ITEMS)
    for size in (decontaminate.BLOCK_WINDOWS, 3):
        monkeypatch.setattr(decontaminate, "SLICE", min(size, 2))
        scanned = decontaminate.scan(odd_documents, bench, block_windows=size)
        assert sorted([tuple(r) for r in decontaminate.report(scanned).collect()], key=str) == want
        kept = decontaminate.drop_contaminated(scanned)
        assert kept.columns == odd_documents.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in want if not r[5])
    empty = decontaminate.scan(odd_documents, bench.limit(0))
    assert {r.n_hit for r in decontaminate.report(empty).collect()} == {0}
    assert decontaminate.report(decontaminate.scan(odd_documents.limit(0), bench)).count() == 0


def test_remove_spans(text_spark):
    bench = text_spark.createDataFrame([(1, "b c d")], "item_id bigint, text string")
    docs = text_spark.createDataFrame(
        [(1, "A, b -- C d! e"), (2, "b c x"), (3, None), (4, "b c d")], "doc_id bigint, text string"
    )
    out = decontaminate.remove_spans(decontaminate.scan(docs, bench))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "A, ! e", 2: "b c x", 3: None, 4: ""}


def test_blocks_are_bounded(text_spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE", 7)
    items = [(1, " ".join(f"w{i}" for i in range(100))), (2, "a b"), (3, "x " * 13), (3, "x " * 13), (4, None)]
    bench = text_spark.createDataFrame(items, "item_id bigint, text string")
    blocks = list(decontaminate._blocks(bench, "item_id", "text", 13, 20))
    assert len(blocks) >= 5
    got = set()
    for block in blocks:
        own = decontaminate.index_windows(block)
        assert sum(len(rows) for _, rows, *_ in own.by_length.values()) <= 20
        back = {i: w.decode() for w, i in own.vocabulary.items()}
        for _, rows, owners, _ in own.by_length.values():
            got |= {(o, tuple(back[i] for i in r.tolist())) for r, os in zip(rows, owners) for o in os}
    want = set()
    for item, text in items:
        w = words(text)
        want |= {(str(item), tuple(w[i : i + 13])) for i in range(max(1, len(w) - 12) if w else 0)}
    assert got == want


def test_batches_are_bounded_in_bytes(text_spark):
    """Ten texts of 10 MB: no batch holds more than two of them, and all are scanned whole."""
    docs = text_spark.range(0, 10, 1, 1).selectExpr("id AS doc_id", "concat(repeat('word ', 2000000), 'b c d') AS text")
    seen = docs.mapInArrow(
        lambda batches: (b.select(["doc_id"]).slice(0, 1) for b in batches if b.num_rows), "doc_id bigint"
    )
    assert seen.count() >= 5
    bench = text_spark.createDataFrame([(1, "b c d")], "item_id bigint, text string")
    rows = decontaminate.report(decontaminate.scan(docs, bench)).collect()
    assert [(r.n_words, r.n_hit) for r in rows] == [(2_000_003, 3)] * 10
