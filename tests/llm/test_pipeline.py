"""Every stage of the pipeline on what its predecessor kept, against the brute-force versions."""

import hashlib

import numpy as np
import tokenizers

import corpus_pipeline
from cohortlens.llm import line_dedup
from cohortlens.llm.queries import QUERIES, TOKENIZERS
from tests.conftest import SMALL
from tests.llm import test_decontaminate, test_line_dedup, test_near_dup


def test_stages(text_spark, tmp_path):
    docs = text_spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    tables = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(text_spark, docs, SMALL).write.parquet(str(tmp_path / str(i)))
        docs = text_spark.read.parquet(str(tmp_path / str(i)))
        assert i == 4 or docs.columns == columns
        tables.append(docs.collect())
    first, good, lines, single, clean, encoded = tables
    texts = [{r.doc_id: r.text for r in t} for t in tables[:5]]

    judged = QUERIES["op10_quality"](text_spark, SMALL).collect()
    assert set(texts[1]) == {r.doc_id for r in judged if r.predicted == 1} and len(good) < len(first)

    want = test_line_dedup.brute(
        [(r.text, r.source) for r in good], line_dedup.RATIO, line_dedup.MIN_PAGES
    )
    assert texts[2] == dict(zip([r.doc_id for r in good], want))
    assert all(r.n_chars == len(r.text) for r in lines)

    found = test_near_dup.brute([(r.doc_id, r.text) for r in lines])
    assert set(texts[3]) == {c for _, c in found.values()} and len(single) < len(lines)

    items = [tuple(r) for r in text_spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hits = test_decontaminate.brute([(r.doc_id, r.text) for r in single], items)
    assert set(texts[4]) == {h[0] for h in hits if not h[5]} and len(clean) < len(single)

    library = tokenizers.Tokenizer.from_file(str(TOKENIZERS / "word_bpe_49k.json"))
    assert {r.doc_id for r in encoded} == set(texts[4])
    for r in encoded:
        ids = library.encode(texts[4][r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_stages_take_odd_and_no_documents(text_spark, odd_documents):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(text_spark, odd_documents, SMALL)
        assert name == "bpe" or out.columns == odd_documents.columns
        out.collect()
        assert stage(text_spark, odd_documents.limit(0), SMALL).count() == 0
