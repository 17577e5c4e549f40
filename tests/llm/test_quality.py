import zlib

import numpy as np

from cohortlens.llm import quality
from cohortlens.llm.queries import QUERIES
from tests.conftest import SMALL


def test_held_out_accuracy(text_spark):
    got = {r.doc_id: r for r in QUERIES["op10_quality"](text_spark, SMALL).collect()}
    labels = {r.doc_id: r.quality for r in text_spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [(got[i].predicted, y) for i, y in labels.items() if i in got and got[i].held_out]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)


def test_odd_documents_and_labels(text_spark, odd_documents):
    labels = text_spark.createDataFrame(
        [(1, 1), (2, 1), (2, 1), (12, 0), (13, 0), (99, 1), (None, 1), (3, None)], "doc_id bigint, quality int"
    )
    out = quality.report(odd_documents, labels).collect()
    assert len(out) == odd_documents.count() and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[7] == by[8] == by[9]
    assert {r.held_out for r in out if r.doc_id is None} == {False}
    kept = quality.drop_rejected(odd_documents, labels)
    assert kept.columns == odd_documents.columns
    again = {r.doc_id: r.score for r in quality.report(odd_documents, labels).collect()}
    assert again == by


def test_without_labels(text_spark, odd_documents):
    none = text_spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality.report(odd_documents, none).collect()} == {0.5}
    one = text_spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, quality int")
    assert all(r.score > 0.7 for r in quality.report(odd_documents, one).collect())
    assert quality.report(odd_documents.limit(0), one).count() == 0


def test_scores_do_not_depend_on_the_sampled_mix(text_spark):
    assert quality.mix_shift({0: 10, 1: 90}, 100) == 0 == quality.mix_shift({1: 500}, 20)
    assert abs(quality.mix_shift({0: 30, 1: 3000}, 20) - np.log(100)) < 1e-9
    # Words say nothing about the label here, so a score is the share of label 1.
    rows = [(i, f"word number {i % 7}", int(i % 10 > 0)) for i in range(1500)]
    docs = text_spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    whole, part = (quality.train(docs, docs, size=n) for n in (2000, 100))
    for model in (whole, part):
        scored, column = quality.score(docs, model)
        assert abs(scored.selectExpr(f"avg({column})").first()[0] - 0.9) < 0.06
