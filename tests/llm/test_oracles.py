"""Queries of this package that SQL can state, against DuckDB, and that all are registered."""

import re

import pytest

import corpus_pipeline
from cohortlens.llm.queries import ORACLE, QUERIES
from tests.compare import difference
from tests.conftest import SMALL


def test_every_operator_has_a_query():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(text_spark, connection, name):
    assert difference(QUERIES[name](text_spark, SMALL), connection, ORACLE[name]) is None
