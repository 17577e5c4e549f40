"""Every registered query with SQL, against DuckDB on the smallest tables."""

import pytest

from cohortlens.checks.all import ORACLE, QUERIES
from tests.compare import database, difference
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def connection():
    return database(SMALL)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, connection, name):
    df = QUERIES[name](spark, SMALL)
    assert difference(df, connection, ORACLE[name], may_be_empty=True) is None
