import os

import duckdb
import pytest

from cohortlens.llm.common import prepare
from tests.conftest import SMALL

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def text_spark(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def connection():
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(SMALL, name)}.parquet'")
    return found


@pytest.fixture(scope="session")
def odd_documents(text_spark):
    """Nulls in every column, empty and blank texts, repeated rows, and columns that clash with results."""
    line = "The same footer on every page."
    rows = [
        (1, f"First words of a page here.\n{line}", "en", "a", 10, "x", 0.5),
        (2, f"{line}\nOther words of another page.\n\n", "en", "a", 10, "x", 0.5),
        (3, f"Third words of a third page. \n {line} ", "en", "a", 10, "x", 0.5),
        (4, f"{line}", "en", "a", 10, None, None),
        (5, f"Fifth\n{line}\n{line}", "en", "a", 10, "x", 0.5),
        (6, f"Sixth\n{line}", None, "a", 10, "x", 0.5),
        (7, None, "en", "a", None, "x", 0.5),
        (8, "", "en", "b", 0, "x", 0.5),
        (9, " \n\t ", "en", "b", 4, "x", 0.5),
        (10, f"Tenth\n{line}", "en", None, 4, "x", 0.5),
        (None, f"No key here at all, only words.\n{line}", "en", "a", 4, "x", 0.5),
        (11, "word " * 3000 + "end\x1c of “text” <|endoftext|> Σίσυφοσ", "en", "b", 4, "x", 0.5),
        (12, "one two three four five six seven eight nine ten", "en", "b", 4, "x", 0.5),
        (12, "one two three four five six seven eight nine ten", "en", "b", 4, "x", 0.5),
        (13, "One two three four five SIX seven eight nine ten", "en", "c", 4, "x", 0.5),
        (14, "one two", "en", "c", 4, "x", 0.5),
        (15, "ONE  two", "en", "c", 4, "x", 0.5),
    ]
    schema = (
        "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, score double"
    )
    frame = text_spark.createDataFrame(rows, schema)
    for name in ("n_tokens", "_kept", "_bits", "class", "root", "shard", "size", "word", "value"):
        frame = frame.selectExpr("*", f"'clash' AS `{name}`")
    return frame
