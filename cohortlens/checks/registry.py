"""Registration of queries and of the SQL they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.session import apply_settings
from cohortlens.sources.readers import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
PARTS: dict[str, str] = {}


def part(name: str, text: str) -> None:
    """A named subquery that checks may refer to."""
    PARTS[name] = text.strip()


def with_parts(body: str) -> str:
    """Prefix ``body`` with the subqueries it needs, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name, definition in PARTS.items():
            if name not in ordered and re.search(rf"\b{name}\b", text) and definition != text:
                visit(definition)
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body.strip()
    parts = ",\n".join(f"{n} AS MATERIALIZED (\n{PARTS[n]}\n)" for n in ordered)
    main = body.strip()
    if main.startswith("WITH "):
        main = f"SELECT * FROM (\n{main}\n)"
    return f"WITH {parts}\n{main}"


def check(name: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under ``name``, with the SQL it must agree with."""

    def register(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, root: str) -> DataFrame:
            return f(Tables(apply_settings(spark), root))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_parts(sql)
        return f

    return register
