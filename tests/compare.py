"""Run registered queries beside their SQL: python -m tests.compare [sf] [names...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from cohortlens.checks.all import ORACLE, QUERIES  # noqa: E402
from cohortlens.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem".split()


def database(root: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return connection


def _sort_key(row: tuple):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b and (a is None) == (b is None)


def difference(df, connection, sql: str, may_be_empty: bool = False) -> str | None:
    """None when both results hold the same rows, else the first difference."""
    names = sorted(df.columns)
    mine = [tuple(r[c] for c in names) for r in df.collect()]
    cursor = connection.execute(sql)
    found = [d[0] for d in cursor.description]
    if sorted(found) != names:
        return f"columns {names} != {sorted(found)}"
    at = [found.index(c) for c in names]
    theirs = [tuple(r[i] for i in at) for r in cursor.fetchall()]
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    if not mine and not may_be_empty:
        return "no rows"
    mine.sort(key=_sort_key)
    theirs.sort(key=_sort_key)
    for a, b in zip(mine, theirs):
        for n, x, y in zip(names, a, b):
            if type(x) is not type(y) or not _same(x, y):
                return f"{n}: {x!r} != {y!r} in {dict(zip(names, a))} / {dict(zip(names, b))}"
    return None


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    root = f"/root/testdata/sf{sf}"
    spark, connection = local_session(8), database(root)
    bad = 0
    for name in names:
        started = time.time()
        try:
            df = QUERIES[name](spark, root)
            if name in ORACLE:
                problem = difference(df, connection, ORACLE[name])
                state = "ok" if problem is None else f"DIFF {problem}"
            else:
                got = df.collect()
                state = f"rows {len(got)} {got[:2] if len(str(got[:2])) < 700 else ''}"
                problem = None if got else "empty"
        except Exception as error:  # noqa: BLE001
            problem = state = f"ERROR {type(error).__name__} {str(error)[:1500]}"
        bad += problem is not None
        print(f"{name:24s} {time.time() - started:6.1f}s {state}", flush=True)
    print("failed:", bad, "of", len(names))


if __name__ == "__main__":
    main()
