"""Benchmark decontamination: a broadcast set of normalised benchmark word windows, scanned over documents.

Text is lower-cased in A-Z only; a word is a run of digits, a-z and characters beyond ASCII. Every run of
``width`` words of a benchmark item is a window; an item with fewer words, but not none, is one window. A
document word inside any occurrence of a window is hit.

Defined results: a null or empty text has no words, no hits and is never contaminated; a null benchmark
text has no windows; several benchmark rows with one id are one item; a benchmark row without an id marks
words but counts as no item; texts may have any length; repeated document rows are judged one by one; an empty benchmark hits nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import bounded_parts, fresh, map_rows, struct
from cohortlens.session import cut_lineage

WIDTH = 13
# One broadcast holds so many windows; a larger benchmark is scanned in several passes, so no broadcast grows
# with the tables. Long items are cut into slices of so many windows first.
BLOCK_WINDOWS = 200_000
SLICE = 5_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_TABLE = bytes.maketrans(_UPPER.encode(), _UPPER.lower().encode())
_TABLE = bytes(c if c in _KEEP else 32 for c in _TABLE)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def words(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Windows:
    """Windows of one benchmark block, by length: sorted hashes, word ids and the items each occurs in."""

    vocabulary: dict[bytes, int]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[str, ...]], np.ndarray]]


def _hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` ids; runs are numbered by their first id."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total *= _FACTOR
        total += ids[k : k + n]
    total ^= total >> np.uint64(31)
    total *= _FACTOR
    return total


def index_windows(items: list[tuple[str | None, str | None]], width: int = WIDTH) -> Windows:
    """The windows of benchmark items, ready to be broadcast."""
    vocabulary: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
        length = min(width, len(ids))
        for i in range(len(ids) - length + 1 if length else 0):
            held = owners.setdefault(tuple(ids[i : i + length]), set())
            if item is not None:
                held.add(item)
    by_length = {}
    for length in sorted({len(w) for w in owners}):
        keys = [w for w in owners if len(w) == length]
        rows = np.array(keys, np.uint64).reshape(len(keys), length)
        hashes = _hashes(rows.ravel(), length)[::length] if len(keys) else np.empty(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        seen = np.zeros(1 << _BITS, bool)
        seen[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        by_length[length] = (
            hashes[order],
            rows[order],
            [tuple(sorted(owners[keys[i]])) for i in order],
            seen,
        )
    return Windows(vocabulary, by_length)


def find(windows: Windows, ids: np.ndarray) -> list[tuple[int, int, tuple[str, ...]]]:
    """(first word, length, items) of each window occurrence; hash hits are verified word by word.

    Id 0 stands for a word outside the benchmark and for the gap between documents.
    """
    found = []
    inside = np.concatenate(([0], np.cumsum(ids == 0)))
    for length, (hashes, rows, owners, seen) in windows.by_length.items():
        if len(ids) < length:
            continue
        full = np.flatnonzero(inside[length:] == inside[:-length])
        if not len(full):
            continue
        h = _hashes(ids, length)[full]
        likely = seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)]
        at, h = full[likely], h[likely]
        left = np.searchsorted(hashes, h, "left")
        right = np.searchsorted(hashes, h, "right")
        for i, lo, hi in zip(at.tolist(), left.tolist(), right.tolist()):
            for row in range(lo, hi):
                if np.array_equal(rows[row], ids[i : i + length]):
                    found.append((i, length, owners[row]))
    return found


def _scan(
    docs: DataFrame, windows: Windows, names: list[str], keep: list[str], text: str, first: bool
) -> DataFrame:
    """One pass over the documents with one block of windows; hit words are kept as packed bits."""
    words_column, hit_column, bits_column, items_column = names
    added = struct(
        f"`{words_column}` bigint, `{hit_column}` bigint, `{bits_column}` binary, "
        f"`{items_column}` array<string>"
    )

    def make():
        get = windows.vocabulary.get

        def compute(batch):
            tokens = [words(t) for t in batch.column(text).to_pylist()]
            sizes = np.array([len(t) for t in tokens], np.int64)
            starts = np.concatenate(([0], np.cumsum(sizes + 1)))
            flat = np.zeros(int(starts[-1]), np.uint64)
            for t, s in zip(tokens, starts.tolist()):
                flat[s : s + len(t)] = np.fromiter((get(w, 0) for w in t), np.uint64, len(t))
            change = np.zeros(len(flat) + 1, np.int64)
            items: list[set] = [set() for _ in tokens]
            for at, length, owners in find(windows, flat):
                change[at] += 1
                change[at + length] -= 1
                items[int(np.searchsorted(starts, at, "right")) - 1].update(owners)
            marked = np.cumsum(change)[:-1] > 0
            earlier = [None] * len(tokens) if first else batch.column(bits_column).to_pylist()
            known = [()] * len(tokens) if first else batch.column(items_column).to_pylist()
            bits = []
            for s, n, old in zip(starts.tolist(), sizes.tolist(), earlier):
                own = np.packbits(marked[s : s + n])
                bits.append((own | np.frombuffer(old, np.uint8) if old else own).tobytes())
            return {
                words_column: sizes,
                hit_column: [int.from_bytes(b).bit_count() for b in bits],
                bits_column: bits,
                items_column: [sorted(i.union(k)) for i, k in zip(items, known)],
            }

        return compute

    return map_rows(docs, make, added, keep)


def _slices(benchmark: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """(i, t, windows): items cut into runs of words with at most ``SLICE`` windows, each run once."""
    lower = F.translate(F.col(text).cast("string"), _UPPER, _UPPER.lower())
    rows = benchmark.select(
        F.col(item).cast("string").alias("i"), F.regexp_extract_all(lower, F.lit(f"({_WORD})")).alias("w")
    ).filter(F.size("w") > 0)
    windows = F.greatest(F.size("w") - width + 1, F.lit(1))
    rows = rows.select("i", "w", F.explode(F.sequence(F.lit(0), windows - 1, F.lit(SLICE))).alias("at"))
    n = F.least(F.lit(SLICE), windows - F.col("at"))
    words_ = F.slice("w", F.col("at") + 1, n + width - 1)
    return rows.select("i", F.array_join(words_, " ").alias("t"), n.alias("windows")).distinct()


def _blocks(benchmark: DataFrame, item: str, text: str, width: int, block_windows: int):
    """Lists of (item, text) with at most ``block_windows`` windows."""
    rows = _slices(benchmark, item, text, width)
    for part in bounded_parts(rows, ["i", "t"], "windows", block_windows):
        yield [(r.i, r.t) for r in part]


@dataclass
class Scanned:
    """Documents with four working columns, whose names clash with none of theirs."""

    frame: DataFrame
    columns: list[str]
    text: str
    n_words: str
    n_hit: str
    bits: str
    items: str

    @property
    def contaminated(self) -> Column:
        return (F.col(self.n_hit) > 0) & (F.col(self.n_hit) * 20 >= F.col(self.n_words))


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    benchmark_text: str = "text",
    width: int = WIDTH,
    block_windows: int = BLOCK_WINDOWS,
) -> Scanned:
    """Mark the words of every document that lie inside a benchmark window."""
    names = [fresh(docs, n) for n in ("_n_words", "_n_hit", "_bits", "_items")]
    out, first = docs, True
    for block in _blocks(benchmark, item, benchmark_text, width, block_windows):
        if not first:
            out = cut_lineage(out)
        out = _scan(out, index_windows(block, width), names, docs.columns, text, first)
        first = False
    return Scanned(out, docs.columns, text, *names)


def report(scanned: Scanned, key: str = "doc_id") -> DataFrame:
    """Counts and the verdict of each scanned document."""
    return scanned.frame.select(
        key,
        F.col(scanned.n_words).alias("n_words"),
        F.col(scanned.n_hit).alias("n_hit"),
        F.size(scanned.items).cast("long").alias("n_items"),
        F.sha2(F.array_join(scanned.items, ","), 256).alias("items_sha256"),
        scanned.contaminated.alias("contaminated"),
    )


def drop_contaminated(scanned: Scanned) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return scanned.frame.filter(~scanned.contaminated).select(*scanned.columns)


def remove_spans(scanned: Scanned) -> DataFrame:
    """All documents; each run of hit words is cut out of the text, from its first to its last character."""
    text, bits = scanned.text, scanned.bits
    out = fresh(scanned.frame, "_clean")

    def clean(value: str | None, packed: bytes) -> str | None:
        if value is None or not any(packed):
            return value
        raw = value.encode("utf-8", "surrogatepass")
        inside = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
        edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        first, last = edge[::2], edge[1::2]
        hit = np.unpackbits(np.frombuffer(packed, np.uint8))[: len(first)]
        run = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
        kept, at = [], 0
        for a, b in zip(run[::2], run[1::2]):
            kept.append(raw[at : first[a]])
            at = int(last[b - 1])
        return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")

    def make():
        def compute(batch):
            pairs = zip(batch.column(text).to_pylist(), batch.column(bits).to_pylist())
            return {out: [clean(t, b) for t, b in pairs]}

        return compute

    done = map_rows(scanned.frame, make, struct(f"`{out}` string"), scanned.columns)
    return done.select(*[F.col(out).alias(c) if c == text else F.col(c) for c in scanned.columns])


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS page, doc_id, {_WORDS} AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), {WIDTH}) AS size
  FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, size, list_slice(w, pos, pos + size - 1) AS win
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS pos FROM items)
), found AS (
  SELECT d.page, d.pos, d.size, win.item
  FROM (SELECT page, size, pos, list_slice(w, pos, pos + size - 1) AS win FROM (
          SELECT page, w, size, unnest(range(1, len(w) - size + 2)) AS pos
          FROM docs, (SELECT DISTINCT size FROM items) WHERE len(w) >= size)) d
  JOIN windows win ON win.win = d.win AND win.size = d.size
), hits AS (
  SELECT page, count(DISTINCT spot) AS n FROM (SELECT page, unnest(range(pos, pos + size)) AS spot FROM found)
  GROUP BY page
), named AS (
  SELECT page, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT page, item FROM found WHERE item IS NOT NULL) GROUP BY page
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (page) LEFT JOIN named USING (page)
"""
