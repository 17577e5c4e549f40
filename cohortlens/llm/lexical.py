"""Ranked lexical search by scanning documents with an automaton of all item terms; there is no index.

The terms of all items go into one Aho-Corasick automaton, each guarded by a blank on both sides, and the
automaton is broadcast. A document is lower-cased, everything between terms becomes one blank, and a single
scan counts the item terms in it. The automaton's outputs are term numbers; postings map them to items. A
document's scores are added up in integers, and a task keeps the best documents of each item only.

Items are taken in blocks of bounded size (``BLOCK_BYTES`` of distinct terms per item), so that automaton,
postings and the score table of a task are bounded; each block is one scan. Only an item with more terms than
that is a block of its own. Counts of documents and terms cover all documents.

Defined results: a null text has no terms and is no document for the counts; a null item text has no terms
and gets no rows; benchmark rows with one id are one item with the terms of all; repeated documents are
ranked one by one; documents without a key come last among equal scores; texts may have any length; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cohortlens.llm.common import bounded_parts, map_rows, struct
from cohortlens.session import cut_lineage

BEST = 10
# Bytes of distinct terms, summed over the items of a block.
BLOCK_BYTES = 1 << 20
# Scores a task holds at once.
SCORES = 4 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_TABLE = bytes.maketrans(_UPPER.encode(), _LOWER.encode())
_TABLE = bytes(c if c in _KEEP else 32 for c in _TABLE)
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass
class Block:
    """Items, their terms, and for each term its items with how often they hold it."""

    items: list
    terms: list[str]
    starts: np.ndarray
    owner: np.ndarray
    times: np.ndarray

    def automaton(self) -> ahocorasick.Automaton:
        """One letter of the automaton is one byte of UTF-8."""
        found = ahocorasick.Automaton()
        for number, term in enumerate(self.terms):
            found.add_word(f" {term.encode().decode('latin-1')} ", number)
        if self.terms:
            found.make_automaton()
        return found


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """item, term, times: how often each item holds each of its terms."""
    lower = F.translate(F.col(text).cast("string"), _UPPER, _LOWER)
    terms = items.select(
        F.col(key).alias("item"), F.explode(F.regexp_extract_all(lower, F.lit(f"({_TERM})"))).alias("term")
    )
    return terms.groupBy("item", "term").agg(F.count("*").alias("times"))


def blocks(items: DataFrame, key: str, text: str, block_bytes: int) -> Iterator[Block]:
    rows = item_terms(items, key, text).withColumn("bytes", F.octet_length("term"))
    for part in bounded_parts(rows, ["item"], "bytes", block_bytes):
        names = list(dict.fromkeys(r["item"] for r in part))
        item = {name: i for i, name in enumerate(names)}
        terms = sorted({r.term for r in part})
        term = {t: i for i, t in enumerate(terms)}
        posted = sorted((term[r.term], item[r["item"]], r.times) for r in part)
        columns = np.array(posted, np.int64).reshape(len(posted), 3).T
        starts = np.searchsorted(columns[0], np.arange(len(terms) + 1))
        yield Block(names, terms, starts, columns[1], columns[2])


def scan(docs: DataFrame, block: Block, key: str, text: str) -> DataFrame:
    """Documents with at least one term: key, number of terms, item terms found and how often."""
    held = docs.sparkSession.sparkContext.broadcast(block.automaton())
    added = struct("n bigint, terms array<int>, counts array<int>")

    def make():
        automaton = held.value
        search = automaton.iter if len(automaton) else lambda _: ()

        def compute(batch):
            new = {"n": [], "terms": [], "counts": []}
            for value in batch.column("_text").to_pylist():
                raw = b" %b " % (value or "").encode("utf-8", "surrogatepass").translate(_TABLE)
                blank = np.frombuffer(raw, np.uint8) == 32
                new["n"].append(int(np.count_nonzero(blank[:-1] & ~blank[1:])))
                found = Counter(number for _, number in search(raw.decode("latin-1")))
                new["terms"].append(list(found.keys()))
                new["counts"].append(list(found.values()))
            return new

        return compute

    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    return map_rows(rows, make, added, ["_key"]).filter("n > 0")


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array(
        [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64
    )


class _Best:
    """The best documents of each item so far. Rows come in the order of their keys within a call."""

    def __init__(self, block: Block, weight: np.ndarray, documents: int, terms: int, best: int):
        self.block, self.weight, self.best = block, weight, best
        self.documents, self.terms = documents, terms
        self.kept: list[list[tuple]] = [[] for _ in block.items]
        self.least = np.ones(len(block.items), np.int64)

    def add(self, keys: list, lengths: list[int], terms: list[list[int]], counts: list[list[int]]) -> None:
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i]))
        m = np.array([25 + 75 * lengths[i] * self.documents // self.terms for i in order], np.int64)
        sizes = [len(terms[i]) for i in order]
        row = np.repeat(np.arange(len(order)), sizes)
        term = np.fromiter((t for i in order for t in terms[i]), np.int64, sum(sizes))
        tf = np.fromiter((c for i in order for c in counts[i]), np.int64, sum(sizes))
        value = self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
        by_term = np.argsort(term, kind="stable")
        term, row, value = term[by_term], row[by_term], value[by_term]
        edges = np.flatnonzero(np.diff(term, prepend=-1, append=-1))
        scores = np.zeros((len(self.block.items), len(order)), np.int64)
        for a, b in zip(edges, edges[1:]):
            posted = slice(self.block.starts[term[a]], self.block.starts[term[a] + 1])
            gain = self.block.times[posted][:, None] * value[a:b]
            scores[self.block.owner[posted][:, None], row[a:b]] += gain
        for item, own in enumerate(scores):
            at = np.flatnonzero(own >= self.least[item])
            if not len(at):
                continue
            at = at[np.argsort(-own[at], kind="stable")[: self.best]]
            new = [(-int(own[i]), keys[order[i]] is None, keys[order[i]]) for i in at]
            kept = sorted(self.kept[item] + new)[: self.best]
            self.kept[item] = kept
            if len(kept) == self.best:
                self.least[item] = max(1, -kept[-1][0])


def search(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    best: int = BEST,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``best`` documents of every item: item, rank, key, score."""
    out, documents, terms = None, 0, 0
    for block in blocks(items, item, item_text, block_bytes):
        hits = cut_lineage(scan(docs, block, key, text))
        if out is None:
            documents, terms = hits.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        found = _rank(hits, block, documents, terms, docs.schema[key], items.schema[item], best)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy(item).orderBy(F.desc("score"), F.col(key).asc_nulls_last())
    return (
        out.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= best)
        .select(item, "rank", key, "score")
    )


def _rank(
    hits: DataFrame, block: Block, documents: int, terms: int, key: T.StructField, item: T.StructField, best: int
) -> DataFrame:
    """Candidates of each task: at most ``best`` documents an item."""
    # One row per term of the block.
    rows = hits.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
    df = np.zeros(len(block.terms), np.int64)
    for r in rows:
        df[r.term] = r.df
    weight = weights(df, documents)
    chunk = max(1, SCORES // max(len(block.items), 1))
    schema = T.StructType([item, key, T.StructField("score", T.LongType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Best(block, weight, documents, terms, best)
        held: list[list] = [[], [], [], []]
        for batch in batches:
            for values, name in zip(held, ("_key", "n", "terms", "counts")):
                values += batch.column(name).to_pylist()
            if len(held[0]) >= chunk:
                state.add(*held)
                held = [[], [], [], []]
        if held[0]:
            state.add(*held)
        rows = [(block.items[i], k, -s) for i, kept in enumerate(state.kept) for s, _, k in kept]
        if rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return hits.mapInArrow(run, schema)


_SQL_TERMS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')"
SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS page, doc_id, {_SQL_TERMS} AS w FROM documents WHERE text IS NOT NULL
), sizes AS (
  SELECT page, doc_id, CAST(len(w) AS BIGINT) AS n FROM docs WHERE len(w) > 0
), whole AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes
), items AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL)
  GROUP BY item_id, term
), tf AS (
  SELECT page, term, count(*) AS tf FROM (SELECT page, unnest(w) AS term FROM docs)
  WHERE term IN (SELECT term FROM items) GROUP BY page, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, whole GROUP BY term
), scored AS (
  SELECT items.item_id, sizes.page, sizes.doc_id,
         CAST(sum(items.times * w.w * ((1000000000 * tf.tf) //
              (1000 * tf.tf + 8 * (25 + (75 * sizes.n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM tf JOIN w USING (term) JOIN items USING (term) JOIN sizes USING (page), whole
  GROUP BY items.item_id, sizes.page, sizes.doc_id
), ranked AS (
  SELECT item_id, doc_id, score,
         CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {BEST}
"""
