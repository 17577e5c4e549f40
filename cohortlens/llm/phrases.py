"""Phrase mining after Toivonen: a sample proposes, full passes count the proposals and their negative border.

A phrase is a run of words inside a piece of text, counted within its language, overlaps included. Each part
of a frequent phrase is frequent. So:

1. a hash sample of the documents is mined with a lowered threshold; what it finds frequent is proposed;
2. a full pass counts all phrases whose first and whose last words (all but one) are proposed, by 64-bit hash.
   These are the proposals and their negative border: the phrases of which every part is proposed, but not
   they. What stays below the threshold by hash is infrequent for certain, as a shared hash only adds;
3. a phrase of the border that turns out frequent is a border failure: the sample missed it, and longer
   phrases over it were not counted. A second full pass counts by the words themselves, exactly, what may be
   frequent and, if there are failures, expands them: every phrase over a failure that the first pass left out
   is counted in all lengths at once, whether or not its parts are proposed. So the result is closed then: a
   frequent phrase has frequent parts, and by induction over its length it is counted in one of the passes.

Proposals are broadcast as a bit table of hashes, whose size is bounded (``MOST_BITS``); a chance hit there
only adds phrases to those counted. Phrases are counted per batch, then map-side, then shuffled by hash or by
(language, phrase), so no frequent word or large language is one group.

Defined results: a null text is empty; a null language is ``und``; words and pieces may have any length;
repeated rows count as often as they occur; an empty table gives an empty result; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import struct
from cohortlens.session import cut_lineage

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
# One document in so many is in the sample. Its threshold is a third of the share of the full one, as a
# phrase may be rarer there by chance.
SAMPLE = 8
LOWERED = 3
# Bits of the broadcast table per proposal, and the limits of its size (2^28 bits are 32 MB).
BITS_EACH = 16
LEAST_BITS, MOST_BITS = 16, 28
# Text that is counted together, in bytes: a worker needs about a hundred times that. Longer texts are cut at
# the end of a piece. Phrases are handed on so many at a time.
BATCH_BYTES = 2 << 20
BATCH_PHRASES = 50_000

_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
# All ends of pieces become a full stop, which then stands for itself as a word.
_TABLE = bytes.maketrans(_UPPER + b",;:!?\n\x0b\x0c\r", _LOWER + b"." * 9)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_HASHED = "hash bigint, size int, n bigint"
_COUNTED = "lang string, size int, phrase string, n bigint"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Proposals:
    """A bit table of phrase hashes, by the leading bits of a hash."""

    words: np.ndarray
    bits: int

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) > 0


def bit_table(hashes: DataFrame, bits: int) -> Proposals:
    """The table of all values of the column ``hash``; the driver gets at most 2^bits / 64 words."""
    at = hashes.select(F.shiftrightunsigned("hash", 64 - bits).alias("at"))
    found = (
        at.groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        .toArrow()
    )
    words = np.zeros(1 << (bits - 6), np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return Proposals(words.view(np.uint64), bits)


def bits_for(proposals: int) -> int:
    return min(max((BITS_EACH * max(proposals, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)


# -- counting in one batch


@dataclass
class _Grams:
    """Phrases of one length in a batch: at each word the number of the phrase that starts there, or -1."""

    at: np.ndarray
    hashes: np.ndarray
    where: np.ndarray
    counts: np.ndarray
    # Counted in the first pass already; else only the expansion of a border failure reaches it.
    old: np.ndarray


@dataclass
class _Batch:
    """Words of a batch of texts, with a full stop after every piece and text."""

    names: list[bytes]
    word: np.ndarray
    kinds: list[bytes]
    lang: np.ndarray

    def phrases(self, where: np.ndarray, length: int) -> list[bytes]:
        columns = [[self.names[i] for i in self.word[where + k].tolist()] for k in range(length)]
        return columns[0] if length == 1 else list(map(b" ".join, zip(*columns)))


def _number(keys: np.ndarray, at: np.ndarray, n: int, hashed) -> _Grams:
    """Number the distinct ``keys``, found at the words ``at`` of ``n``."""
    distinct, first, inverse, counts = np.unique(
        keys, return_index=True, return_inverse=True, return_counts=True
    )
    full = np.full(n, -1, np.int64)
    full[at] = inverse
    return _Grams(full, hashed(distinct), at[first], counts, np.ones(len(distinct), bool))


def read_batch(langs: list[bytes], texts: list[bytes]) -> _Batch:
    lists = [t.replace(b".", b" . ").split() for t in texts]
    words = list(itertools.chain.from_iterable(itertools.chain(t, (b".",)) for t in lists))
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    word = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    kinds = {k: i for i, k in enumerate(dict.fromkeys(langs))}
    sizes = [len(t) + 1 for t in lists]
    lang = np.repeat(np.array([kinds[k] for k in langs], np.int64), sizes)
    return _Batch(list(number), word, list(kinds), lang)


def count_batch(
    batch: _Batch, longest: int, proposals: Proposals | None = None, missed: Proposals | None = None
) -> Iterator[tuple[int, _Grams]]:
    """The phrases of a batch by length.

    Without ``proposals`` all phrases are counted, else those with proposed parts, and with ``missed`` also
    all that are made of proposed, missed and such further parts.
    """
    word, names = batch.word, batch.names
    hashed = np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64)
    lang_hash = np.array([xxhash.xxh64_intdigest(k, 1) for k in batch.kinds], np.uint64)
    many = np.int64(max(len(names), 1))
    stop = names.index(b".") if names else -1
    at = np.flatnonzero(word != stop)
    grams = _number(
        batch.lang[at] * many + word[at],
        at,
        len(word),
        lambda k: _mix(lang_hash[k // many] * _ODD + hashed[k % many]),
    )
    yield 1, grams
    none = np.zeros(1, bool)  # number -1: no phrase here
    for length in range(2, longest + 1):
        every = np.ones(len(grams.counts), bool)
        known = grams.old & (every if proposals is None else proposals.holds(grams.hashes))
        part = known if missed is None else known | ~grams.old | missed.holds(grams.hashes)
        likely = np.concatenate((part, none))[grams.at]
        at = np.flatnonzero(likely[:-1] & likely[1:])
        shorter = grams
        grams = _number(
            shorter.at[at] * many + word[at + length - 1],
            at,
            len(word),
            lambda k: _mix(shorter.hashes[k // many] * _ODD + hashed[k % many]),
        )
        if missed is not None:
            known = np.concatenate((known, none))[shorter.at]
            grams.old = known[grams.where] & known[grams.where + 1]
        yield length, grams


def _slices(text: bytes) -> Iterator[bytes]:
    """A text in parts of about the bytes of a batch, cut where a piece ends."""
    start = 0
    while len(text) - start > BATCH_BYTES and (end := text.find(b".", start + BATCH_BYTES)) >= 0:
        yield text[start:end]
        start = end
    yield text[start:]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Languages and lower-case texts of about the bytes of a batch."""
    langs: list[bytes] = []
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        rows = (batch.column(i).cast(pa.binary()).to_pylist() for i in range(2))
        for lang, text in zip(*rows):
            for part in _slices((text or b"").translate(_TABLE)):
                langs.append(lang)
                texts.append(part)
                held += len(part)
                if held >= BATCH_BYTES:
                    yield langs, texts
                    langs, texts, held = [], [], 0
    if texts:
        yield langs, texts


def _hashes(docs: DataFrame, longest: int, proposals=None) -> DataFrame:
    """(hash, size, n) of proposals and border, or of all phrases, by batch."""
    names = [f.name for f in struct(_HASHED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = proposals and proposals.value
        for langs, texts in _batches(batches):
            for length, grams in count_batch(read_batch(langs, texts), longest, table):
                size = np.full(len(grams.counts), length, np.int32)
                columns = [grams.hashes.view(np.int64), size, grams.counts]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return docs.mapInArrow(run, struct(_HASHED))


def _counts(docs: DataFrame, longest: int, proposals, likely, missed=None) -> DataFrame:
    """(lang, size, phrase, n) by batch of what is likely frequent and of all expansions; as size 0, the words."""
    names = [f.name for f in struct(_COUNTED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = proposals.value, missed and missed.value
        for langs, texts in _batches(batches):
            batch = read_batch(langs, texts)
            kinds = batch.kinds
            for length, grams in count_batch(batch, longest, *tables):
                if length == 1:
                    total = np.bincount(batch.lang[grams.at >= 0], minlength=len(kinds))
                    yield _rows([kinds, [0] * len(kinds), [b""] * len(kinds), total], names)
                every = np.flatnonzero(~grams.old | likely.value.holds(grams.hashes))
                for first in range(0, len(every), BATCH_PHRASES):
                    which = every[first : first + BATCH_PHRASES]
                    where = grams.where[which]
                    yield _rows(
                        [
                            [kinds[i] for i in batch.lang[where].tolist()],
                            np.full(len(which), length),
                            batch.phrases(where, length),
                            grams.counts[which],
                        ],
                        names,
                    )

    return docs.mapInArrow(run, struct(_COUNTED))


def _rows(values: list, names: list[str]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int32(), pa.binary(), pa.int64()]
    arrays = [pa.array(v, kind) for v, kind in zip(values, kinds)]
    return pa.RecordBatch.from_arrays([a.cast(pa.string()) if a.type == pa.binary() else a for a in arrays], names)


# -- passes


def frequent(
    docs: DataFrame,
    key: str | None = "doc_id",
    text: str = "text",
    lang: str = "lang",
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    sample: int = SAMPLE,
) -> tuple[DataFrame, int]:
    """Exact counts of all frequent phrases of 1 to ``max_words`` words, and the number of border failures.

    Columns lang, size, phrase, n; a row of size 0 per language holds the number of its words. ``key`` only
    makes the sample take copies of one text independently.
    """
    share = docs.sparkSession.sparkContext.broadcast
    columns = [
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.col(text).cast("string").alias("text"),
    ]
    rows = docs.select(*columns)
    chosen = F.pmod(F.xxhash64(*([key] if key else []), text), F.lit(sample)) == 0

    def by_hash(counted: DataFrame, least: int) -> DataFrame:
        """The hashes with a sufficient count, of phrases of any length."""
        total = counted.groupBy("hash", "size").agg(F.sum("n").alias("n"))
        return cut_lineage(total.filter(F.col("n") >= least).select("hash", "size"))

    least = max(2, min_count // (sample * LOWERED))
    proposed = by_hash(_hashes(docs.filter(chosen).select(*columns), max_words - 1), least)
    table = bit_table(proposed, bits_for(proposed.count()))
    proposals = share(table)
    likely = by_hash(_hashes(rows, max_words, proposals), min_count)
    likely_table = bit_table(likely, bits_for(4 * likely.count()))
    # Hashes that are not among the proposals; a chance hit counts as proposed, as it did in the pass.
    missed = cut_lineage(_unheld(likely.filter(F.col("size") < max_words), proposals))
    failures = missed.count()
    expand = share(bit_table(missed, bits_for(failures))) if failures else None
    exact = _counts(rows, max_words, proposals, share(likely_table), expand)
    found = exact.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    found = cut_lineage(found.filter((F.col("n") >= min_count) | (F.col("size") == 0)))
    return found, failures


def _unheld(hashes: DataFrame, table) -> DataFrame:
    """The hashes that the broadcast table does not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("hash").to_numpy()
            left = own[~table.value.holds(own.view(np.uint64))]
            yield pa.RecordBatch.from_arrays([pa.array(left)], ["hash"])

    return hashes.select("hash").mapInArrow(run, "hash bigint")


# -- scores


def _part(start, length):
    return F.array_join(F.slice("words", start, length), " ")


def collocations(
    counts: DataFrame, top: int = TOP, absorbed: int = 100
) -> DataFrame:
    """The best phrases of each language from the counts of frequent phrases.

    A phrase is scored by its weakest cut, floor(1000 a n / (l r)), in decimals of 37 digits: counts are
    exact up to 10^15 occurrences of a phrase and 10^18 words. A phrase inside a longer candidate with
    ``absorbed`` per cent of its count or more is dropped; as counts only fall with length, candidates
    longer by one word tell.
    """
    # Ranks are cut before the shuffle, so a language is not one group.
    counts.sparkSession.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(max(top, 1000)))
    grams = counts.filter("size > 0").select("lang", "phrase", "n")
    totals = counts.filter("size = 0").select("lang", F.col("n").alias("words_n"))
    candidates = counts.filter("size > 1").select(
        "lang", "phrase", F.col("n").alias("a"), "size", F.split("phrase", " ", -1).alias("words")
    )
    cuts = candidates.select(
        "lang", "phrase", "a", "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    ).select(
        "lang",
        "phrase",
        "a",
        "k",
        _part(F.lit(1), F.col("k")).alias("head"),
        _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"),
    )
    heads = grams.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    rests = grams.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    score = F.expr(
        "cast(1000 * a as decimal(18, 0)) * cast(words_n as decimal(18, 0)) div "
        "(cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))"
    )
    weakest = (
        cuts.join(heads, ["lang", "head"])
        .join(rests, ["lang", "rest"])
        # One row per language.
        .join(totals, "lang")
        .groupBy("lang", "phrase", "a", "words_n")
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    )
    longer = (
        candidates.filter("size > 2")
        .select(
            "lang",
            "a",
            F.explode(
                F.array_distinct(
                    F.array(
                        _part(F.lit(1), F.col("size") - 1),
                        _part(F.lit(2), F.col("size") - 1),
                    )
                )
            ).alias("phrase"),
        )
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    kept = weakest.join(longer, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        kept.select(
            "lang",
            "phrase",
            "a",
            F.col("cut.l").alias("l"),
            F.col("cut.r").alias("r"),
            F.col("words_n").alias("n"),
            F.col("cut.score").alias("score"),
        )
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )


SQL = f"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), '{_UPPER.decode()}', '{_LOWER.decode()}') AS t FROM documents
), pieces AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts
), runs AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS phrase FROM (
    SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS pos
    FROM runs, (SELECT unnest(range(1, {MAX_WORDS + 1})) AS size) WHERE len(w) >= size)
), f AS (
  SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY lang, size, phrase
), totals AS (
  SELECT lang, CAST(sum(n) AS HUGEINT) AS n FROM f WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= {MIN_COUNT}
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS head,
         array_to_string(list_slice(w, k + 1, size), ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.n AS l, r.n AS r, t.n AS n,
         (CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(h.n AS HUGEINT) * r.n) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head
  JOIN f r ON r.lang = c.lang AND r.phrase = c.rest JOIN totals t ON t.lang = c.lang
), weakest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored)
  WHERE place = 1
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, unnest([array_to_string(list_slice(w, 1, size - 1), ' '),
                            array_to_string(list_slice(w, 2, size), ' ')]) AS phrase
    FROM candidates WHERE size > 2) GROUP BY lang, phrase
), ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, w.phrase) AS rank
  FROM weakest w LEFT JOIN longer ON longer.lang = w.lang AND longer.phrase = w.phrase
  WHERE longer.a IS NULL OR longer.a < w.a
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= {TOP}
"""
