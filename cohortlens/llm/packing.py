"""Packing token ids into sequences by shortest-pack-first over the histogram of lengths.

A document is its ids and one end id. What fills whole sequences is cut off from its front; the rest, shorter
than a sequence, is what has to be packed. Only the histogram of these lengths is packed, so this step costs
the same for any number of documents: lengths are placed longest first, each into the shortest open pack, all
packs with one pattern at once; a pattern is a list of lengths with a count. Patterns are then joined back to
documents by rank: the k-th piece of a length goes where the patterns put the k-th item of that length.

Lengths that fit badly (a third of all documents just above half a sequence, say) would leave much padding.
So the emptiest packs are dissolved and their pieces cut into the gaps of the others, largest gaps first; a
dissolved pack saves one whole sequence of padding. With ``padding`` 0 at most one sequence is left unfilled.

Ranks are counted where the ids are made (per input split and length) and written with them; the splits'
starts are sums over splits. So ids are made once, and no group holds all pieces of one length.

Defined results: a null or empty text is the end id alone; repeated rows and keys are packed one by one;
texts may have any length; an empty table gives an empty result; other columns, whatever their names, stay
out of the result.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm import bpe
from cohortlens.llm.common import arrow_array, map_rows, struct
from cohortlens.session import cut_lineage

SIZE = 2048
END_ID = 1
# Words given to the library in one call.
WORDS_A_CALL = 20_000
# The tokenizer's split for ASCII alone, and what needs the general way: how added tokens begin, control characters.
ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
ADDED = "<|"
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")


# -- ids


class LibraryEncoder(bpe.Encoder):
    """Ids as the library gives them; words new to the cache are merged by the library itself."""

    def __init__(self, spec: dict):
        super().__init__(spec)
        plain = {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.merger = tokenizers.Tokenizer.from_str(json.dumps(spec | plain | {"post_processor": None}))
        self.width = _width(spec)

        # Finished chunks of an earlier generation, and ids of words: more caches of bounded size.
        self.older: dict[str, bytes] = {}
        self.merged_words: dict[str, bytes] = {}

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known = self.merged_words
        if len(known) + len(words) > 2 * bpe.WORDS:
            known.clear()
        new = [w for w in words if w not in known]
        for i in range(0, len(new), WORDS_A_CALL):
            part = new[i : i + WORDS_A_CALL]
            found = self.merger.encode(" ".join(part), add_special_tokens=False)
            data = np.array(found.ids, "<u4").tobytes()
            ends = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(1, len(part) + 1)) * 4
            known.update((w, data[a:b]) for w, a, b in zip(part, [0, *ends.tolist()], ends.tolist()))
        found = list(map(known.__getitem__, words))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), "<u4").astype(np.int64), sizes

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        Plain ASCII needs no normal form, so it is split into words at once; other texts are looked up by
        chunks between white space.
        """
        rows: list[list[bytes | None]] = []
        words: set[str] = set()
        word_gaps: list[tuple[list, int, str]] = []
        # Chunks that are not in the cache: where they belong.
        gaps: list[tuple[list, int, str]] = []
        new: set[str] = set()

        def learn() -> None:
            if len(self.words) + len(new) > bpe.WORDS:
                self.older, self.words = self.words, {}
            self._learn(new)
            for found, i, chunk in gaps:
                found[i] = self.words[chunk]
            gaps.clear()
            new.clear()
            self.encode_words(list(words))
            for found, i, word in word_gaps:
                found[i] = self.merged_words[word]
            word_gaps.clear()
            words.clear()

        for text in texts:
            row: list[bytes | None] = []
            if text and text.isascii() and ADDED not in text and not CONTROL.search(text):
                pieces = ASCII_SPLIT.findall(text.lower())
                row = list(map(self.merged_words.get, pieces))
                try:
                    # Fails at the first word that is not known.
                    rows.append([b"".join(row)])
                    continue
                except TypeError:
                    pass
                at = -1
                for _ in range(row.count(None)):
                    at = row.index(None, at + 1)
                    word_gaps.append((row, at, pieces[at]))
                    words.add(pieces[at])
                rows.append(row)
                if len(words) > bpe.WORDS // 8:
                    learn()
                continue
            for part in self._parts(text):
                if not isinstance(part, list):
                    row.append(part)
                    continue
                found = list(map(self.words.get, part))
                at = -1
                for _ in range(found.count(None)):
                    at = found.index(None, at + 1)
                    chunk = part[at]
                    if (old := self.older.get(chunk)) is not None:
                        found[at] = self.words[chunk] = old
                    else:
                        gaps.append((row, len(row) + at, chunk))
                        new.add(chunk)
                row += found
            rows.append(row)
            if len(new) > bpe.WORDS // 8:
                learn()
        learn()
        return list(map(b"".join, rows))


_LOADED: dict[bytes, LibraryEncoder] = {}


def _encoder(tokenizer: bpe.Tokenizer) -> LibraryEncoder:
    if tokenizer.raw not in _LOADED:
        _LOADED[tokenizer.raw] = LibraryEncoder(json.loads(tokenizer.raw))
    return _LOADED[tokenizer.raw]


def _pieces(
    docs: DataFrame, tokenizer: bpe.Tokenizer, key: str, text: str, size: int, end_id: int, all_ids: bool
) -> DataFrame:
    """Pieces of at most ``size`` ids, numbered per split and length. Whole sequences keep ids on demand."""
    added = struct(
        "doc_tokens bigint, part int, start bigint, length int, rank bigint, ids_crc32 bigint, ids binary"
    )
    schema = T.StructType([docs.schema[key], *added])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            owner: list[int] = []
            new: dict[str, list] = {f.name: [] for f in added}
            for i, data in enumerate(encoder.encode_batch(batch.column(text).to_pylist())):
                data += end
                total = len(data) // 4
                for start in range(0, total, size):
                    piece = data[4 * start : 4 * (start + size)]
                    length = len(piece) // 4
                    keep = all_ids or length < size
                    owner.append(i)
                    new["doc_tokens"].append(total)
                    new["start"].append(start)
                    new["length"].append(length)
                    new["rank"].append(int(seen[length]))
                    new["ids_crc32"].append(zlib.crc32(piece))
                    new["ids"].append(
                        np.frombuffer(piece, "<u4").astype(encoder.width).tobytes() if keep else None
                    )
                    seen[length] += 1
            new["part"] = [part] * len(owner)
            columns = [batch.column(key).take(pa.array(owner, pa.int64()))]
            columns += [arrow_array(new[f.name], f) for f in added]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return docs.select(key, text).mapInArrow(run, schema)


# -- packing the histogram


@dataclass(frozen=True)
class Pattern:
    """``count`` packs that hold ``times`` items of each ``length``, in this order; ``space`` is left."""

    items: tuple[tuple[int, int], ...]
    count: int
    space: int


def pack_histogram(histogram: dict[int, int], size: int) -> list[Pattern]:
    """Shortest-pack-first: lengths from the longest on, each item into the pack with most space.

    A new pack is opened when an item does not fit the shortest one. Packs with one pattern move together.
    """
    # Open packs by space: stacks of [items so far, count]. The heap may hold spaces that are used up.
    stacks: dict[int, list[tuple[tuple, int]]] = {}
    heap: list[int] = []

    def put(items: tuple, count: int, space: int) -> None:
        if not stacks.get(space):
            stacks[space] = []
            heapq.heappush(heap, -space)
        stacks[space].append((items, count))

    def widest() -> int:
        while heap and not stacks.get(-heap[0]):
            heapq.heappop(heap)
        return -heap[0] if heap else -1

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = widest()
            if space < length:
                # Nothing fits: packs of this length alone, filled one after the other.
                each = size // length
                if left >= each:
                    put(((length, each),), left // each, size - each * length)
                if left % each:
                    put(((length, left % each),), 1, size - left % each * length)
                break
            items, count = stacks[space].pop()
            # Items for each pack of this pattern until it is no longer the shortest.
            times = min(max(1, -(-(space - max(widest(), 0)) // length)), space // length)
            if left < times * count:
                times = 1
            used = min(count, left // times)
            if used < count:
                put(items, count - used, space)
            if items and items[-1][0] == length:
                grown = (*items[:-1], (length, items[-1][1] + times))
            else:
                grown = (*items, (length, times))
            put(grown, used, space - times * length)
            left -= times * used
    return [
        Pattern(items, count, space)
        for space in sorted(stacks, reverse=True)
        for items, count in stacks[space]
    ]


def dissolved(patterns: list[Pattern], size: int, allowed: int) -> tuple[list[Pattern], list[Pattern]]:
    """(packs that stay, packs whose pieces fill the gaps of the others) for at most ``allowed`` padding."""
    padding = sum(p.space * p.count for p in patterns)
    need = min(-(-max(padding - allowed, 0) // size), padding // size)
    stay, give = [], []
    for p in sorted(patterns, key=lambda p: -p.space):
        given = min(need, p.count)
        need -= given
        if given:
            give.append(Pattern(p.items, given, p.space))
        if p.count > given:
            stay.append(Pattern(p.items, p.count - given, p.space))
    return stay, give


@dataclass
class Plan:
    """Where the items of every length go, by rank; arrays with one entry per length and pattern.

    Items are numbered over all lengths: item k of a length has number ``first[length] + k``.
    """

    first: np.ndarray
    number: np.ndarray
    times: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    # Position of the entry's first token among all tokens that are cut into gaps; -1: it stays whole.
    token: np.ndarray
    length: np.ndarray
    # Gaps by position: first token, width, sequence of the first, tokens before the gap in its sequence.
    gap_token: np.ndarray
    gap_width: np.ndarray
    gap_sequence: np.ndarray
    gap_offset: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence, offset and position among cut tokens (-1: not cut) of items."""
        item = self.first[length] + rank
        at = np.searchsorted(self.number, item, "right") - 1
        item = item - self.number[at]
        sequence = self.sequence[at] + item // self.times[at]
        offset = self.offset[at] + item % self.times[at] * length
        token = np.where(self.token[at] < 0, -1, self.token[at] + item * length)
        return sequence, offset, token

    def cut(self, token: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the item, length, sequence, offset) of each part of an item cut into gaps."""
        done = 0
        while done < length:
            at = int(np.searchsorted(self.gap_token, token + done, "right")) - 1
            width = int(self.gap_width[at])
            pack, inside = divmod(token + done - int(self.gap_token[at]), width)
            take = min(length - done, width - inside)
            yield done, take, int(self.gap_sequence[at]) + pack, int(self.gap_offset[at]) + inside
            done += take


def plan(histogram: dict[int, int], size: int = SIZE, padding: float = 0.0) -> Plan:
    """The plan for a histogram of piece lengths up to ``size``."""
    total = sum(length * n for length, n in histogram.items())
    open_packs = pack_histogram({k: n for k, n in histogram.items() if k < size}, size)
    stay, give = dissolved(open_packs, size, int(padding * total))
    if whole := histogram.get(size, 0):
        stay.append(Pattern(((size, 1),), whole, 0))
    entries: dict[int, list[tuple]] = {}
    gaps, sequence, gap_token, token = [], 0, 0, 0
    for p in stay:
        offset = 0
        for length, times in p.items:
            entries.setdefault(length, []).append((times * p.count, times, sequence, offset, -1))
            offset += times * length
        if p.space:
            gaps.append((gap_token, p.space, sequence, offset))
            gap_token += p.space * p.count
        sequence += p.count
    for p in give:
        for length, times in p.items:
            entries.setdefault(length, []).append((times * p.count, 1, 0, 0, token))
            token += times * p.count * length
    first = np.zeros(size + 1, np.int64)
    rows, number = [], 0
    for length in sorted(entries):
        first[length] = number
        for n, times, seq, offset, cut in entries[length]:
            rows.append((number, times, seq, offset, cut, length))
            number += n
    columns = np.array(rows, np.int64).reshape(len(rows), 6).T
    return Plan(first, *columns, *np.array(gaps, np.int64).reshape(len(gaps), 4).T)


# -- documents


def pack(
    docs: DataFrame,
    tokenizer: bpe.Tokenizer,
    key: str = "doc_id",
    text: str = "text",
    size: int = SIZE,
    end_id: int = END_ID,
    padding: float = 0.0,
    with_ids: bool = False,
) -> DataFrame:
    """Every piece with its place: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``padding`` is the share of padding up to which no document is cut to fill gaps. ``with_ids`` adds the
    piece's ids as little-endian unsigned 32-bit integers.
    """
    made = cut_lineage(_pieces(docs, tokenizer, key, text, size, end_id, with_ids))
    by_part = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(
        by_part.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    )
    # At most ``size`` rows.
    histogram = {r.length: r.n for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = plan(histogram, size, padding)
    kept = [c for c in made.columns if c != "ids" or with_ids]
    ranked = made.select(*kept).join(starts.drop("n"), ["part", "length"])
    ranked = ranked.withColumn("_rank", F.col("rank") + F.col("before"))

    def make_places():
        def compute(batch):
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("_rank").to_numpy()
            sequence, offset, token = found.place(length, rank)
            return {"sequence_id": sequence, "offset": offset, "_token": token}

        return compute

    places = struct("sequence_id bigint, offset bigint, _token bigint")
    placed = cut_lineage(map_rows(ranked, make_places, places, kept))
    columns = [key, "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens"]
    columns += ["sequence_id", "offset"]
    width = _width(json.loads(tokenizer.raw))
    whole = placed.filter(F.col("_token") < 0)
    if with_ids:
        whole = map_rows(whole, lambda: _widen(width), struct("_ids binary"), whole.columns)
        whole = whole.drop("ids").withColumnRenamed("_ids", "ids")
        columns.append("ids")
    if not (found.token >= 0).any():
        return whole.select(*columns)
    lengths = sorted({int(n) for n in found.length[found.token >= 0]})
    cut = placed.filter(F.col("_token") >= 0)
    if not with_ids:
        ids = made.filter(F.col("length").isin(lengths)).select("part", "length", "rank", "ids")
        cut = cut.join(ids, ["part", "length", "rank"])

    def make_parts():
        def compute(batch):
            new: dict[str, list] = {f.name: [] for f in parts}
            for token, data in zip(batch.column("_token").to_pylist(), batch.column("ids").to_pylist()):
                ids = np.frombuffer(data, width).astype("<u4")
                rows = list(found.cut(token, len(ids)))
                new["_from"].append([r[0] for r in rows])
                new["_length"].append([r[1] for r in rows])
                new["_sequence"].append([r[2] for r in rows])
                new["_offset"].append([r[3] for r in rows])
                new["_crc"].append([zlib.crc32(ids[a : a + n].tobytes()) for a, n, _, _ in rows])
                new["_wide"].append(ids.tobytes())
            return new

        return compute

    parts = struct(
        "_from array<bigint>, _length array<bigint>, _sequence array<bigint>, _offset array<bigint>, "
        "_crc array<bigint>, _wide binary"
    )
    several = map_rows(cut, make_parts, parts, [key, "start", "doc_tokens"]).select(
        key,
        "start",
        "doc_tokens",
        "_wide",
        F.explode(F.arrays_zip("_from", "_length", "_sequence", "_offset", "_crc")).alias("_p"),
    )
    several = several.select(
        key,
        (F.col("start") + F.col("_p._from")).alias("start"),
        F.col("_p._length").alias("length"),
        F.col("_p._crc").alias("ids_crc32"),
        "doc_tokens",
        F.col("_p._sequence").alias("sequence_id"),
        F.col("_p._offset").alias("offset"),
        F.expr("substring(_wide, cast(4 * _p._from + 1 as int), cast(4 * _p._length as int))").alias("ids"),
    )
    return whole.select(*columns).unionByName(several.select(*whole.select(*columns).columns))


def _width(spec: dict) -> str:
    """How ids are stored between the steps: in two bytes if all of them fit."""
    largest = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return "<u2" if largest < 1 << 16 else "<u4"


def _widen(width: str):
    def compute(batch):
        ids = batch.column("ids").to_pylist()
        return {"_ids": [np.frombuffer(d, width).astype("<u4").tobytes() for d in ids]}

    return compute


def sequences(pieces: DataFrame, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """The packed sequences of pieces with ids: sequence_id, length, and ids padded to ``size``."""
    # A sequence has at most ``size`` pieces. They are joined as hexadecimal text, as there is no function
    # that joins an array of binaries.
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("hex"))))
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("_parts"))
    pad = np.array([pad_id], "<u4").tobytes().hex()
    return whole.select(
        "sequence_id",
        "length",
        F.unhex(
            F.concat(
                F.array_join(F.col("_parts.hex"), ""),
                F.repeat(F.lit(pad), (F.lit(size) - F.col("length")).cast("int")),
            )
        ).alias("ids"),
    )
