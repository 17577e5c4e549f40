"""Byte-pair encoding by speculation and verification, and decoding.

For a tokenizer file with word ends (BPE model with an end-of-word suffix; NFC, lower case, white space
dropped). Each distinct word is encoded once per batch:

1. speculate: greedy longest match proposes tokens;
2. verify: a proposal is the exact encoding when each token encodes to itself and every adjacent pair does,
   so all pairs of a batch are looked up at once in a sorted table of judged pairs;
3. only words with a failing pair undergo exact merging.

Tables of judged pairs and finished words stay in the Python worker between batches; they are caches of
bounded size and never change a result. There is no shuffle.

Defined results: a null text encodes and decodes as the empty text (no ids); the strings of the added
tokens in a text become their ids; repeated rows are encoded one by one; texts and words may have any length.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import regex
import tokenizers
from pyspark.sql import DataFrame

from cohortlens.llm.common import fresh, map_rows, struct

# Entries of the caches in one Python worker.
WORDS = 400_000
PAIRS = 2_000_000
# Longer words are merged with a heap.
SHORT = 200
HEAD = 3
LONGEST = 64
NONE = 1 << 30

# The library's normaliser and splitter need some model beside them.
_TINY_MODEL = {"type": "BPE", "vocab": {}, "merges": []}

# The split pattern and the white space of the tokenizer file's regular expressions.
SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
# Characters that Python's Unicode tables do not know yet, and combining marks, whose order in the normal
# form depends on the version of these tables. Chunks with these are normalised by the library.
VERSIONED_CATEGORIES = ("Cn", "Mn", "Mc", "Me")
# str.split() also splits at these, which are no white space here.
SEPARATORS = re.compile("[\x1c-\x1f]")
WHITE = re.compile(f"[{SPACE}]+")


def versioned(text: str) -> str:
    """The characters of a text whose treatment may differ between versions of the Unicode tables."""
    return "".join(c for c in set(text) if unicodedata.category(c) in VERSIONED_CATEGORIES)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


@dataclass(frozen=True)
class Tokenizer:
    """The content of a tokenizer file; small enough (a few MB) to travel with the tasks."""

    raw: bytes

    @classmethod
    def read(cls, path: str) -> Tokenizer:
        with open(path, "rb") as file:
            raw = file.read()
        Encoder(json.loads(raw))
        return cls(raw)

    def encoder(self) -> Encoder:
        key = hashlib.sha256(self.raw).digest()
        if key not in _LOADED:
            _LOADED[key] = Encoder(json.loads(self.raw))
        return _LOADED[key]


class Encoder:
    def __init__(self, spec: dict):
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a BPE file with word ends, NFC and lower case is expected")
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, self.added)) or "(?!)")
        names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}
        self.tokens = [names.get(i, "").encode() for i in range(max(names) + 1)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            self.ranks.setdefault((self.ids[a], self.ids[b]), rank)
        self.merged = [self.ids[a + b] for a, b in merges]
        self.symbols = dict(enumerate(byte_symbols()))
        self.split = regex.compile(SPLIT + r"|\n")
        self.library = tokenizers.Tokenizer.from_str(json.dumps(spec | {"model": _TINY_MODEL, "added_tokens": []}))
        # Speculation may only propose tokens that encode to themselves.
        self.proposed: dict[str, int] = {}
        for token, i in self.ids.items():
            if self.merge(self.parts(token)) == [i]:
                self.proposed[token] = i
        # The longest token inside a word, by its first characters.
        self.reach: dict[str, int] = {}
        for token in self.proposed:
            head = token[:HEAD]
            if not (token.endswith(self.end) and len(token) > len(self.end)):
                self.reach[head] = max(self.reach.get(head, 0), len(token))
        self.words: dict[str, bytes] = {}
        self._reset_pairs()

    # -- exact merging

    def parts(self, token: str) -> list[int]:
        """The base symbols of a token, or of a whole word with its end mark."""
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [self.ids[c] for c in body[:-1]] + [self.ids[body[-1] + self.end]]
        return [self.ids[c] for c in token]

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the pair of the lowest rank, the leftmost first, until none is left."""
        if len(ids) > SHORT:
            return self._merge_long(ids)
        get, new = self.ranks.get, self.merged
        ranks = [get(pair, NONE) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            ids[i] = new[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NONE)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs and linked symbols, for words of any length."""
        n, get, new = len(ids), self.ranks.get, self.merged
        left, right, token = list(range(-1, n - 1)), [*range(1, n), -1], list(ids)
        heap = [(r, i) for i, p in enumerate(zip(ids, ids[1:])) if (r := get(p, NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i]
            if token[i] < 0 or j < 0 or get((token[i], token[j]), NONE) != rank:
                continue
            token[i], token[j] = new[rank], -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (r := get((token[i], token[k]), NONE)) != NONE:
                    heapq.heappush(heap, (r, i))
            if (h := left[i]) >= 0 and (r := get((token[h], token[i]), NONE)) != NONE:
                heapq.heappush(heap, (r, h))
        return [t for t in token if t >= 0]

    # -- speculation and verification

    def propose(self, word: str) -> list[int]:
        """Greedy longest match over the byte symbols of a word."""
        found, at, n, get, end, reach = [], 0, len(word), self.proposed.get, self.end, self.reach.get
        while at < n:
            if n - at <= LONGEST and (token := get(word[at:] + end)) is not None:
                found.append(token)
                break
            # The last symbol of a word has a token of its own, so one symbol is left at least.
            stop = min(at + reach(word[at : at + HEAD], HEAD - 1), n - 1)
            while (token := get(word[at:stop])) is None:
                stop -= 1
            found.append(token)
            at = stop
        return found

    def _reset_pairs(self) -> None:
        self.pair_keys, self.pair_good = np.empty(0, np.int64), np.empty(0, bool)

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """Does each pair of tokens, as first * 2^32 + second, encode to itself?"""
        at = np.searchsorted(self.pair_keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.pair_keys)
        known[inside] = self.pair_keys[at[inside]] == keys[inside]
        new = np.unique(keys[~known])
        if len(new):
            if len(self.pair_keys) + len(new) > PAIRS:
                self._reset_pairs()
                new = np.unique(keys)
            names = self.names
            good = np.empty(len(new), bool)
            for i, key in enumerate(new.tolist()):
                a, b = key >> 32, key & 0xFFFFFFFF
                good[i] = self.merge(self.parts(names[a] + names[b])) == [a, b]
            merged = np.concatenate((self.pair_keys, new))
            order = np.argsort(merged, kind="stable")
            self.pair_keys = merged[order]
            self.pair_good = np.concatenate((self.pair_good, good))[order]
            at = np.searchsorted(self.pair_keys, keys)
        return self.pair_good[at]

    @property
    def names(self) -> list[str]:
        if not hasattr(self, "_names"):
            self._names = [t.decode() for t in self.tokens]
        return self._names

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The exact encoding of words given as byte symbols: all ids in a row, and how many each has."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        proposals = [self.propose(w) for w in words]
        sizes, flat = _flat(proposals)
        owner = np.repeat(np.arange(len(words)), sizes)
        adjacent = owner[1:] == owner[:-1]
        keys = ((flat[:-1] << 32) | flat[1:])[adjacent]
        failing = np.unique(owner[1:][adjacent][~self.compatible(keys)])
        for i in failing.tolist():
            proposals[i] = self.merge(self.parts(words[i] + self.end))
        sizes, flat = _flat(proposals)
        return flat, sizes

    # -- texts

    def _pieces(self, chunks: list[str]) -> tuple[list[str], list[int]]:
        """The words of all chunks in a row, their bytes as Latin-1, and how many each chunk has."""
        # Normal form, lower case and the split never look across a line end, so chunks go together.
        # Lower case goes character by character: a final sigma is like any other.
        plain = unicodedata.normalize("NFC", "\n".join(chunks)).replace("Σ", "σ").lower()
        found = self.split.findall(plain)
        ends = [i for i, piece in enumerate(found) if piece == "\n"] + [len(found)]
        counts = [b - a - 1 for a, b in zip([-1, *ends], ends)]
        pieces = [p for p in found if p != "\n"]
        return [p if p.isascii() else p.encode().decode("latin-1") for p in pieces], counts

    def _learn(self, chunks: set[str]) -> None:
        """Encode chunks of text without white space and keep them in the cache."""
        if len(self.words) + len(chunks) > WORDS:
            self.words.clear()
        listed = list(chunks)
        if not listed:
            return
        if characters := versioned("".join(listed)):
            found = re.compile(f"[{re.escape(characters)}]")
            rare = [c for c in listed if found.search(c)]
            common = [c for c in listed if not found.search(c)]
            pieces, counts = self._pieces(common) if common else ([], [])
            for chunk in rare:
                own = self._split_by_library(chunk)
                pieces += own
                counts.append(len(own))
            listed = common + rare
        else:
            pieces, counts = self._pieces(listed)
        number = {piece: i for i, piece in enumerate(dict.fromkeys(pieces))}
        flat, sizes = self.encode_words([p.translate(self.symbols) for p in number])
        starts = np.cumsum(sizes) - sizes
        which = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        # Lay the ids of the pieces out in the order of the chunks.
        long = sizes[which]
        before = np.cumsum(long) - long
        total = int(long.sum())
        source = np.arange(total) + np.repeat(starts[which] - before, long)
        data = flat[source].astype("<u4").tobytes()
        owner = np.repeat(np.arange(len(listed)), counts)
        per_chunk = np.bincount(owner, weights=long, minlength=len(listed)).astype(np.int64)
        ends = (np.cumsum(per_chunk) * 4).tolist()
        self.words.update(
            (chunk, data[a:b]) for chunk, a, b in zip(listed, [0, *ends], ends)
        )

    def _split_by_library(self, chunk: str) -> list[str]:
        """Normalise and split text with characters newer than Python's tables; bytes as Latin-1."""
        plain = self.library.normalizer.normalize_str(chunk)
        shown = {ord(s): b for b, s in self.symbols.items()}
        found = self.library.pre_tokenizer.pre_tokenize_str(plain)
        return [piece.translate(shown) for piece, _ in found]

    def _chunks(self, text: str) -> list[str]:
        return list(filter(None, WHITE.split(text))) if SEPARATORS.search(text) else text.split()

    def _parts(self, text: str | None) -> list[list[str] | bytes]:
        """Lists of chunks, and between them the ids of added tokens."""
        text = text or ""
        if "<|" not in text or not self.special.search(text):
            return [self._chunks(text)]
        parts, at = [], 0
        for m in self.special.finditer(text):
            parts += [self._chunks(text[at : m.start()]), self.added[m[0]].to_bytes(4, "little")]
            at = m.end()
        return [*parts, self._chunks(text[at:])]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        done: list[bytes] = []
        waiting: list[list] = []
        new: set[str] = set()

        def finish():
            nonlocal new
            if len(self.words) + len(new) > WORDS:
                # The cache is about to be emptied, so what these texts need of it is encoded again.
                new = {c for parts in waiting for p in parts if isinstance(p, list) for c in p}
            self._learn(new)
            get = self.words.__getitem__
            for parts in waiting:
                done.append(
                    b"".join(b"".join(map(get, p)) if isinstance(p, list) else p for p in parts)
                )
            waiting.clear()
            new = set()

        for text in texts:
            parts = self._parts(text)
            waiting.append(parts)
            for part in parts:
                if isinstance(part, list):
                    new |= set(part).difference(self.words)
            if len(new) > WORDS // 8:
                finish()
        finish()
        return done

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8: the tokens joined by spaces."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return sizes, np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(sizes.sum()))


_LOADED: dict[bytes, Encoder] = {}


def encode(docs: DataFrame, tokenizer: Tokenizer, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of their texts in a new column (array<int>), named afresh if taken."""
    name = fresh(docs, ids)

    def make():
        encoder = tokenizer.encoder()

        def compute(batch):
            found = encoder.encode_batch(batch.column(text).to_pylist())
            return {name: [np.frombuffer(b, "<u4").astype(np.int32) for b in found]}

        return compute

    return map_rows(docs, make, struct(f"`{name}` array<int>"), docs.columns)


def decode(rows: DataFrame, tokenizer: Tokenizer, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of their token ids; null ids decode to the empty text."""
    name = fresh(rows, text)

    def make():
        encoder = tokenizer.encoder()

        def compute(batch):
            lists = batch.column(ids).to_pylist()
            return {
                name: [encoder.decode(np.array(x or [], "<u4").tobytes()).decode() for x in lists]
            }

        return compute

    return map_rows(rows, make, struct(f"`{name}` string"), rows.columns)


def _digests(docs: DataFrame, tokenizer: Tokenizer, key: str, text: str, ids: bool) -> DataFrame:
    def make():
        encoder = tokenizer.encoder()

        def compute(batch):
            found = encoder.encode_batch(batch.column(text).to_pylist())
            out = {
                "n_tokens": [len(b) // 4 for b in found],
                "ids_sha256": [hashlib.sha256(b).hexdigest() for b in found],
                "decoded_sha256": [hashlib.sha256(encoder.decode(b)).hexdigest() for b in found],
            }
            if ids:
                out["ids"] = [np.frombuffer(b, "<u4").astype(np.int32) for b in found]
            return out

        return compute

    added = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs, make, struct(added + ", ids array<int>" * ids), [key])


def report(docs: DataFrame, tokenizer: Tokenizer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of tokens and digests of the ids and of the decoded text, in one pass."""
    return _digests(docs, tokenizer, key, text, ids=False)


def encode_documents(
    docs: DataFrame, tokenizer: Tokenizer, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``report`` with the ids themselves (array<int>)."""
    return _digests(docs, tokenizer, key, text, ids=True)
