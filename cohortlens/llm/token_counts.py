"""Token counts that follow edits.

A document is cut into segments of ``SEGMENT`` pre-tokens. Its state holds the characters and tokens of every
segment and, as a segment tree, their sums. An edit re-encodes only the segments it touches, a few characters
of context before it, and what follows until a segment end of the old text is met again; the sums above the
replaced segments are renewed.

This is exact: a pre-token depends on its own characters and on at most ``CONTEXT`` characters behind its end,
never on what stands before it, so a cut between two pre-tokens well before an edit stays a cut, and from a cut
that the new text shares with the old one behind the edit everything is as it was.

Defined results: a null text counts as the empty text (no segments, 0 tokens); edits are applied in the order
given, each to the text as the one before left it; positions beyond the end append, negative positions and
lengths count as 0, a null insertion inserts nothing; documents without edits keep their state; repeated rows
are counted one by one; texts may have any length; an empty table gives an empty result; columns that clash
with results are kept beside a longer name.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame

from cohortlens.llm.common import fresh, map_rows, struct

SEGMENT = 64
CONTEXT = 4
CACHE = 400_000


@dataclass(frozen=True)
class Counter:
    """A rank file's content and the pattern that splits text before the merges."""

    raw: bytes
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str) -> Counter:
        return cls(Path(path).read_bytes(), pattern)

    def open(self) -> Pieces:
        if self not in _OPEN:
            _OPEN[self] = Pieces(self)
        return _OPEN[self]


class Pieces(dict):
    """Tokens of a pre-token, remembered in a table of bounded size."""

    def __init__(self, counter: Counter):
        super().__init__()
        lines = map(bytes.split, counter.raw.splitlines())
        ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.encoding = tiktoken.Encoding(
            "counted", pat_str=counter.pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.split = regex.compile(counter.pattern)

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[piece] = len(self.encoding.encode_ordinary(piece))
        return value


_OPEN: dict[Counter, Pieces] = {}


def build_tree(leaves: np.ndarray) -> np.ndarray:
    """Sums over pairs, level by level: the root is at 1, the leaves fill the upper half."""
    width = 1
    while width < len(leaves):
        width *= 2
    tree = np.zeros(2 * width, np.int64)
    tree[width : width + len(leaves)] = leaves
    while width > 1:
        half = width // 2
        tree[half:width] = tree[width : 2 * width].reshape(-1, 2).sum(1)
        width = half
    return tree


def update_tree(tree: np.ndarray, first: int, leaves: np.ndarray) -> None:
    """Put new leaves in place and renew the sums above them only."""
    width = len(tree) // 2
    tree[width + first : width + first + len(leaves)] = leaves
    low, high = width + first, width + first + len(leaves) - 1
    while low > 1:
        low, high = low // 2, high // 2
        children = tree[2 * low : 2 * high + 2].reshape(-1, 2)
        tree[low : high + 1] = children.sum(1)


class Counted:
    """A text and its segment tree."""

    def __init__(self, text: str, pieces: Pieces):
        self.pieces = pieces
        self.text = text
        self.encoded = 0
        self.chars, tokens = self._segments(pieces.split.findall(text))
        self.tree = build_tree(tokens)
        self.built = self.encoded
        self.encoded = 0

    @property
    def n_tokens(self) -> int:
        return int(self.tree[1]) if len(self.tree) > 1 else 0

    def _segments(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        starts = np.arange(0, len(found), SEGMENT)
        self.encoded += len(starts)
        chars = np.fromiter(map(len, found), np.int64, len(found))
        tokens = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        return np.add.reduceat(chars, starts), np.add.reduceat(tokens, starts)

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters from ``at`` on, and count again what that touches."""
        at = min(max(at, 0), len(self.text))
        stop = min(at + max(removed, 0), len(self.text))
        if at == stop and not inserted:
            return
        ends = np.cumsum(self.chars)
        # The segments before ``first`` end far enough before the edit to stay as they are.
        first = int(np.searchsorted(ends, at - CONTEXT, "right"))
        begin = int(ends[first - 1]) if first else 0
        self.text = self.text[:at] + inserted + self.text[stop:]
        shift = len(inserted) - (stop - at)
        # Old cuts behind the edit, as positions of the new text.
        last = int(np.searchsorted(ends, stop, "left"))
        cuts = {int(e) + shift: last + i + 1 for i, e in enumerate(ends[last:].tolist())}
        found, place, rest = [], begin, len(ends)
        for m in self.pieces.split.finditer(self.text, begin):
            found.append(m[0])
            place = m.end()
            if place in cuts:
                rest = cuts[place]
                break
        chars, tokens = self._segments(found)
        width = len(self.tree) // 2
        old = self.tree[width : width + len(ends)]
        if len(chars) == rest - first:
            self.chars[first:rest] = chars
            if len(chars):
                update_tree(self.tree, first, tokens)
            return
        # Another number of segments moves the leaves behind them; their counts stay.
        self.chars = np.concatenate((self.chars[:first], chars, self.chars[rest:]))
        leaves = np.concatenate((old[:first], tokens, old[rest:]))
        if len(leaves) <= width and len(leaves):
            behind = np.zeros(max(len(leaves), len(ends)) - first, np.int64)
            behind[: len(leaves) - first] = leaves[first:]
            update_tree(self.tree, first, behind) if len(behind) else None
        else:
            self.tree = build_tree(leaves)


_STATE = "n_tokens bigint, n_segments bigint, chars array<bigint>, tree array<bigint>"


def count(docs: DataFrame, counter: Counter, text: str = "text", keep=None) -> DataFrame:
    """``keep`` columns with the state of each text: tokens, segments, their characters and the tree."""
    keep = docs.columns if keep is None else keep
    names = {c: fresh(docs.select(*keep), c) for c in ("n_tokens", "n_segments", "chars", "tree")}

    def make():
        pieces = counter.open()

        def compute(batch):
            states = [Counted(t or "", pieces) for t in batch.column(text).to_pylist()]
            return {
                names["n_tokens"]: [s.n_tokens for s in states],
                names["n_segments"]: [len(s.chars) for s in states],
                names["chars"]: [s.chars for s in states],
                names["tree"]: [s.tree for s in states],
            }

        return compute

    added = _STATE
    for plain, name in names.items():
        added = added.replace(f"{plain} ", f"`{name}` ")
    return map_rows(docs, make, struct(added), keep)


def recount(
    docs: DataFrame,
    counter: Counter,
    edits: str = "edits",
    text: str = "text",
    keep: list[str] | None = None,
    with_text: bool = True,
) -> DataFrame:
    """Count every text, apply its edits, and count again by its tree.

    ``edits`` is a column of array<struct<at,removed,inserted>>, positions in characters. Added columns:
    n_tokens and n_segments before, n_tokens_edited and n_segments_edited after the edits, n_reencoded (the
    segments encoded again) and, unless ``with_text`` is off, edited (the new text).
    """
    keep = [c for c in docs.columns if c != edits] if keep is None else keep
    plain = ["n_tokens", "n_segments", "n_tokens_edited", "n_segments_edited", "n_reencoded"]
    plain += ["edited"] * with_text
    names = {c: fresh(docs.select(*keep), c) for c in plain}

    def make():
        pieces = counter.open()

        def compute(batch):
            out: dict[str, list] = {c: [] for c in plain}
            for value, changes in zip(batch.column(text).to_pylist(), batch.column(edits).to_pylist()):
                state = Counted(value or "", pieces)
                out["n_tokens"].append(state.n_tokens)
                out["n_segments"].append(len(state.chars))
                for change in changes or ():
                    if change is not None:
                        state.edit(change["at"] or 0, change["removed"] or 0, change["inserted"] or "")
                out["n_tokens_edited"].append(state.n_tokens)
                out["n_segments_edited"].append(len(state.chars))
                out["n_reencoded"].append(state.encoded)
                if with_text:
                    out["edited"].append(state.text)
            return {names[c]: v for c, v in out.items()}

        return compute

    added = ", ".join(f"`{names[c]}` {'string' if c == 'edited' else 'bigint'}" for c in plain)
    return map_rows(docs, make, struct(added), keep)
