"""Decision trees and boosted trees grown level by level from shared histograms.

Features are cut into bins once. To grow a level, every task routes its rows through the trees so far and
adds up two whole numbers per (tree, node, feature, bin); these small tables are summed by Spark, turned into
the gain of every cut by running sums over the bins, and the best cut of each node is all the driver gets. So a
level costs one pass over the rows, however many trees grow: all folds and choices of a grid search, or one
boosting round. Trees that differ in their greatest depth only are one tree, cut off at that depth.

The two sums are counts of both labels (classification, Gini gain), or gradient and hessian in units of
2^-30 (boosting, second-order gain). Whole numbers add up to the same in any order, so a run repeated with
other partitions, or a lost task run again, gives the same trees. Equal gains go to the first feature and the
lowest cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.stats import exact_quantiles
from cohortlens.session import cut_lineage, hold

BINS = 32
DIGITS = 6
# Gains below this are rounding, not information.
LEAST_GAIN = 1e-9
UNIT = float(1 << 30)
# Boosting rounds whose trees are walked through again in every pass; older ones are in the written margin.
ROUNDS_PER_CUT = 4


# -- bins


def bin_cuts(rows: DataFrame, features: int, bins: int = BINS) -> list[list[float]]:
    """Distinct cut points per feature: its exact quantiles at i / bins."""
    names = [f"f{i:04d}" for i in range(features)]
    wide = rows.select(*[F.round(F.get("_x", F.lit(i)), DIGITS).alias(c) for i, c in enumerate(names)])
    found = exact_quantiles(wide, names, [i / bins for i in range(1, bins)])
    cuts: dict[str, list[float]] = {c: [] for c in names}
    # One row per feature.
    for row in found.collect():
        cuts[row["column_name"]] = sorted({v + 0.0 for v in row[1:]})
    return [cuts[c] for c in names]


def binned(data: DataFrame, features: int, bins: int = BINS, fit_on: Column | None = None) -> tuple[DataFrame, list[list[float]]]:
    """Assembled rows with their features as one byte each, kept for many passes, and the cut points.

    A value's bin is the number of cut points below it. ``fit_on`` names the rows that the cut points are
    taken from; all by default.
    """
    if bins > 256:
        raise ValueError("bins are kept in one byte")
    keep = [c for c in data.columns if c != "features"]
    rows = hold(data.select(*keep, vector_to_array("features").alias("_x")))
    cuts = bin_cuts(rows if fit_on is None else rows.filter(fit_on), features, bins)
    plain = rows.select(*keep, F.transform("_x", lambda x: F.round(x, DIGITS)).alias("_x"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in data.schema if f.name in keep)}, bins binary"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame.pop("_x").to_list())
            at = [np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)]
            frame["bins"] = [b.tobytes() for b in np.stack(at, 1).astype(np.uint8)]
            yield frame

    return hold(plain.mapInPandas(run, schema)), cuts


# -- trees


@dataclass
class Tree:
    """A binary tree: node n has the children 2n (bins up to ``bin``) and 2n + 1; feature -1 marks leaves."""

    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    # The two sums of the rows in each node.
    sums: np.ndarray = field(init=False)

    def __post_init__(self):
        size = 2 << self.depth
        self.feature = np.full(size, -1, np.int32)
        self.bin = np.zeros(size, np.int32)
        self.sums = np.zeros((size, 2), np.int64)

    def route(self, x: np.ndarray, depth: int) -> np.ndarray:
        """The node each row reaches within ``depth`` steps."""
        node = np.ones(len(x), np.int64)
        at = np.arange(len(x))
        for _ in range(depth):
            f = self.feature[node]
            right = x[at, np.maximum(f, 0)] > self.bin[node]
            node = np.where(f >= 0, 2 * node + right, node)
        return node

    def leaves(self, depth: int) -> list[int]:
        """Nodes without children when the tree is cut off at ``depth``."""
        found, open_ = [], [1]
        while open_:
            n = open_.pop()
            if self.feature[n] < 0 or n.bit_length() > depth:
                found.append(n)
            else:
                open_ += [2 * n, 2 * n + 1]
        return sorted(found)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def _summed(flat: np.ndarray, s: np.ndarray, size: int) -> np.ndarray:
    """Whole numbers of rows added up by cell, ``flat`` being (rows, cells of a row)."""
    total = np.zeros(size, np.int64)
    most = int(np.abs(s).max(initial=0))
    # A sum of doubles is exact as long as it stays below 2^53.
    rows = max(1, (1 << 53) // max(most, 1))
    for at in range(0, len(s), rows):
        part = flat[at : at + rows]
        weights = np.repeat(s[at : at + rows].astype(float), part.shape[1])
        total += np.bincount(part.ravel(), weights, size).astype(np.int64)
    return total


def _gini(a: Column, b: Column) -> Column:
    return (a * a + b * b) / (a + b)


def _best_cuts(sums: DataFrame, score: Callable[[Column, Column], Column], good: Callable) -> list:
    """The best cut of every node, from (tree, node, feature, bin, s0, s1)."""
    bins = Window.partitionBy("tree", "node", "feature")
    upto = bins.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cut = sums.select(
        "tree",
        "node",
        "feature",
        "bin",
        *[F.sum(s).over(upto).alias(f"l{i}") for i, s in enumerate(("s0", "s1"))],
        *[F.sum(s).over(bins).alias(f"t{i}") for i, s in enumerate(("s0", "s1"))],
    )
    left = [F.col(f"l{i}").cast("double") for i in (0, 1)]
    whole = [F.col(f"t{i}").cast("double") for i in (0, 1)]
    right = [w - p for w, p in zip(whole, left)]
    gain = score(*left) + score(*right) - score(*whole)
    return (
        cut.filter(good(*left) & good(*right))
        .withColumn("gain", gain)
        .filter(F.col("gain") > LEAST_GAIN)
        .groupBy("tree", "node")
        .agg(F.min(F.struct((-F.col("gain")).alias("loss"), "feature", "bin", "l0", "l1", "t0", "t1")).alias("c"))
        .select("tree", "node", "c.*")
        .collect()
    )


def _level(
    rows: DataFrame,
    trees: list[Tree],
    level: int,
    offered: list[dict[int, np.ndarray] | None],
    features: int,
    bins: int,
    taken: Callable[[pd.DataFrame, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]],
) -> DataFrame:
    """(tree, node, feature, bin, s0, s1) of the nodes that a level may split.

    ``taken`` yields per tree the positions of its rows in a batch and their two whole numbers. A node's
    offered features are those it may be cut by; None offers all.
    """
    first = 1 << level

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            if not len(frame):
                continue
            x = _matrix(frame["bins"])
            for t, at, a, b in taken(frame, x):
                node = trees[t].route(x[at], level)
                here = np.flatnonzero(node >= first)
                if not len(here):
                    continue
                slot = node[here] - first
                at, a, b = at[here], a[here], b[here]
                if offered[t] is None:
                    values = x[at]
                else:
                    values = np.take_along_axis(x[at], _stacked(offered[t], first)[slot], 1)
                width = values.shape[1]
                flat = (slot[:, None] * width + np.arange(width)) * bins + values
                size = first * width * bins
                if t not in total:
                    total[t] = np.zeros((2, size), np.int64)
                for i, s in enumerate((a, b)):
                    total[t][i] += _summed(flat, s, size)
        for t, sums in total.items():
            found = np.flatnonzero(sums.any(0))
            width = sums.shape[1] // first // bins
            slot, rest = np.divmod(found, width * bins)
            place, bin_ = np.divmod(rest, bins)
            feature = place if offered[t] is None else _stacked(offered[t], first)[slot, place]
            yield pd.DataFrame(
                {"tree": t, "node": slot + first, "feature": feature, "bin": bin_, "s0": sums[0, found], "s1": sums[1, found]}
            )

    schema = "tree int, node int, feature int, bin int, s0 bigint, s1 bigint"
    return (
        rows.mapInPandas(run, schema)
        .groupBy("tree", "node", "feature", "bin")
        .agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))
    )


def _stacked(offered: dict[int, np.ndarray], first: int) -> np.ndarray:
    return np.stack([offered[n] for n in range(first, 2 * first)])


def _split(trees: list[Tree], cuts: list) -> None:
    for r in cuts:
        tree = trees[r.tree]
        tree.feature[r.node], tree.bin[r.node] = r.feature, r.bin
        whole, left = np.array([r.t0, r.t1]), np.array([r.l0, r.l1])
        tree.sums[r.node], tree.sums[2 * r.node], tree.sums[2 * r.node + 1] = whole, left, whole - left


def offered_features(choice: int, node: int, features: int) -> np.ndarray:
    """The ``choice`` features a node may be cut by: those of the smallest hashes with its number."""
    order = sorted(range(features), key=lambda f: hashlib.md5(f"{choice}|{node}|{f}".encode()).hexdigest())
    return np.array(sorted(order[:choice]), np.int64)


# -- grid search


@dataclass
class Grid:
    """Trees by (choice, fold), fold -1 for all rows; mean accuracy by (choice, depth); what was chosen."""

    trees: dict[tuple[int, int], Tree]
    accuracy: dict[tuple[int, int], float]
    choice: int
    depth: int

    @property
    def best(self) -> Tree:
        return self.trees[self.choice, -1]


def grid_search(
    rows: DataFrame, features: int, choices: list[int], depths: list[int], folds: int = 10, bins: int = BINS
) -> Grid:
    """All folds of all choices in one growth; the first of the best mean accuracies over the folds wins.

    ``rows`` are binned training rows with ``label`` (0 or 1) and ``fold``. A pass per level and one to
    judge the folds, whatever the size of the grid. A fold without rows is left out of the mean.
    """
    names = [(c, f) for c in choices for f in range(-1, folds)]
    deepest = max(depths)
    trees = [Tree(deepest) for _ in names]

    def taken(frame, x):
        fold, label = frame["fold"].to_numpy(), frame["label"].to_numpy().astype(np.int64)
        for t, (_, own) in enumerate(names):
            at = np.flatnonzero(fold != own)
            yield t, at, 1 - label[at], label[at]

    both = rows.groupBy("fold").agg(F.sum(1 - F.col("label")).alias("a"), F.sum("label").alias("b")).collect()
    for tree, (_, own) in zip(trees, names):
        tree.sums[1] = sum((np.array([r.a, r.b]) for r in both if r.fold != own), np.zeros(2, np.int64))
    for level in range(deepest):
        first = 1 << level
        offers = {c: {n: offered_features(c, n, features) for n in range(first, 2 * first)} for c in choices}
        sums = _level(rows, trees, level, [offers[c] for c, _ in names], features, bins, taken)
        found = _best_cuts(sums, _gini, lambda a, b: a + b > 0)
        if not found:
            break
        _split(trees, found)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x, fold = _matrix(frame["bins"]), frame["fold"].to_numpy()
            label, out = frame["label"].to_numpy(), []
            for tree, (choice, own) in zip(trees, names):
                at = np.flatnonzero(fold == own)
                for depth in depths if len(at) else ():
                    sums = tree.sums[tree.route(x[at], depth)]
                    right = (sums[:, 1] > sums[:, 0]) == label[at]
                    out.append((choice, own, depth, int(right.sum()), len(at)))
            yield pd.DataFrame(out, columns=["choice", "fold", "depth", "correct", "n"])

    judged = (
        rows.mapInPandas(judge, "choice int, fold int, depth int, correct bigint, n bigint")
        .groupBy("choice", "fold", "depth")
        .agg((F.sum("correct") / F.sum("n")).alias("accuracy"))
        .collect()
    )
    accuracy = {}
    for c in choices:
        for d in depths:
            own = [r.accuracy for r in sorted(judged, key=lambda r: r.fold) if (r.choice, r.depth) == (c, d)]
            accuracy[c, d] = sum(own) / len(own) if own else 0.0
    choice, depth = max(accuracy, key=lambda k: round(accuracy[k], 12))
    return Grid(dict(zip(names, trees)), accuracy, choice, depth)


def tree_predictions(rows: DataFrame, tree: Tree, depth: int) -> DataFrame:
    """Rows without bins, with ``score`` (share of label 1 in the leaf) and ``prediction``; a tie is 0."""
    keep = [f for f in rows.schema if f.name != "bins"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", score double, prediction int"

    def run(frames):
        for frame in frames:
            if len(frame):
                sums = tree.sums[tree.route(_matrix(frame.pop("bins")), depth)]
                frame["score"] = sums[:, 1] / np.maximum(sums.sum(1), 1)
                frame["prediction"] = (sums[:, 1] > sums[:, 0]).astype(np.int32)
                yield frame

    return rows.mapInPandas(run, schema)


# -- boosting


@dataclass
class Boosted:
    """Boosted trees with a value per leaf, from the log odds 0 on."""

    depth: int
    rate: float
    penalty: float
    trees: list[Tree] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray, start: np.ndarray, after: int = 0) -> np.ndarray:
        """Log odds after all rounds, given those after the first ``after``."""
        total = start
        for tree, value in zip(self.trees[after:], self.values[after:]):
            total = total + value[tree.route(x, tree.depth)]
        return total

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds after each round, one row per round; a leaf's value counts wherever a path ends."""
        total, out = np.zeros(len(x)), np.zeros((len(self.trees), len(x)))
        for i, (tree, value) in enumerate(zip(self.trees, self.values)):
            total = total + value[tree.route(x, tree.depth)]
            out[i] = total
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def boost(
    rows: DataFrame,
    features: int,
    rounds: int,
    depth: int,
    rate: float,
    penalty: float = 1.0,
    least_hessian: float = 1.0,
    bins: int = BINS,
) -> Boosted:
    """Second-order boosting of the logistic loss on binned training rows.

    A cut gains G^2 / (H + penalty) of both sides less that of the whole; both sides need ``least_hessian``;
    a leaf adds -rate G / (H + penalty) to the log odds. A pass per round and level. Every few rounds the rows
    are written with their log odds, so that a pass walks through the trees since then only.
    """
    model = Boosted(depth, rate, penalty)
    kept = rows.select("bins", "label", F.lit(0.0).alias("margin"))
    done = 0

    def score(g: Column, h: Column) -> Column:
        return (g / UNIT) * (g / UNIT) / (h / UNIT + penalty)

    def good(g: Column, h: Column) -> Column:
        return h >= least_hessian * UNIT

    def advanced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(margin=model.margin(_matrix(frame["bins"]), frame["margin"].to_numpy(), done))

    for n_round in range(rounds):
        if n_round and n_round % ROUNDS_PER_CUT == 0:
            kept = cut_lineage(kept.mapInPandas(advanced, kept.schema))
            done = n_round
        tree = Tree(depth)

        def taken(frame, x):
            p = sigmoid(model.margin(x, frame["margin"].to_numpy(), done))
            g = np.rint((p - frame["label"].to_numpy()) * UNIT).astype(np.int64)
            h = np.rint(p * (1 - p) * UNIT).astype(np.int64)
            yield 0, np.arange(len(x)), g, h

        for level in range(depth):
            sums = _level(kept, [tree], level, [None], features, bins, taken)
            if level == 0:
                sums = hold(sums)
                whole = sums.filter("feature = 0").agg(F.sum("s0"), F.sum("s1")).first()
                tree.sums[1] = [v or 0 for v in whole]
            found = _best_cuts(sums, score, good)
            if not found:
                break
            _split([tree], found)
        value = np.zeros(2 << depth)
        for n in tree.leaves(depth):
            g, h = tree.sums[n] / UNIT
            value[n] = -rate * g / (h + penalty)
        model.trees.append(tree)
        model.values.append(value)
    return model


def boosted_predictions(rows: DataFrame, model: Boosted, every_round: bool = False) -> DataFrame:
    """Rows without bins, with ``score`` (probability) and ``prediction``; per round with ``every_round``."""
    keep = [f for f in rows.schema if f.name != "bins"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    schema += ", round int, score double, prediction int"

    def run(frames):
        for frame in frames:
            if not len(frame):
                continue
            margins = model.margins(_matrix(frame.pop("bins")))
            for i in range(len(margins)) if every_round else (len(margins) - 1,):
                out = frame.assign(round=i + 1, score=sigmoid(margins[i]))
                out["prediction"] = (out["score"] > 0.5).astype(np.int32)
                yield out

    found = rows.mapInPandas(run, schema)
    return found if every_round else found.drop("round")


def cut_table(tree: Tree, depth: int, cuts: list[list[float]], names: list[str]) -> list[tuple]:
    """(node, feature, threshold, s0, s1) of every node down to ``depth``; leaves have no feature."""
    leaves, open_, rows = set(tree.leaves(depth)), [1], []
    while open_:
        n = open_.pop()
        a, b = (int(v) for v in tree.sums[n])
        if n in leaves:
            rows.append((n, None, None, a, b))
        else:
            f = int(tree.feature[n])
            rows.append((n, names[f], float(cuts[f][tree.bin[n]]), a, b))
            open_ += [2 * n, 2 * n + 1]
    return sorted(rows)
