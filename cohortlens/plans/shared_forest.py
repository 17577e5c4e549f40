"""Random forests of a grid search grown together: all folds, choices and trees in one pass per level.

Rows become blocks of bytes (a bin per feature), ordered by fold. A level is one pass: a task takes one part of
the rows and some of the trees, walks the rows it drew for a tree down to the level, and adds up how many rows of
either label fall into each (node, offered feature, bin). The sums of the parts are added per tree, where the
best cut of each node is found, so the driver only gets the cuts. A tree draws the same rows in all fits.

Sums are as large for a small part as for a large one, so a part holds many rows, and cores are kept busy by
sharing out the trees: parts grow with the rows, and what is shuffled grows with the parts.

Draws are hashes of the row and the tree, and sums are whole numbers, so other partitions give the same forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.stats import exact_quantiles, value_counts
from cohortlens.plans.histogram_trees import DIGITS
from cohortlens.session import cut_lineage, hold

BINS = 32
SEED = 42
BLOCK = 1 << 16
ROWS_A_PART = 1 << 20
# A node without a cut sends its rows to the left, where nothing is cut either.
NO_CUT = 255
# Shares of draws, out of 2^32, up to 0, 1, 2 ... times: the Poisson distribution of mean 1.
_TIMES = [e / 2.718281828459045 for e in np.cumsum(1 / np.cumprod([1.0, *range(1, 10)]))]
TIMES = np.array([min(int(t * (1 << 32)), (1 << 32) - 1) for t in _TIMES], np.uint64)


# -- rows


def cut_points(rows: DataFrame, features: int, bins: int = BINS) -> list[np.ndarray]:
    """Per feature of ``_x`` its cut points: all values but the largest if they are few, else exact quantiles."""
    names = [f"f{i:04d}" for i in range(features)]
    wide = rows.select(*[F.round(F.get("_x", F.lit(i)), DIGITS).alias(c) for i, c in enumerate(names)])
    counted = cut_lineage(value_counts(wide, names))
    sizes = {r.column_name: r["count"] for r in counted.groupBy("column_name").count().collect()}
    few = [c for c in names if sizes.get(c, 0) <= bins]
    many = [c for c in names if c not in few]
    cuts: dict[str, set[float]] = {c: set() for c in names}
    # At most ``bins`` rows per feature.
    for r in counted.filter(F.col("column_name").isin(few)).collect():
        cuts[r.column_name].add(r.value + 0.0)
    for c in few:
        cuts[c] = set(sorted(cuts[c])[:-1])
    if many:
        for r in exact_quantiles(wide, many, [i / bins for i in range(1, bins)]).collect():
            cuts[r["column_name"]] = {v + 0.0 for v in r[1:]}
    return [np.array(sorted(cuts[c])) for c in names]


def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], 1).astype(np.uint8)


def _values(name: str):
    return F.transform(vector_to_array(name), lambda x: F.round(x, DIGITS)).alias("_x")


def blocks(rows: DataFrame, cuts: list[np.ndarray], parts: int) -> DataFrame:
    """(part, number, n, bins, label, fold, draw): rows (label, fold, features, cohort, emplid) as blocks of bytes."""
    plain = rows.select(
        F.col("label").cast("int").alias("label"),
        F.col("fold").cast("int").alias("fold"),
        F.xxhash64("cohort", "emplid", "label", vector_to_array("features")).alias("draw"),
        _values("features"),
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made, kept, n = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pd.DataFrame:
            x, label, fold, draw = (np.concatenate(c) for c in zip(*kept))
            order = np.lexsort((draw, fold))
            columns = {"bins": x, "label": label, "fold": fold, "draw": draw}
            cells = {c: [v[order].tobytes()] for c, v in columns.items()}
            return pd.DataFrame({"part": (task + made) % parts, "number": made, "n": len(order), **cells})

        for frame in frames:
            if not len(frame):
                continue
            if frame[["label", "fold"]].isna().any(axis=None):
                raise ValueError("labels and folds must not be null")
            x = _bins(np.stack(frame["_x"].to_list()), cuts)
            kept.append(
                (x, frame["label"].to_numpy(np.uint8), frame["fold"].to_numpy(np.int16), frame["draw"].to_numpy(np.int64))
            )
            n += len(frame)
            if n >= BLOCK:
                yield block()
                made, kept, n = made + 1, [], 0
        if n:
            yield block()

    schema = "part int, number int, n int, bins binary, label binary, fold binary, draw binary"
    return cut_lineage(plain.mapInPandas(run, schema))


def _arrays(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for r in frame.itertuples():
        yield (
            np.frombuffer(r.bins, np.uint8).reshape(r.n, -1),
            np.frombuffer(r.label, np.uint8),
            np.frombuffer(r.fold, np.int16),
            np.frombuffer(r.draw, np.uint64),
        )


def times_drawn(draw: np.ndarray, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree."""
    z = draw ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + SEED & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z >>= np.uint64(32)
    found = np.zeros(len(z), np.int64)
    for t in TIMES:
        found += z >= t
    return found


def offered(width: int, tree: int, level: int, features: int) -> np.ndarray:
    """The ``width`` features, in order, that each node of a level may be cut by."""
    order = np.random.default_rng([SEED, width, tree, level]).random((1 << level, features)).argsort(1)
    return np.sort(order[:, :width], 1)


# -- trees


class Trees:
    """Cuts of many trees: node n has the children 2n (bins up to ``bin``) and 2n + 1."""

    def __init__(self, number: int, depth: int):
        self.depth = depth
        self.feature = np.zeros((number, 1 << depth), np.uint8)
        self.bin = np.full((number, 1 << depth), NO_CUT, np.uint8)
        # Share of label 1, of all nodes until the trees are grown.
        self.share = np.zeros((number, 2 << depth), np.float32)
        # Nodes of the level being grown that may be cut.
        self.open = np.ones((number, 1), bool)

    def route(self, tree: int, x: np.ndarray, base: np.ndarray, level: int) -> np.ndarray:
        """The node of a level that each row reaches; ``x`` is flat and ``base`` the place of each row in it."""
        feature, bin_ = self.feature[tree].astype(np.int64), self.bin[tree]
        node = np.ones(len(base), np.int64)
        for _ in range(level):
            right = x.take(base + feature.take(node)) > bin_.take(node)
            node += node
            node += right
        return node

    def scores(self, trees: range, x: np.ndarray) -> np.ndarray:
        """Mean share of label 1 over the leaves that a row reaches."""
        flat, base = x.ravel(), np.arange(len(x)) * x.shape[1]
        total = np.zeros(len(x))
        for t in trees:
            total += self.share[t].take(self.route(t, flat, base, self.depth))
        return total / len(trees)


def best_cuts(sums: np.ndarray, names: np.ndarray) -> dict[str, np.ndarray]:
    """The best cut of each node by Gini gain, from sums by (place, node, label, bin); equal gains: first place, bin.

    ``names`` are the features by (node, place).
    """
    left = [sums[:, :, i].cumsum(2, dtype=float) for i in (0, 1)]
    whole = [v[:, :, -1:] for v in left]
    right = [w - v for w, v in zip(whole, left)]

    def score(a, b):
        n = a + b
        return (a * a + b * b) / np.maximum(n, 1), n > 0

    (gain, some), (other, rest) = score(*left), score(*right)
    gain += other - score(*whole)[0]
    gain[~(some & rest & (gain > 1e-9))] = -1.0
    gain = gain.transpose(1, 0, 2)
    nodes, width, bins = gain.shape
    # Gains that differ by rounding only are equal.
    gain = np.round(gain, 9).reshape(nodes, -1)
    at = gain.argmax(1)
    place, bin_ = np.divmod(at, bins)
    each = np.arange(nodes)
    cut = gain[each, at] > 0
    shares = []
    for a, b in (left, right):
        a, b = a[place, each, bin_], b[place, each, bin_]
        shares.append(b / np.maximum(a + b, 1))
    zeros, ones = (w[0, :, 0] for w in whole)
    return {
        "cut": cut.astype(np.uint8),
        "feature": names[each, place].astype(np.uint8),
        "bin": bin_.astype(np.uint8),
        "share": (ones / np.maximum(zeros + ones, 1)).astype(np.float32),
        "left": shares[0],
        "right": shares[1],
    }


def grow(spread: DataFrame, fits: list[tuple[int, int]], number: int, depth: int, features: int, groups: int) -> Trees:
    """``number`` trees for every fit (offered features, fold left out); tree ``j`` of fit ``k`` is ``k number + j``."""
    trees = Trees(len(fits) * number, depth)
    kinds = {"cut": np.uint8, "feature": np.uint8, "bin": np.uint8, "share": np.float32, "left": float, "right": float}
    widths = sorted({w for w, _ in fits})
    tasks = 4 * spread.sparkSession.sparkContext.defaultParallelism
    for level in range(depth):
        first, slots = 1 << level, trees.open.cumsum(1) - 1
        nodes = trees.open.sum(1)
        if not nodes.any():
            break

        def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            frames = [f for f in frames if len(f)]
            if not frames:
                return
            # The task's own rows, a part of bounded size.
            frame = pd.concat(frames)
            for group, own in frame.groupby("group"):
                held = list(_arrays(own))
                for j in range(int(group), number, groups):
                    names = {w: offered(w, j, level, features) for w in widths}
                    sums: dict[int, np.ndarray] = {}
                    for x, label, fold, draw in held:
                        times = times_drawn(draw, j)
                        at = np.flatnonzero(times)
                        flat, base = x[at].ravel(), np.arange(len(at)) * features
                        times, label_at, fold_at = times[at].astype(float), label[at] * BINS, fold[at]
                        for k, (width, left_out) in enumerate(fits):
                            t = k * number + j
                            if not nodes[t]:
                                continue
                            if t not in sums:
                                sums[t] = np.zeros((width, nodes[t] * 2 * BINS), np.int64)
                            lo, hi = np.searchsorted(fold_at, [left_out, left_out + 1])
                            for a, b in ((0, lo), (hi, len(at))):
                                if a == b:
                                    continue
                                where, node = base[a:b], trees.route(t, flat, base[a:b], level) - first
                                weight, cell = times[a:b], label_at[a:b]
                                if nodes[t] < first:
                                    here = np.flatnonzero(trees.open[t].take(node))
                                    where, node, weight, cell = where[here], node[here], weight[here], cell[here]
                                cell = cell + slots[t].take(node) * (2 * BINS)
                                for i in range(width):
                                    value = flat.take(where + names[width][:, i].take(node))
                                    found = np.bincount(cell + value, weight, sums[t].shape[1])
                                    np.add(sums[t][i], found, out=sums[t][i], casting="unsafe")
                    yield pd.DataFrame({"tree": list(sums), "sums": [s.astype("<i4").tobytes() for s in sums.values()]})

        def choose(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            t = int(key[0])
            width, j = fits[t // number][0], t % number
            total = sum(np.frombuffer(s, "<i4").astype(np.int64) for s in frame["sums"])
            total = total.reshape(width, nodes[t], 2, BINS)
            found = best_cuts(total, offered(width, j, level, features)[trees.open[t]])
            return pd.DataFrame({"tree": [t], **{c: [v.tobytes()] for c, v in found.items()}})

        # A number of its own, since partitions of few bytes would be put together, and trees take time.
        added = spread.mapInPandas(add, "tree int, sums binary").repartition(tasks, "tree").groupBy("tree")
        # A few bytes per node.
        rows = added.applyInPandas(choose, "tree int, " + ", ".join(f"{c} binary" for c in kinds)).collect()
        following = np.zeros((len(nodes), 2 * first), bool)
        for r in rows:
            found = {c: np.frombuffer(r[c], kind) for c, kind in kinds.items()}
            slot = np.flatnonzero(trees.open[r.tree])
            node, cut = slot + first, found["cut"] > 0
            trees.share[r.tree, node] = found["share"]
            node, slot = node[cut], slot[cut]
            trees.feature[r.tree, node], trees.bin[r.tree, node] = found["feature"][cut], found["bin"][cut]
            for side in (0, 1):
                share = found[("left", "right")[side]][cut]
                trees.share[r.tree, 2 * node + side] = share
                following[r.tree, 2 * slot + side] = (share > 0) & (share < 1)
        trees.open = following
    # Rows of a node without a cut end in its leftmost descendant.
    for n in range(1, 1 << depth):
        end = trees.bin[:, n] == NO_CUT
        trees.share[end, 2 * n] = trees.share[end, n]
    return trees


class Forest:
    """Mean shares of ``trees``; ``parameters`` is the choice of the grid search."""

    def __init__(self, trees: Trees, which: range, cuts: list[np.ndarray], parameters: str):
        self.trees, self.which, self.cuts, self.parameters = trees, which, cuts, parameters

    def transform(self, data: DataFrame) -> DataFrame:
        """Adds ``prediction``, the mean share of label 1."""
        trees, which, cuts = self.trees, self.which, self.cuts
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.schema if f.name != "features")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    x = _bins(np.stack(frame.pop("_x").to_list()), cuts)
                    yield frame.assign(prediction=trees.scores(which, x))

        plain = data.select(*[c for c in data.columns if c != "features"], _values("features"))
        return plain.mapInPandas(run, f"{schema}, prediction double")


class ForestSearch:
    """Grid search over the share of features a node is offered, by folds given in ``fold``; the first best wins.

    The two choices of ``strategies`` are ``"1"``, one feature, and ``"sqrt"``. A fold without rows is left out.
    """

    def __init__(self, strategies: list[str], trees: int = 100, depth: int = 10, folds: int = 10):
        self.strategies, self.number, self.depth, self.folds = strategies, trees, depth, folds

    def fit(self, rows: DataFrame) -> Forest:
        spark = rows.sparkSession
        width = rows.select(F.size(vector_to_array("features")).alias("n")).first()
        features = width.n if width else 0
        cuts = cut_points(rows.select(_values("features")), features)
        parts = max(-(-rows.count() // ROWS_A_PART), 1)
        groups = min(max(-(-2 * spark.sparkContext.defaultParallelism // parts), 1), self.number)
        shares = spark.range(groups).select(F.col("id").cast("int").alias("group"))
        place = (F.col("part") * groups + F.col("group")).cast("int")
        made = blocks(rows, cuts, parts)
        spread = hold(made.crossJoin(F.broadcast(shares)).repartitionById(parts * groups, place))
        widths = {"1": 1, "sqrt": int(np.ceil(np.sqrt(features)))}
        fits = [(widths[s], fold) for s in self.strategies for fold in range(-1, self.folds)]
        trees = grow(spread, fits, self.number, self.depth, features, groups)
        number, folds, choices = self.number, self.folds, range(len(self.strategies))

        def which(choice: int, fold: int) -> range:
            k = choice * (folds + 1) + fold + 1
            return range(k * number, (k + 1) * number)

        def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                # Every task of a part has its blocks, and judges some of them.
                for x, label, fold, _ in _arrays(frame[frame["number"] % groups == frame["group"]]):
                    for own in np.unique(fold):
                        at = np.flatnonzero(fold == own)
                        for choice in choices:
                            right = (trees.scores(which(choice, int(own)), x[at]) > 0.5) == (label[at] == 1)
                            cells = {"choice": [choice], "fold": [int(own)], "correct": [int(right.sum())]}
                            yield pd.DataFrame({**cells, "n": [len(at)]})

        judged = (
            spread.mapInPandas(judge, "choice int, fold int, correct bigint, n bigint")
            .groupBy("choice", "fold")
            .agg((F.sum("correct") / F.sum("n")).alias("accuracy"))
            .collect()
        )
        self.accuracy = []
        for choice in choices:
            own = [r.accuracy for r in sorted(judged, key=lambda r: r.fold) if r.choice == choice]
            self.accuracy.append(sum(own) / len(own) if own else 0.0)
        best = int(np.argmax(np.round(self.accuracy, 12)))
        spread.unpersist()
        return Forest(trees, which(best, -1), cuts, f"featureSubsetStrategy={self.strategies[best]}")
