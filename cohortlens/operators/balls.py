"""Exact nearest vectors with metric pruning.

Equal vectors are one point. A tree of cuts, drawn from a bounded sample, sends points to about sqrt(n) balls (more
where these would exceed a block), each with the box of coordinates its points really fill, and each ball is cut
into blocks of bounded size. A point first meets the points of its own block, which bounds the distance
of its k-th neighbour; it is then sent only to balls whose box comes nearer than that bound. Boxes part values
that few points share, such as categories, also where one wide coordinate rules the distances. Nothing is sampled
or capped: on vectors without structure all balls are opened, and the cost is that of comparing all blocks with
each other.

What passes the driver is one row per ball; the sample and the boxes stay below ``PIVOT_BYTES`` each.
"""

from __future__ import annotations

import heapq
import math
import threading
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import cut_lineage

BLOCK_POINTS = 1024
PIVOT_BYTES = 32_000_000
# Points of the sample for every ball, and at least.
SAMPLE_EACH, SAMPLE_LEAST = 32, 8192
STEP_CELLS = 4_000_000


class Search(NamedTuple):
    """Neighbours of classes of equal vectors, and what was opened to find them."""

    classes: DataFrame
    found: DataFrame
    visits: DataFrame
    balls: int


def _usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def _classes(df: DataFrame, key: str, vector: str, wanted: Column, k: int) -> DataFrame:
    """Distinct vectors with their ``k`` + 1 smallest keys, and whether any row of theirs is asked for.

    More keys of a class cannot be among ``k`` neighbours. Rows beyond them leave before the shuffle.
    """
    rows = df.filter(_usable(vector)).select(
        F.col(key).alias("_key"), F.col(vector).alias("_vector"), wanted.alias("_wanted")
    )
    asked = rows.groupBy("_vector").agg(F.max("_wanted").alias("_wanted"))
    first = Window.partitionBy("_vector").orderBy("_key")
    few = rows.select("_vector", "_key").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1)
    keys = few.groupBy("_vector").agg(F.sort_array(F.collect_list("_key")).alias("_keys"))
    return keys.join(asked, "_vector").withColumn("_id", F.col("_keys")[0])


class Cuts(NamedTuple):
    """A tree of cuts: node i sends a vector whose coordinate ``axis`` is up to ``at`` to ``low``, others to ``high``.

    Below 0 is a ball, -1 - its number.
    """

    axis: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    balls: int

    def place(self, x: np.ndarray) -> np.ndarray:
        node = np.full(len(x), 0 if len(self.axis) else -1)
        while (on := np.flatnonzero(node >= 0)).size:
            here = node[on]
            node[on] = np.where(x[on, self.axis[here]] <= self.at[here], self.low[here], self.high[here])
        return -1 - node


def _halves(x: np.ndarray):
    """Axis and value that cut the rows of ``x`` in two parts about equal, across the widest spread; None if all agree."""
    for axis in np.argsort(-x.var(0), kind="stable"):
        values = np.sort(x[:, axis])
        middle = values[(len(values) - 1) // 2]
        if middle == values[-1]:
            smaller = values[values < middle]
            if not smaller.size:
                continue
            middle = smaller[-1]
        return int(axis), float(middle)
    return None


def _sample(points: DataFrame, n: int, width: int) -> np.ndarray:
    """The first ``n`` vectors in the order of their hash; they reach the driver as bytes, not as rows of numbers."""

    def pack(frames):
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"x": [np.stack(frame["_vector"]).astype(float).tobytes()]})

    picked = points.orderBy(F.xxhash64("_id"), "_id").select("_vector").limit(n)
    held = [np.frombuffer(r["x"]) for r in picked.mapInPandas(pack, "x binary").collect()]
    return np.concatenate(held or [np.zeros(0)]).reshape(-1, width)


# Searches made side by side draw their cuts one after the other, so the driver holds one sample.
_ONE = threading.Lock()


def _cuts(points: DataFrame, n: int, width: int) -> Cuts:
    with _ONE:
        return _drawn_cuts(points, n, width)


def _drawn_cuts(points: DataFrame, n: int, width: int) -> Cuts:
    """Cuts through a sample of points, the first in the order of their hash; the fullest ball is cut next."""
    most = max(1, PIVOT_BYTES // (16 * max(width, 1)))
    wanted = min(max(math.isqrt(n), -(-n // BLOCK_POINTS)), most)
    x = _sample(points, min(2 * most, max(SAMPLE_EACH * wanted, SAMPLE_LEAST)), width)
    nodes: list[list] = []
    # (-size, number, rows, node and side it hangs on)
    open_, balls, number = [(-len(x), 0, np.arange(len(x)), None)], [], 0
    while open_ and len(open_) + len(balls) < wanted:
        size, at, rows, link = heapq.heappop(open_)
        cut = _halves(x[rows])
        if cut is None:
            balls.append((size, at, rows, link))
            continue
        low = x[rows, cut[0]] <= cut[1]
        if link:
            nodes[link[0]][link[1]] = len(nodes)
        for side, part in ((2, rows[low]), (3, rows[~low])):
            number += 1
            heapq.heappush(open_, (-len(part), number, part, (len(nodes), side)))
        nodes.append([*cut, 0, 0])
    balls += open_
    for i, (_, _, _, link) in enumerate(balls):
        if link:
            nodes[link[0]][link[1]] = -1 - i
    axis, at, low, high = (np.array([v[i] for v in nodes], float if i == 1 else int) for i in range(4))
    return Cuts(axis, at, low, high, len(balls))


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` and ``y``."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T), 0.0)


def _steps(n: int, width: int):
    size = max(1, STEP_CELLS // max(width, 1))
    return (slice(at, at + size) for at in range(0, n, size))


def _place(points: DataFrame, cuts: Cuts) -> DataFrame:
    """Add each point's ball."""

    def place(frames):
        for frame in frames:
            if len(frame):
                yield frame.assign(_ball=cuts.place(np.stack(frame["_vector"])).astype("int32"))

    schema = points.schema.simpleString()[len("struct<") : -1]
    return points.mapInPandas(place, f"{schema},_ball:int")


def _nearest(x: np.ndarray, y: np.ndarray, same: np.ndarray | None, k: int):
    """Positions in ``y`` and squared distances of the ``k`` nearest, ties by position; -1 where none."""
    at = np.full((len(x), k), -1)
    gaps = np.full((len(x), k), np.inf)
    for part in _steps(len(x), len(y)):
        gap = np.round(_gaps(x[part], y), 9)
        if same is not None:
            gap[np.arange(len(gap)), same[part]] = np.inf
        order = np.argsort(gap, axis=1, kind="stable")[:, :k]
        chosen = np.take_along_axis(gap, order, 1)
        at[part, : order.shape[1]] = np.where(np.isfinite(chosen), order, -1)
        gaps[part, : order.shape[1]] = chosen
    return at, gaps


def _sides(x: np.ndarray, low: np.ndarray, high: np.ndarray, far: bool = False) -> np.ndarray:
    """Distances of all rows of ``x`` from the nearest points of all boxes, or from their farthest corners."""
    total = np.zeros((len(x), len(low)))
    for i in range(x.shape[1]):
        v, a, b = x[:, i, None], low[None, :, i], high[None, :, i]
        side = np.maximum(np.abs(v - a), np.abs(v - b)) if far else np.maximum(np.maximum(a - v, v - b), 0.0)
        total += side * side
    return np.sqrt(total)


def _opened(x: np.ndarray, bound: np.ndarray, low, high, sizes, k: int) -> list[np.ndarray]:
    """Balls that may hold one of the ``k`` nearest, given squared distances not to be exceeded."""
    # Rounded and cancelled digits of a squared distance must not close a ball.
    corner = np.maximum(np.abs(low), np.abs(high))[sizes > 0].max(0)
    slack = 1e-4 + 1e-6 * (np.sqrt((x * x).sum(1)) + np.sqrt((corner * corner).sum()))
    limit = np.sqrt(bound)
    # Where the own block is too small for a bound, the far sides of the balls give one.
    for part in _steps(len(x), len(low)):
        loose = np.flatnonzero(np.isinf(limit[part])) + part.start
        if len(loose):
            reach = _sides(x[loose], low, high, far=True)
            order = np.argsort(reach, axis=1, kind="stable")
            enough = np.cumsum(sizes[order], axis=1) >= k + 1
            reach = np.take_along_axis(reach, order, 1)
            limit[loose] = np.where(enough.any(1), reach[np.arange(len(loose)), enough.argmax(1)], np.inf)
    limit = limit + slack
    # Balls out of reach of all rows leave first, by the box of the rows.
    gap = np.maximum(np.maximum(low - x.max(0), x.min(0) - high), 0.0)
    near = np.flatnonzero(np.sqrt((gap * gap).sum(1)) <= limit.max())
    found = []
    for part in _steps(len(x), len(near)):
        away = _sides(x[part], low[near], high[near])
        found += [near[row].astype("int32") for row in away <= limit[part, None]]
    return found


def search(df: DataFrame, key: str, vector: str, k: int, wanted: Column) -> Search:
    """The ``k`` nearest other classes of every class that is asked for: (_id, _other, _gap)."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    classes = cut_lineage(_classes(df, key, vector, wanted, k))
    points = classes.select("_id", "_vector", "_wanted")
    size = points.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("_vector")).alias("width"), F.min(F.size("_vector")).alias("least")
    ).first()
    if size["width"] != size["least"]:
        raise ValueError("vectors must have one length")
    if not size["n"]:
        empty = spark.createDataFrame([], f"_id {kind}, _other {kind}, _gap double")
        return Search(classes, empty, spark.createDataFrame([], f"_id {kind}, _opened array<int>"), 0)
    cuts = _cuts(points, size["n"], size["width"])
    placed = cut_lineage(_place(points, cuts))
    ends = [f(F.col("_vector")[i]) for i in range(size["width"]) for f in (F.min, F.max)]
    held = placed.groupBy("_ball").agg(F.count(F.lit(1)).alias("n"), F.array(*ends).alias("ends")).collect()
    # A ball that the sample met but no point lies in is never opened.
    low, high = np.full((cuts.balls, size["width"]), np.inf), np.full((cuts.balls, size["width"]), np.inf)
    sizes = np.zeros(cuts.balls, int)
    for row in held:
        low[row["_ball"]], high[row["_ball"]] = row["ends"][::2], row["ends"][1::2]
        sizes[row["_ball"]] = row["n"]
    blocks = spark.createDataFrame(
        [(r["_ball"], -(-r["n"] // BLOCK_POINTS)) for r in held], "_ball int, _blocks int"
    )
    placed = placed.join(F.broadcast(blocks), "_ball").withColumn(
        "_block", F.pmod(F.xxhash64("_id"), "_blocks").cast("int")
    ).drop("_blocks")

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_id", ignore_index=True)
        asked = np.flatnonzero(rows["_wanted"])
        y = np.stack(rows["_vector"])
        if not len(asked):
            return pd.DataFrame(columns=names)
        at, gaps = _nearest(y[asked], y, asked, k)
        ids = rows["_id"].to_numpy()
        return pd.DataFrame(
            {
                "_id": ids[asked],
                "_vector": rows["_vector"].to_numpy()[asked],
                "_ball": rows["_ball"].to_numpy()[asked],
                "_block": rows["_block"].to_numpy()[asked],
                "_others": pd.Series([ids[a[a >= 0]].tolist() for a in at], dtype=object),
                "_gaps": pd.Series([g[a >= 0] for a, g in zip(at, gaps)], dtype=object),
                "_opened": pd.Series(_opened(y[asked], gaps[:, k - 1], low, high, sizes, k), dtype=object),
            }
        )

    near = f"_id {kind}, _vector array<double>, _ball int, _block int, _others array<{kind}>, _gaps array<double>, _opened array<int>"
    names = ["_id", "_vector", "_ball", "_block", "_others", "_gaps", "_opened"]
    first = cut_lineage(placed.groupBy("_ball", "_block").applyInPandas(own, near))
    at_home = first.select("_id", F.explode(F.arrays_zip("_others", "_gaps")).alias("n")).select(
        "_id", F.col("n._others").alias("_other"), F.col("n._gaps").alias("_gap")
    )

    # Guests of a ball come in chunks of bounded size; a block meets each chunk in a group of its own.
    guests = first.select(
        "_id", "_vector", F.col("_ball").alias("_home"), F.col("_block").alias("_room"), F.explode("_opened").alias("_ball")
    )
    numbers = guests.groupBy("_ball").agg(F.count(F.lit(1)).alias("n"))
    plan = spark.createDataFrame(
        [(r["_ball"], -(-r["n"] // BLOCK_POINTS), -(-int(sizes[r["_ball"]]) // BLOCK_POINTS)) for r in numbers.collect()],
        "_ball int, _chunks int, _blocks int",
    )
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    sent = (
        guests.join(F.broadcast(plan), "_ball")
        .withColumn("_chunk", F.pmod(F.xxhash64("_id", F.lit(1)), "_chunks").cast("int"))
        .withColumn("_block", upto("_blocks"))
        .filter((F.col("_ball") != F.col("_home")) | (F.col("_block") != F.col("_room")))
        .select("_ball", "_block", "_chunk", "_id", "_vector")
    )
    hosts = (
        placed.select("_ball", "_block", "_id", "_vector")
        .join(F.broadcast(plan), "_ball")
        .withColumn("_chunk", upto("_chunks"))
        .drop("_chunks", "_blocks")
    )

    def meet(asking: pd.DataFrame, hosting: pd.DataFrame) -> pd.DataFrame:
        if asking.empty or hosting.empty:
            return pd.DataFrame(columns=["_id", "_other", "_gap"])
        hosting = hosting.sort_values("_id")
        at, gaps = _nearest(np.stack(asking["_vector"]), np.stack(hosting["_vector"]), None, k)
        i, j = np.nonzero(at >= 0)
        return pd.DataFrame(
            {
                "_id": asking["_id"].to_numpy()[i],
                "_other": hosting["_id"].to_numpy()[at[i, j]],
                "_gap": gaps[i, j],
            }
        )

    group = ["_ball", "_block", "_chunk"]
    away = (
        sent.groupBy(*group)
        .cogroup(hosts.groupBy(*group))
        .applyInPandas(meet, f"_id {kind}, _other {kind}, _gap double")
    )
    best = Window.partitionBy("_id").orderBy("_gap", "_other")
    found = (
        at_home.unionByName(away)
        .withColumn("_n", F.row_number().over(best))
        .filter(F.col("_n") <= k)
        .drop("_n")
    )
    return Search(classes, found, first.select("_id", "_opened"), cuts.balls)


def nearest_vectors(
    df: DataFrame, key: str, vector: str, k: int, wanted: str | None = None
) -> DataFrame:
    """The ``k`` nearest rows by Euclidean distance: (key, neighbour, distance2, rank).

    ``vector`` is an array of doubles, all of one length. Squared distances are compared at nine decimals,
    ties go to the smaller key. With ``wanted`` (a boolean column) only those rows get neighbours. Rows whose
    vector is null or holds null or non-finite components take no part. ``key`` identifies a row.
    """
    asked = F.coalesce(F.col(wanted), F.lit(False)) if wanted else F.lit(True)
    made = search(df, key, vector, k, asked)
    keys = made.classes.select(F.col("_id").alias("_other"), "_keys")
    others = made.found.join(keys, "_other").select("_id", "_gap", F.explode("_keys").alias("_neighbour"))
    mine = made.classes.filter("_wanted").select(
        "_id", F.lit(0.0).alias("_gap"), F.explode("_keys").alias("_neighbour")
    )
    # k + 1 of a class's list are enough for each of its rows, which leaves itself out.
    best = Window.partitionBy("_id").orderBy("_gap", "_neighbour")
    lists = (
        mine.unionByName(others)
        .withColumn("_n", F.row_number().over(best))
        .filter(F.col("_n") <= k + 1)
        .groupBy("_id")
        .agg(F.sort_array(F.collect_list(F.struct("_gap", "_neighbour"))).alias("_list"))
    )
    named = made.classes.filter("_wanted").select("_vector", "_id").join(lists, "_id")
    rows = df.filter(_usable(vector)).filter(asked).select(
        F.col(key).alias("key"), F.col(vector).alias("_vector")
    )
    left = F.slice(F.filter("_list", lambda x: x["_neighbour"] != F.col("key")), 1, k)
    return (
        rows.join(named, "_vector")
        .select("key", F.posexplode(left).alias("_n", "_l"))
        .select(
            "key",
            F.col("_l._neighbour").alias("neighbour"),
            F.col("_l._gap").alias("distance2"),
            (F.col("_n") + 1).alias("rank"),
        )
    )
