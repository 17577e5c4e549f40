"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes smallest distance: vectors are split into bands whose norms differ by a factor
of ``BAND`` at most, scaled by the largest norm of their band, and get one more component that brings each to
length 1; queries are scaled to length 1. A table hashes by ``PROJECTIONS`` Gaussian projections cut into
cells of ``WIDTH``. In each band a query visits its own bucket and the perturbed buckets of the highest
estimated success, in that order, up to ``PROBES`` in each of ``TABLES`` tables. All candidates are ranked by
their exact inner product with the original vectors, and the candidates of all tables and bands are merged.

The score of the (k + 1)-th key found so far bounds from below what any key that is still missing must reach.
Every query is first compared with the ``HEAD`` longest vectors, and visits only bands that can reach that
score. After the tables the bound gives, for each band, the largest distance a missing neighbour can have and
so the probability that the buckets visited held it. Where this is below ``RECALL``, and for queries that
found fewer than k + 1 keys, the query is compared with all vectors of the band, block by block. So each true
neighbour is found with a probability of ``RECALL`` at least, over the draw of the projections, whatever the
norms are.

Buckets of any size are split into blocks of bounded vectors and queries. Equal vectors are one candidate
with its smallest keys, as more than k + 1 of them can never be needed.

Defined results: vectors that are null, empty or zero, hold null or non-finite components, or have another
length than most, take no part, neither as queries nor as candidates; a key that occurs in several rows has
several vectors, of which the nearest counts, and is never its own neighbour; ties go to the smaller key; an
empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import struct
from cohortlens.session import cut_lineage

K = 20
TABLES = 4
PROJECTIONS = 5
WIDTH = 2.0
PROBES = 30
RECALL = 0.9
BAND = 2**0.5
HEAD = 256
SEED = 5
BLOCK = 4096
QUERY_BLOCK = 1024


class Hashes:
    """The projections of all tables, and buckets and probes by them."""

    def __init__(self, dimension: int, tables: int, projections: int, width: float, probes: int):
        random = np.random.default_rng(SEED)
        self.tables, self.projections, self.probes = tables, projections, probes
        self.width = width
        self.lines = random.standard_normal((dimension + 1, tables * projections)) / width
        self.shifts = random.uniform(0, 1, tables * projections)
        self.mix = random.integers(1, 1 << 62, projections + 1, dtype=np.int64) * 2 + 1

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, tables, projections): where each vector lies, in cells."""
        at = vectors @ self.lines + self.shifts
        return at.reshape(len(vectors), self.tables, self.projections)

    def keys(self, cells: np.ndarray, table: int, band: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            own = np.asarray(band, np.int64) * self.tables + table + 1
            mixed = (cells.astype(np.int64) * self.mix[:-1]).sum(-1) + own * self.mix[-1]
            return mixed ^ (mixed >> 29)

    def perturbations(self, rest: np.ndarray) -> np.ndarray:
        """The ``probes`` cell offsets of the smallest squared way to go, the own bucket first."""
        m = self.projections
        ways = sorted(
            [(x * x, j, -1) for j, x in enumerate(rest.tolist())]
            + [((1 - x) ** 2, j, 1) for j, x in enumerate(rest.tolist())]
        )
        cost = [w[0] for w in ways]
        found, heap = [()], [(cost[0], (0,))]
        while heap and len(found) < self.probes:
            total, chosen = heapq.heappop(heap)
            if len({ways[i][1] for i in chosen}) == len(chosen):
                found.append(chosen)
            last = chosen[-1]
            if last + 1 < len(ways):
                heapq.heappush(
                    heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1))
                )
                heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
        out = np.zeros((len(found), m), np.int64)
        for row, chosen in enumerate(found):
            for i in chosen:
                out[row, ways[i][1]] = ways[i][2]
        return out

    def success(self, rest: np.ndarray, offsets: list[np.ndarray], distance: float) -> float:
        """The probability that a vector so far from a query lies in a bucket the query visits.

        ``rest`` (tables, projections) is where the query lies in its cells, ``offsets`` has the visited cells
        of each table. The way along a projection is normal with a deviation of ``distance / width``, whatever
        ``rest`` is, as the shifts are uniform.
        """
        scale = self.width / (max(distance, 1e-12) * 2**0.5)
        missed = 1.0
        for t in range(self.tables):
            edges = (np.arange(-1, 3)[:, None] - rest[t]) * scale
            below = np.array([math.erf(x) for x in edges.ravel().tolist()]).reshape(edges.shape) / 2
            within = below[1:] - below[:-1]
            held = within[offsets[t] + 1, np.arange(self.projections)].prod(1).sum()
            missed *= 1 - min(1.0, held)
        return 1 - missed


def vectors(rows: DataFrame, key: str, embedding: str) -> DataFrame:
    """(id, name, vec): the vectors that take part, as doubles, and a 128-bit name of each."""
    given = rows.select(
        F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")
    )
    usable = (
        F.col("id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    given = given.filter(usable)

    def name(batches):
        for batch in batches:
            lists = batch.column("v")
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False) + 0.0
            parts = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([xxhash.xxh128_digest(p) for p in parts], pa.binary()),
                    pa.array(parts, pa.binary()),
                ],
                names=["id", "name", "vec"],
            )

    return given.mapInArrow(name, "id bigint, name binary, vec binary")


def _matrix(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def _norms(found: np.ndarray) -> np.ndarray:
    """Lengths of rows other than zero, without overflow on the way."""
    most = np.abs(found).max(1)
    return most * np.sqrt(((found / most[:, None]) ** 2).sum(1))


def _post(points: DataFrame, hashes: Hashes, bands: dict[int, float]) -> DataFrame:
    """(bucket, name, ids, vec): each candidate under its bucket of every table, by its band."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            band = batch.column("band").to_numpy()
            found = _matrix(batch.column("vec")) / np.array([bands[b] for b in band.tolist()])[:, None]
            more = np.sqrt(np.maximum(0, 1 - (found * found).sum(1)))
            cells = np.floor(hashes.places(np.column_stack((found, more))))
            for t in range(hashes.tables):
                keys = pa.array(hashes.keys(cells[:, t], t, band))
                yield pa.RecordBatch.from_arrays(
                    [keys, *[batch.column(c) for c in ("name", "ids", "vec")]],
                    names=["bucket", "name", "ids", "vec"],
                )

    return points.mapInArrow(run, "bucket bigint, name binary, ids array<bigint>, vec binary")


def _located(batch: pa.RecordBatch, hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Norms of a batch of queries, their cells, and where they lie in these."""
    found = _matrix(batch.column("vec"))
    norms = _norms(found)
    places = hashes.places(np.column_stack((found / norms[:, None], np.zeros(len(found)))))
    cells = np.floor(places)
    return norms, cells, places - cells


def _reaching(norm: float, floor: float | None, bands: dict[int, float]) -> list[int]:
    """The bands with room for a vector whose product with a query of that norm is ``floor`` or more."""
    if floor is None:
        return list(bands)
    return [b for b, most in bands.items() if norm * most * (1 + 1e-9) >= floor]


def _probe(queries: DataFrame, hashes: Hashes, bands: dict[int, float]) -> DataFrame:
    """(bucket, name, vec): each query under the buckets it visits in the bands that reach its floor."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            norms, cells, rest = _located(batch, hashes)
            for i, floor in enumerate(batch.column("floor").to_pylist()):
                reached = np.array(_reaching(norms[i], floor, bands), np.int64)
                keys = []
                for t in range(hashes.tables):
                    visited = cells[i, t] + hashes.perturbations(rest[i, t])
                    keys.append(np.unique(hashes.keys(visited[None], t, reached[:, None])))
                keys = np.concatenate(keys)
                rows = pa.array(np.full(len(keys), i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), *[batch.column(c).take(rows) for c in ("name", "vec")]],
                    names=["bucket", "name", "vec"],
                )

    return queries.mapInArrow(run, "bucket bigint, name binary, vec binary")


def _unsure(queries: DataFrame, hashes: Hashes, bands: dict[int, float], recall: float) -> DataFrame:
    """(bucket, name, vec): each query under the bands that may hold a neighbour its buckets held too rarely."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            norms, _, rest = _located(batch, hashes)
            keys, rows = [], []
            for i, floor in enumerate(batch.column("floor").to_pylist()):
                open_bands = _reaching(norms[i], floor, bands)
                if floor is not None:
                    offsets = [hashes.perturbations(rest[i, t]) for t in range(hashes.tables)]
                    open_bands = [
                        b
                        for b in open_bands
                        if hashes.success(
                            rest[i], offsets, math.sqrt(max(0.0, 2 - 2 * (floor / norms[i]) / bands[b]))
                        )
                        < recall
                    ]
                keys += open_bands
                rows += [i] * len(open_bands)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), *[batch.column(c).take(at) for c in ("name", "vec")]],
                names=["bucket", "name", "vec"],
            )

    return queries.mapInArrow(run, "bucket bigint, name binary, vec binary")


def nearest(
    query: list[tuple[bytes, bytes]], point: list[tuple[list[int], bytes]], k: int
) -> list[tuple[bytes, int, float]]:
    """(query, key, score) of each query's k + 1 best keys within one block, exact scores."""
    p = np.frombuffer(b"".join(v for _, v in point), np.float64).reshape(len(point), -1)
    q = np.frombuffer(b"".join(v for _, v in query), np.float64).reshape(len(query), -1)
    first = np.array([ids[0] for ids, _ in point], np.int64)
    about = q @ p.T
    take = k + 1
    out = []
    for i, (name, _) in enumerate(query):
        row = about[i]
        if len(row) > take:
            # A little below the last place, so that rounding in the product drops nobody.
            edge = np.partition(row, len(row) - take)[len(row) - take]
            near = np.flatnonzero(row >= edge - 1e-9 * (1 + abs(edge)))
        else:
            near = np.arange(len(row))
        score = (p[near] * q[i]).sum(1)
        order = np.lexsort((first[near], -score))[:take]
        found = [(-score[j], key) for j in order.tolist() for key in point[near[j]][0]]
        found.sort()
        out += [(name, key, -s) for s, key in found[:take]]
    return out


def _rank(posted: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """(name, vec_id, score): each query's best in every block of the buckets it visits."""
    sizes = posted.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts"))
    asked = probes.groupBy("bucket").agg(
        F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_cuts")
    )
    cuts = cut_lineage(sizes.join(asked, "bucket"))

    def own(n: str) -> Column:
        return F.pmod(F.xxhash64("name"), F.col(n)).cast("int")

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = posted.join(cuts, "bucket").select(
        "bucket", own("cuts").alias("x"), each("query_cuts").alias("y"), F.lit(0).alias("side"), "name", "ids", "vec"
    )
    right = probes.join(cuts, "bucket").select(
        "bucket", each("cuts").alias("x"), own("query_cuts").alias("y"), F.lit(1).alias("side"), "name",
        F.lit(None).cast("array<bigint>").alias("ids"), "vec",
    )
    key = ["bucket", "x", "y"]
    rows = left.unionByName(right).repartition(*key).sortWithinPartitions(*key, "side")

    def run(batches):
        current, points, queries = None, [], []

        def flush():
            found = nearest(queries, points, k) if points and queries else []
            points.clear()
            queries.clear()
            return _found_batch(found)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*key, "side", "name", "ids", "vec")]
            for bucket, x, y, side, name, ids, vec in zip(*columns):
                if (bucket, x, y) != current:
                    if queries:
                        yield flush()
                    points.clear()
                    current = (bucket, x, y)
                if side:
                    queries.append((name, vec))
                else:
                    points.append((ids, vec))
        if queries:
            yield flush()

    return rows.mapInArrow(run, "name binary, vec_id bigint, score double")


def _head(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(name, vec_id, score): each query's best of the longest vectors, which every task holds."""
    rows = points.orderBy(F.desc("norm"), "name").limit(max(HEAD, k + 1)).select("ids", "vec").collect()
    longest = [(r.ids, bytes(r.vec)) for r in rows]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                names, vecs = part.column("name").to_pylist(), part.column("vec").to_pylist()
                yield _found_batch(nearest(list(zip(names, vecs)), longest, k))

    return queries.mapInArrow(run, "name binary, vec_id bigint, score double")


def _floors(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(name, vec, floor): the score of the (k + 1)-th key found, null where fewer are found."""
    floors = found.groupBy("name").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floor = F.when(F.col("n") > k, F.col("least")).alias("floor")
    return queries.join(floors, "name", "left").select("name", "vec", floor)


def _found_batch(found: list[tuple[bytes, int, float]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([f[0] for f in found], pa.binary()),
            pa.array([f[1] for f in found], pa.int64()),
            pa.array([f[2] for f in found], pa.float64()),
        ],
        names=["name", "vec_id", "score"],
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    """Each query vector's k + 1 best keys of all tables and blocks."""
    order = Window.partitionBy("name").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("name", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("at", F.row_number().over(order))
        .filter(F.col("at") <= k + 1)
        .drop("at")
    )


def search(
    rows: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    embedding: str = "embedding",
    k: int = K,
    tables: int = TABLES,
    projections: int = PROJECTIONS,
    width: float = WIDTH,
    probes: int = PROBES,
    recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query row.

    ``is_query`` is a condition on a column ``id``, the key as a long. ``recall`` is the least probability
    that a neighbour is found; above 1 all bands that can hold one are compared in full.
    """
    every = cut_lineage(vectors(rows, key, embedding))
    lengths = every.groupBy(F.length("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return rows.sparkSession.createDataFrame(
            [], "query_id bigint, rank int, vec_id bigint, score double"
        )
    every = every.filter(F.length("vec") == lengths.n)
    smallest = Window.partitionBy("name").orderBy("id")
    points = (
        every.withColumn("at", F.row_number().over(smallest))
        .filter(F.col("at") <= k + 1)
        .groupBy("name")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min("vec").alias("vec"))
    )
    points, bands = _banded(points)
    asked = every.filter(is_query).select(F.col("id").alias("query_id"), "name", "vec")
    queries = cut_lineage(asked.dropDuplicates(["name"]).select("name", "vec"))
    hashes = Hashes(lengths.n // 8, tables, projections, width, probes)
    found = cut_lineage(_head(queries, points, k))
    probing = _probe(_floors(queries, found, k), hashes, bands)
    ranked = _rank(_post(points, hashes, bands), probing, k)
    found = cut_lineage(_best(found.unionByName(ranked), k))
    # The exact way for bands whose buckets may have held too few of a query's neighbours.
    unsure = cut_lineage(_unsure(_floors(queries, found, k), hashes, bands, recall))
    if not unsure.isEmpty():
        whole = points.select(F.col("band").alias("bucket"), "name", "ids", "vec")
        found = _best(found.unionByName(_rank(whole, unsure, k)), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.select("query_id", "name")
        .distinct()
        .join(found, "name")
        .filter(F.col("vec_id") != F.col("query_id"))
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _banded(points: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """The candidates with norm and band, and each band's largest norm; band 0 starts at the largest of all."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                norms = pa.array(_norms(_matrix(batch.column("vec"))))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in ("name", "ids", "vec")], norms],
                    names=["name", "ids", "vec", "norm"],
                )

    measured = points.mapInArrow(run, "name binary, ids array<bigint>, vec binary, norm double")
    measured = cut_lineage(measured)
    top = math.log2(measured.agg(F.max("norm")).first()[0])
    band = F.floor((F.lit(top) - F.log2("norm")) / math.log2(BAND)).cast("long")
    measured = measured.withColumn("band", F.greatest(band, F.lit(0).cast("long")))
    # The range of a double has room for 4,200 bands.
    most = measured.groupBy("band").agg(F.max("norm").alias("most")).collect()
    return measured, {r.band: r.most for r in sorted(most, key=lambda r: r.band)}
