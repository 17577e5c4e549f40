"""MinHash near-duplicates by an inverted join on signature coordinates.

A document's set are its distinct 4-word shingles (A-Z lower-cased, words split at ASCII white space; fewer
words than four are one shingle). Documents are linked when 100 x intersection >= 80 x union, and grouped by
connected components.

1. Documents with equal sets form one class, named by a 128-bit hash of the set; only classes go on, and
   keys come back at the end. So rows of one key with different texts are never mixed up.
2. Every class is posted under each (coordinate, value) of its MinHash signature. Classes of near copies
   collide in most coordinates, so at least ``MATCHES`` of ``COORDINATES`` are asked for: a linked pair
   falls below with a probability of 1.2e-6 at exactly 0.8 and far less above.
3. Prefix: values that occur once cannot match, and of a class with m shared values only the
   m - MATCHES + 1 rarest have to be posted for two matching classes to meet under one of them.
4. Skip: merging a posting list counts the collisions of its members by short sketches. First each member is
   compared with the first members under a few orders only; confirmed links contract classes into
   components, and lists whose members all lie in one component are skipped. What is left is merged in
   full, in pairs of bounded blocks, where pairs of different components that match are confirmed.
5. A pair is a link only if its full shingle sets say so; components follow by contraction along links.

No list, group of copies or component is gathered in one task, and of a group's pairs only links that join
components are emitted.

Defined results: a null, empty or blank text has an empty set, no links and is its own component; repeated
rows are equal documents; rows of one key with different texts are documents of their own, each in the
component of its text, but ``drop_copies`` drops a key's rows together as soon as one of them is a copy; rows
with a null key take part in no link and stay; texts may have any length; an empty table gives an empty
result; columns that clash with working names stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import map_rows, struct
from cohortlens.session import cut_lineage

SHINGLE = 4
LINK = 80
COORDINATES = 64
# Fewer equal coordinates than this have probability 1.2e-6 at a similarity of 0.8.
MATCHES = 35
# Members of a posting list that are compared with each other in one task.
BLOCK = 512
BLOCK_CHARS = 8_000_000
# Members of a list that all others are compared with before it is merged.
STARS = 4
BEST = 2
CACHE = 400_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_known = _Words()


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(ids))
    total = np.full(len(ids) - width + 1, width, np.uint64)
    for k in range(width):
        total ^= ids[k : k + len(total)]
        total *= _MIX
        total ^= total >> np.uint64(29)
    return np.unique(total)


def signature(found: np.ndarray) -> np.ndarray:
    """The smallest value of every coordinate's hash over a set."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        part = found[at : at + 2048, None] * _FACTORS
        part += _OFFSETS
        np.minimum(least, part.min(0), out=least)
    # Spread the values, which are all small, over 64 bits.
    least ^= least >> np.uint64(31)
    return least * _MIX


def linked(a: np.ndarray, b: np.ndarray, link: int = LINK) -> bool:
    if not len(a) or not len(b):
        return False
    if 100 * min(len(a), len(b)) < link * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= link * (len(a) + len(b) - both)


def sketch(sig: np.ndarray) -> bytes:
    """One byte per coordinate; unequal coordinates agree in 1 of 256 cases."""
    return (sig >> np.uint64(17)).astype(np.uint8).tobytes()


def sets(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, n, class, sig): size, 128-bit name and signature of every document's set."""

    def make():
        def compute(batch):
            out: dict[str, list] = {"n": [], "class": [], "sig": []}
            signed: dict[bytes, np.ndarray] = {}
            for value in batch.column("text").to_pylist():
                found = shingles(value, width)
                name = xxhash.xxh128_digest(found.tobytes()) if len(found) else None
                if name is not None and name not in signed:
                    signed[name] = signature(found).view(np.int64)
                out["n"].append(len(found))
                out["class"].append(name)
                out["sig"].append(signed.get(name))
            return out

        return compute

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return map_rows(rows, make, struct("n bigint, class binary, sig array<bigint>"), ["id"])


def postings(classes: DataFrame) -> DataFrame:
    """(value, node) of the prefixes: what a class has to be posted under to meet every match."""
    every = classes.select("node", F.explode("sig").alias("value"))
    shared = every.groupBy("value").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    held = every.join(shared, "value")
    values = F.sort_array(F.collect_list(F.struct("n", "value")))
    return (
        held.groupBy("node")
        .agg(values.alias("values"))
        .filter(F.size("values") >= MATCHES)
        .select("node", F.explode(F.expr(f"slice(values, 1, size(values) - {MATCHES - 1})")).alias("v"))
        .select(F.col("v.value").alias("value"), "node")
    )


def _texts(docs: DataFrame, key: str, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """(node, text, sketch) of posted classes, ``wanted`` with the smallest key of each.

    A row with that key but another set is passed over; texts with equal sets serve alike.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def make():
        def compute(batch):
            out: dict[str, list] = {"same": [], "sketch": []}
            for value, name in zip(batch.column("text").to_pylist(), batch.column("node").to_pylist()):
                found = shingles(value, width)
                same = len(found) > 0 and xxhash.xxh128_digest(found.tobytes()) == name
                out["same"].append(same)
                out["sketch"].append(sketch(signature(found)) if same else None)
            return out

        return compute

    read = rows.join(wanted, "id")
    read = map_rows(read, make, struct("same boolean, sketch binary"), ["node", "text"])
    return read.filter("same").drop("same").dropDuplicates(["node"])


def _sketches(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), COORDINATES)


def confirm(pairs: DataFrame, texts: DataFrame, width: int, link: int) -> DataFrame:
    """The pairs (a, b) that are linked on their full shingle sets."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def make():
        last: list = [None, None]

        def compute(batch):
            out = []
            columns = [batch.column(c).to_pylist() for c in ("a", "text_a", "text_b")]
            for node, text_a, text_b in zip(*columns):
                if last[0] != node:
                    last[:] = node, shingles(text_a, width)
                out.append(linked(last[1], shingles(text_b, width), link))
            return {"linked": out}

        return compute

    both = pairs.select("a", "b").join(b, "b").join(a, "a")
    found = map_rows(both, make, struct("linked boolean"), ["a", "b"])
    return found.filter("linked").select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link, by contraction along links in random order.

    In a round each node takes the first of itself and its neighbours, in an order that changes from round
    to round, and links are carried over to what their ends took. Minima are taken before the shuffle, so
    a node with very many links is no large group. Only whether links are left reaches the driver.
    """
    edges = cut_lineage(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    root = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    root = root.withColumn("root", F.col("node"))
    turn = 0
    while not edges.isEmpty():
        turn += 1

        def order(c: str, turn=turn):
            return F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("w"))

        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        taken = both.groupBy("u").agg(F.min(order("v")).alias("first"))
        taken = cut_lineage(
            taken.select("u", F.least("first", order("u"))["w"].alias("to"))
        )
        to_u = taken.select("u", F.col("to").alias("x"))
        to_v = taken.select(F.col("u").alias("v"), F.col("to").alias("y"))
        moved = edges.join(to_u, "u").join(to_v, "v").filter(F.col("x") != F.col("y"))
        edges = cut_lineage(
            moved.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        )
        root = root.join(taken.withColumnRenamed("u", "root"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root")
        )
    return root


def _star(posted: DataFrame) -> DataFrame:
    """Pairs of each list's members with its first under ``STARS`` orders, the best few of each member."""
    orders = [F.min(F.struct(F.xxhash64(F.lit(i), "node"), "node", "sketch")) for i in range(STARS)]
    first = (
        posted.groupBy("value")
        .agg(*[o.alias(f"f{i}") for i, o in enumerate(orders)], F.count("*").alias("n"))
        .filter(F.col("n") > 1)
        .select("value", F.array(*[f"f{i}" for i in range(STARS)]).alias("firsts"))
    )
    pairs = (
        posted.join(first, "value")
        .select("node", "sketch", F.explode("firsts").alias("f"))
        .filter(F.col("node") != F.col("f.node"))
        .select("node", F.col("f.node").alias("first"), "sketch", F.col("f.sketch").alias("other"))
        .dropDuplicates(["node", "first"])
    )

    def make():
        def compute(batch):
            same = _sketches(batch.column("sketch")) == _sketches(batch.column("other"))
            return {"matches": same.sum(1)}

        return compute

    counted = map_rows(pairs, make, struct("matches bigint"), ["node", "first"])
    # A member has STARS firsts in each of its lists at most.
    best = counted.filter(F.col("matches") >= MATCHES).groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("matches", "first")), asc=False).alias("m")
    )
    best = best.select("node", F.explode(F.slice("m", 1, BEST)).alias("m"))
    return best.select(
        F.least("node", "m.first").alias("a"), F.greatest("node", "m.first").alias("b")
    ).distinct()


def _meetings(posted: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """(main, x, y, side, node, root, sketch, text): which classes are compared with which.

    Lists within one component are skipped. Of every other list the largest component is its main one, and
    the remaining members are the others that meet it, whichever of its lists they come from. Both are cut
    into blocks of bounded rows and bytes. A meeting (main, x, y) compares block y of the others with block
    x >= 0 of the main component (and, for x = 0, within itself), or with block -1 - x of the others.
    """
    sizes = texts.select("node", F.length("text").alias("size"))
    labelled = sizes.join(roots, "node", "left").select(
        "node", "size", F.coalesce("root", "node").alias("root")
    )
    known = posted.select("value", "node").join(labelled, "node")
    parts = known.groupBy("value", "root").agg(F.count("*").alias("n"))
    lists = (
        parts.groupBy("value")
        .agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("parts"))
        .filter(F.col("parts") > 1)
        .select("value", "main")
    )
    others = (
        known.join(lists, "value")
        .filter(F.col("root") != F.col("main"))
        .select("main", "node", "root", "size")
        .distinct()
    )
    others = cut_lineage(others)
    mains = labelled.join(others.select(F.col("main").alias("root")).distinct(), "root")

    def blocks(n: str):
        count, size = F.count("*"), F.sum("size")
        return F.ceil(F.greatest(count / BLOCK, size / BLOCK_CHARS)).cast("int").alias(n)

    cut = mains.groupBy(F.col("root").alias("main")).agg(blocks("mains")).join(
        others.groupBy("main").agg(blocks("others")), "main"
    )

    def own(n: str):
        return F.pmod(F.xxhash64("node", F.lit(1)), F.greatest(F.col(n), F.lit(1))).cast("int")

    def meeting(x, y, side):
        return F.struct(x.alias("x"), y.alias("y"), side.alias("side"))

    zero, one = F.lit(0), F.lit(1)
    left = mains.withColumn("main", F.col("root")).join(cut, "main").select(
        "main", "node", "root", "others", own("mains").alias("b")
    ).select("main", "node", "root", F.explode(F.transform(
        F.sequence(zero, F.col("others") - 1), lambda y: meeting(F.col("b"), y, zero)
    )).alias("m"))
    right = others.join(cut, "main").select(
        "main", "node", "root", "mains", "others", own("others").alias("b")
    )
    with_main = F.transform(
        F.sequence(zero, F.col("mains") - 1), lambda x: meeting(x, F.col("b"), one)
    )
    with_others = F.transform(
        F.filter(F.sequence(zero, F.col("others") - 1), lambda z: z != F.col("b")),
        lambda z: meeting(
            -1 - F.least(z, F.col("b")), F.greatest(z, F.col("b")), (z < F.col("b")).cast("int")
        ),
    )
    right = right.select(
        "main", "node", "root", F.explode(F.concat(with_main, with_others)).alias("m")
    )
    met = left.unionByName(right).select("main", "m.*", "node", "root")
    return met.join(texts, "node")


class _Unions(dict):
    """Roots, by number, joined so far within one meeting."""

    def find(self, a: int) -> int:
        while (b := self.get(a, a)) != a:
            a = b
        return a


def meet(rows: list[tuple], self_too: bool, width: int, link: int) -> list[tuple[bytes, bytes]]:
    """Links between different components of one meeting; pairs that are joined already are passed over.

    ``rows`` holds (side, node, root, sketch, text). Collisions pick the candidates; their intersections
    are counted exactly, one class against all its candidates at a time.
    """
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    n = len(rows)
    side = np.array([r[0] for r in rows])
    number = {r: i for i, r in enumerate(dict.fromkeys(r[2] for r in rows))}
    root = np.array([number[r[2]] for r in rows], np.int64)
    marks = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(n, COORDINATES)
    first = int(np.searchsorted(side, 1))
    found = [None] * n
    joined, links = _Unions(), []

    def held(i: int) -> np.ndarray:
        if found[i] is None:
            found[i] = shingles(rows[i][4], width)
        return found[i]

    for i in range(first, n):
        # Everything on the other side, and what came before on the own one.
        to = np.arange(i if self_too else first)
        same = (marks[to] == marks[i]).sum(1)
        to = to[(same >= MATCHES) & (root[to] != root[i])]
        to = to[np.argsort(-same[to], kind="stable")]
        for at in range(0, len(to), 64):
            mine = joined.find(int(root[i]))
            part = [j for j in to[at : at + 64].tolist() if joined.find(int(root[j])) != mine]
            if not part:
                continue
            sets_ = [held(j) for j in part]
            sizes = np.array([len(x) for x in sets_])
            every = np.concatenate(sets_)
            place = np.minimum(np.searchsorted(held(i), every), len(held(i)) - 1)
            inside = held(i)[place] == every
            both = np.add.reduceat(inside, np.cumsum(sizes) - sizes, dtype=np.int64)
            good = 100 * both >= link * (sizes + len(held(i)) - both)
            for j in np.flatnonzero(good).tolist():
                a, b = joined.find(int(root[i])), joined.find(int(root[part[j]]))
                if a != b:
                    joined[max(a, b)] = min(a, b)
                    links.append((rows[i][1], rows[part[j]][1]))
    return links


def _merge(
    posted: DataFrame, roots: DataFrame, texts: DataFrame, width: int, link: int
) -> DataFrame:
    """Links (a, b) that join different components; the rows of a meeting arrive together, one by one."""
    key = ["main", "x", "y"]
    rows = _meetings(posted, roots, texts).repartition(*key).sortWithinPartitions(*key)

    def run(batches):
        current, held = None, []

        def flush():
            links = meet(held, current[1] == 0, width, link) if len(held) > 1 else []
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], names=["a", "b"]
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*key, "side", "node", "root", "sketch", "text")]
            for main, x, y, *row in zip(*columns):
                if (main, x, y) != current:
                    if held:
                        yield flush()
                    current = (main, x, y)
                held.append(tuple(row))
        if held:
            yield flush()

    return rows.mapInArrow(run, "a binary, b binary")


def group(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = SHINGLE,
    link: int = LINK,
) -> DataFrame:
    """(id, n, component): set size and the smallest key reachable by links, for every row.

    Nodes of the link graph are classes.
    """
    every = cut_lineage(sets(docs, key, text, width))
    named = every.filter(F.col("class").isNotNull() & F.col("id").isNotNull())
    classes = named.groupBy("class").agg(F.min(F.struct("id", "sig")).alias("f"))
    classes = classes.select(F.col("class").alias("node"), F.col("f.sig").alias("sig"))
    first = named.groupBy(F.col("class").alias("node")).agg(F.min("id").alias("id"))
    prefixes = cut_lineage(postings(classes))
    wanted = prefixes.select("node").distinct().join(first, "node")
    texts = cut_lineage(_texts(docs, key, text, width, wanted))
    posted = prefixes.join(texts.select("node", "sketch"), "node")
    star = cut_lineage(confirm(_star(posted), texts, width, link))
    roots = cut_lineage(components(star))
    rest = cut_lineage(_merge(posted, roots, texts, width, link))
    links = star.unionByName(rest)
    reached = components(links)
    smallest = reached.join(first, "node").groupBy("root").agg(F.min("id").alias("component"))
    found = reached.join(smallest, "root").select(F.col("node").alias("class"), "component")
    first = first.withColumnRenamed("node", "class")
    found = first.join(found, "class", "left").select(
        "class", F.coalesce("component", "id").alias("component")
    )
    return every.join(found, "class", "left").select(
        "id", "n", F.coalesce("component", "id").alias("component")
    )


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Set size, component and verdict of every document."""
    return group(docs, key, text).select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component stays, the one of the smallest key."""
    gone = group(docs, key, text).filter(F.col("id") != F.col("component"))
    return docs.join(gone.select(F.col("id").alias(key)), key, "left_anti").select(*docs.columns)
