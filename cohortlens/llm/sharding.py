"""Sharding by Karmarkar-Karp differencing: byte-balanced shards of indivisible groups.

Equal texts form a group that is never split. Differencing starts with one partial partition per item and
repeatedly combines the two with the largest spread, the largest bin of one with the smallest of the other.
It is a sequential method, so it runs over a bounded number of items: a group of at least a 1/``packets``
share of all bytes is an item of its own (there are at most ``packets`` of these), all other groups are
hashed into ``packets`` packets. However large the input, one task differences at most 2 x ``packets``
items; with fewer groups than packets nearly every item is a single group. Packets shrink in proportion to
a shard as ``packets`` grows, and differencing cancels what they differ by.

Defined results: a null text has no bytes and shares the group of the empty text; its CRC is that of no
bytes; texts may have any length; repeated rows and repeated keys are rows of their own; an empty table gives
an empty result; other columns, whatever their names, are not read. Slots number the rows of a shard from 0 without gaps.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import cut_lineage

SHARDS = 40
OVERHEAD = 16
PACKETS = 8192
# Rows of one shard that are numbered in one task, on average over shards of equal counts.
SLOT_BLOCK = 200_000


def difference(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every item, by multi-way Karmarkar-Karp differencing."""
    n = len(sizes)
    if n == 0:
        return np.empty(0, np.int32)
    # A partial partition is a row of bin totals in ascending order. left[i] and right[i] are the two that
    # were combined into i, order[i] says which bin of either went where.
    total = {i: np.concatenate((np.zeros(shards - 1, np.int64), [s])) for i, s in enumerate(sizes)}
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        bins = total.pop(a) + total.pop(b)[::-1]
        order = np.argsort(bins, kind="stable").astype(np.int32)
        bins = bins[order]
        new = n + len(merged)
        total[new] = bins
        merged.append((a, b, order))
        heapq.heappush(heap, (-int(bins[-1] - bins[0]), new))
    # Downwards: where does each bin of a partial partition end up?
    place = {heap[0][1]: np.arange(shards, dtype=np.int32)}
    shard = np.zeros(n, np.int32)
    for i in range(len(merged) - 1, -1, -1):
        a, b, order = merged[i]
        at = np.empty(shards, np.int32)
        at[order] = place.pop(n + i)
        place[a], place[b] = at, at[::-1]
    for i, at in place.items():
        shard[i] = at[-1]
    return shard


def shard(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shards: int = SHARDS,
    packets: int = PACKETS,
    slot_block: int = SLOT_BLOCK,
) -> DataFrame:
    """Key, size, CRC, shard and slot of every row."""
    value = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(value) + OVERHEAD).cast("long")
    rows = cut_lineage(
        docs.select(
            F.col(key),
            size.alias("size"),
            F.crc32(F.encode(value, "UTF-8")).alias("text_crc32"),
            F.unhex(F.md5(F.encode(value, "UTF-8"))).alias("_group"),
        )
    )
    groups = rows.groupBy("_group").agg(F.sum("size").alias("bytes"))
    count, total = rows.agg(F.count("*"), F.sum("size")).first()
    heavy = F.col("bytes") * packets >= (total or 0)
    packet = F.pmod(F.xxhash64("_group"), F.lit(packets)).cast("int")
    items = groups.select(
        F.when(heavy, F.col("_group")).alias("_own"),
        F.when(~heavy, packet).alias("_packet"),
        "bytes",
    ).groupBy("_own", "_packet").agg(F.sum("bytes").alias("bytes"))

    def place(frames):
        # Bounded: at most ``packets`` packets and ``packets`` heavy groups.
        parts = list(frames)
        if parts:
            found = pd.concat(parts).sort_values(
                ["bytes", "_packet", "_own"], ascending=[False, True, True], kind="stable"
            )
            found["shard"] = difference(found["bytes"].to_numpy(np.int64), shards)
            yield found[["_own", "_packet", "shard"]]

    placed = cut_lineage(
        items.coalesce(1).mapInPandas(place, "_own binary, _packet int, shard int")
    )
    owned = placed.filter(F.col("_own").isNotNull()).select(
        F.col("_own").alias("_group"), F.col("shard").alias("_heavy")
    )
    packed = placed.filter(F.col("_packet").isNotNull()).select(
        "_packet", F.col("shard").alias("_light")
    )
    # Both tables have at most ``packets`` rows.
    found = (
        rows.join(F.broadcast(owned), "_group", "left")
        .withColumn("_packet", F.when(F.col("_heavy").isNull(), packet))
        .join(F.broadcast(packed), "_packet", "left")
        .select(key, "size", "text_crc32", F.coalesce("_heavy", "_light").alias("shard"))
    )
    # A shard is numbered in blocks, so that one with very many rows is spread over tasks.
    blocks = max(1, -(-count // slot_block))
    block = F.pmod(F.xxhash64(key, "text_crc32"), F.lit(blocks)).cast("int")
    found = found.withColumn("_block", block)
    counts = found.groupBy("shard", "_block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "shard", "_block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy("shard", "_block").orderBy(key, "size", "text_crc32")
    return (
        found.withColumn("_at", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "_block"])
        .select(
            key,
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("_before") + F.col("_at")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
