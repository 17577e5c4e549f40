import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortlens.llm import sharding


def check(rows, found, shards):
    assert Counter((r.doc_id, zlib.crc32((r.text or "").encode())) for r in rows) == Counter(
        (r.doc_id, r.text_crc32) for r in found
    )
    slots, of_text, load = defaultdict(list), defaultdict(set), Counter()
    for r in found:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        of_text[r.text_crc32].add(r.shard)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    return [load[s] for s in range(shards)]


def test_odd_documents(odd_documents):
    rows = odd_documents.collect()
    load = check(rows, sharding.shard(odd_documents, slot_block=3).collect(), 40)
    assert sum(load) == sum(len((r.text or "").encode()) + 16 for r in rows)
    assert sharding.shard(odd_documents.limit(0)).count() == 0


@pytest.mark.parametrize("packets", [16, 8192])
def test_groups_stay_together_and_sizes_are_near(text_spark, packets):
    texts = ["x" * (i * 37 % 900) + str(i % 700) for i in range(3000)] + ["copy"] * 500
    docs = text_spark.createDataFrame(
        list(enumerate(texts)), "doc_id bigint, text string"
    ).repartition(5)
    found = sharding.shard(docs, shards=8, packets=packets).collect()
    load = check(docs.collect(), found, 8)
    assert max(load) - min(load) <= (16 if packets > 1000 else max(load) * 0.2)


def test_differencing_is_tight_and_complete():
    random = np.random.default_rng(0)
    sizes = random.integers(1, 10_000, 500)
    shard = sharding.difference(sizes, 7)
    load = np.bincount(shard, sizes, 7)
    greedy = np.zeros(7)
    for s in sorted(sizes)[::-1]:
        greedy[greedy.argmin()] += s
    assert load.sum() == sizes.sum() and np.ptp(load) <= np.ptp(greedy)
    # The textbook case: two ways over 4 5 6 7 8 leave a difference of 2.
    assert sorted(np.bincount(sharding.difference(np.array([4, 5, 6, 7, 8]), 2), [4, 5, 6, 7, 8])) == [14, 16]
    assert list(sharding.difference(np.array([], np.int64), 3)) == []
