import heapq
import random
import zlib
from collections import defaultdict

from helpers_llm import awkward, documents

from panelyard.llm import shards as S


def heap_loads(sizes, shards):
    heap = [(0, k) for k in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, k = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, k))
    return sorted(load for load, _ in heap)


def test_dealing_many_equal_groups_equals_the_heap():
    rng = random.Random(5)
    for _ in range(50):
        loads = [rng.randrange(200) for _ in range(5)]
        size, count = rng.randint(1, 40), rng.randint(65, 400)
        heap = sorted((load, k) for k, load in enumerate(loads))
        heapq.heapify(heap)
        taken = [0] * 5
        for _ in range(count):
            load, k = heapq.heappop(heap)
            taken[k] += 1
            heapq.heappush(heap, (load + size, k))
        mine = list(loads)
        assert S.deal(mine, size, count) == taken and mine == [load + n * size for load, n in zip(loads, taken, strict=True)]


def test_loads_equal_longest_processing_time(spark):
    rows = awkward() + [(1000 + k, f"tiny {k:03}", "en", "s") for k in range(300)]
    docs = documents(spark, rows)
    found = S.shard_documents(docs, 5, whole=False).collect()
    sizes, groups, slots = defaultdict(int), defaultdict(set), defaultdict(list)
    for r in found:
        sizes[r._shard] += r._size
        groups[r._key].add(r._shard)
        slots[r._shard].append(r._slot)
    want = defaultdict(int)
    for _, t, _, _ in rows:
        want[t or ""] += len((t or "").encode()) + 1
    assert sorted(sizes.values()) == heap_loads(want.values(), 5)
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(found) == len(rows)
    assert sorted((r._doc is None, r._doc or 0, r._crc) for r in found) == sorted((d is None, d or 0, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)


def test_documents_keep_their_columns(spark):
    docs = documents(spark, awkward())
    out = S.with_shards(docs, 4)
    assert out.columns == [*[c for c in docs.columns if c != "shard"], "shard", "slot"] and out.count() == docs.count()
    assert S.with_shards(documents(spark, []), 4).count() == 0
