"""Shards against a plain heap over all groups."""

import heapq
import random
import zlib
from collections import Counter, defaultdict

from castloom.llm import sharding
from tests.llm.cases import documents, empty, rows, words


def by_heap(sizes, count):
    """Loads when every group goes through the heap."""
    heap = [(0, s) for s in range(count)]
    for size in sorted(sizes, reverse=True):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
    return sorted(load for load, _ in heap)


def check(spark, table, count):
    found = sharding.shards(documents(spark, table), count=count).collect()
    want = Counter()
    groups = Counter()
    for r in table:
        raw = (r[1] or "").encode()
        want[r[0], len(raw) + 16, zlib.crc32(raw)] += 1
        groups[raw] += len(raw) + 16
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    loads, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in found:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[r["size"], r["text_crc32"]].add(r["shard"])
        assert (r["law"], r["grown_shard"]) == ("bytes", None)
    assert sorted(loads[s] for s in range(count)) == by_heap(groups.values(), count)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in homes.values())
    return found


def test_cases(spark):
    check(spark, rows(), 3)
    check(spark, rows(), 40)


def test_hot_groups_span_ranges_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 5)
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 7)
    rest = ("en", "s", 1, 1, True, 2, 3, "f", "key", "told", 4)
    table = [(i, "hot" if i % 3 == 0 else f"text {i:04d}", *rest) for i in range(300)]
    table += [(7, "again", *rest)] * 100 + [(i, words(i, i % 20), *rest) for i in range(60)]
    check(spark, table, 7)


def test_jumps_like_the_heap():
    rng = random.Random(1)
    for _ in range(60):
        shards = rng.randint(1, 9)
        classes = [(rng.randint(0, 40), rng.randint(1, 200)) for _ in range(rng.randint(1, 6))]
        classes = sorted(dict(classes).items(), reverse=True)
        heap, want = [(0, s) for s in range(shards)], []
        for size, count in classes:
            given = Counter()
            for _ in range(count):
                load, s = heap[0]
                given[s] += 1
                heapq.heapreplace(heap, (load + size, s))
            want.append(sorted(given.items()))
        assert list(sharding.longest_first(classes, shards)) == want


def test_reruns_agree(spark):
    a, b = (sorted(map(repr, sharding.shards(documents(spark).repartition(n)).collect())) for n in (1, 7))
    assert a == b


def test_empty(spark):
    assert sharding.shards(empty(spark)).collect() == []
