"""Shards of near equal size: longest-processing-time scheduling of groups of equal texts."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castloom.llm.base import parked, pick

#: Rows that are numbered together on average, and repeats of a row that one row stands for.
RANGE_ROWS, BLOCK_ROWS = 2000, 10_000


def longest_first(classes: Iterable[tuple[int, int]], shards: int) -> Iterator[list[tuple[int, int]]]:
    """For each (size, how many groups of it), largest size first: [(shard, how many it gets)].

    The next group goes to the least loaded shard, the lower number on ties: the top of a heap.
    Of very many groups of one size all but the last few turns are made at once: those that
    start at a load up to the highest level the groups can fill.
    """
    heap = [(0, shard) for shard in range(shards)]
    for size, count in classes:
        given = [0] * shards
        if size and count > 4 * shards:
            low, high = heap[0][0], heap[0][0] + size * count
            while low < high:
                level = (low + high + 1) // 2
                if sum((level - load) // size + 1 for load, _ in heap if load <= level) <= count:
                    low = level
                else:
                    high = level - 1
            for load, shard in heap:
                given[shard] = max(0, (low - load) // size + 1)
            heap = [(load + size * given[shard], shard) for load, shard in heap]
            heapq.heapify(heap)
        for _ in range(count - sum(given)):
            load, shard = heap[0]
            given[shard] += 1
            heapq.heapreplace(heap, (load + size, shard))
        yield [(shard, n) for shard, n in enumerate(given) if n]


def _schedule(groups: DataFrame, shards: int) -> DataFrame:
    """(total, groups, firsts, shards): of the groups of one total size, those from the first on
    go to the shard beside it.

    One task sees one row per different size, not per group: k different sizes need over k*k/2
    bytes of text, so their number grows with the root of the input at most.
    """
    classes = groups.groupBy("total").agg(F.count("*").alias("groups"))
    classes = classes.repartition(1).sortWithinPartitions(F.desc("total"))

    def schedule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[int, int]] = []

        def told() -> Iterator[tuple[int, int]]:
            for batch in batches:
                for row in zip(batch["total"].to_pylist(), batch["groups"].to_pylist(), strict=True):
                    seen.append(row)
                    yield row

        firsts, turns = [], []

        def made() -> pa.RecordBatch:
            totals, counts = zip(*seen[: len(turns)], strict=True)
            columns = [
                pa.array(totals, pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array(firsts, pa.list_(pa.int64())),
                pa.array(turns, pa.list_(pa.int32())),
            ]
            del seen[: len(turns)], firsts[:], turns[:]
            return pa.RecordBatch.from_arrays(columns, ["total", "groups", "firsts", "shards"])

        for given in longest_first(told(), shards):
            at, starts = 0, []
            for _, n in given:
                starts.append(at)
                at += n
            firsts.append(starts)
            turns.append([shard for shard, _ in given])
            if len(turns) == 1000:
                yield made()
        if turns:
            yield made()

    kind = "total bigint, groups bigint, firsts array<bigint>, shards array<int>"
    return classes.mapInArrow(schedule, kind)


def _numbered(rows: DataFrame, key: str, size: str, weight: str | None, name: str) -> DataFrame:
    """Numbers from 0 within each key, in the order of the random column `hash`.

    `size` is how many rows the key has. They fall into ranges of the hash, so a hot key is
    spread over as many ranges as it needs; sums of ranges run along the key, rows inside each
    range. With a weight, each row takes that many numbers and gets the first of them.
    """
    each = F.col(weight) if weight else F.lit(1)
    ranges = F.ceil(F.col(size) / RANGE_ROWS)
    rows = rows.withColumn("range", F.shiftright(F.shiftrightunsigned("hash", 33) * ranges, 31))
    along = Window.partitionBy("at").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(F.col(key).alias("at"), F.col("range").alias("r")).agg(F.sum(each).alias("in_range"))
    starts = sums.select("at", "r", F.coalesce(F.sum("in_range").over(along), F.lit(0)).alias("start"))
    inside = Window.partitionBy(key, "range").orderBy("hash", "digest", "doc_id") if weight else (
        Window.partitionBy(key, "range").orderBy("hash", "digest")
    )
    before = F.coalesce(F.sum(each).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before)
    joined = rows.join(starts, (F.col(key) == F.col("at")) & (F.col("range") == F.col("r")))
    made = (F.col("start") + F.col("before")).cast("long").alias(name)
    return joined.select(*(c for c in rows.columns if c not in ("range", "before")), made)


def shards(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", count: int = 40, overhead: int = 16
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the bytes of the text (UTF-8) and `overhead`. Equal texts are one group and share a
    shard. Groups go, largest first, to the least loaded of `count` shards, so the sizes of
    shards are near equal (law `bytes`) as far as the largest groups allow: a group of a third
    of everything fills one shard alone. Groups of equal size take their turns in the order of a
    hash of the text. slot counts from 0 without gaps in each shard. grown_shard is null, for
    one more shard would move groups between the others.

    Null texts count as empty and are one group with the empty ones. A null doc_id is kept like
    any other; repeated rows stay, each with a slot of its own. Reruns agree. An empty table
    gives an empty result. Other columns are not used.
    """
    rows = pick(docs, doc_id=doc_id, text=text)
    raw = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.select(
        "doc_id",
        F.unhex(F.md5(raw)).alias("digest"),
        (F.octet_length(raw) + overhead).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    # A row that is there a million times is one row from here on.
    rows = rows.groupBy("doc_id", "digest", "size", "text_crc32").agg(F.count("*").alias("repeats"))
    rows = parked(rows, "texts")
    groups = rows.groupBy("digest").agg(F.sum(F.col("size") * F.col("repeats")).alias("total"))
    groups = parked(groups, "groups")
    plan = parked(_schedule(groups, count), "schedule")
    ranked = groups.join(plan.select("total", "groups"), "total").withColumn("hash", F.xxhash64("digest"))
    ranked = _numbered(ranked, "total", "groups", None, "rank")
    turn = F.size(F.filter("firsts", lambda first: first <= F.col("rank"))) - 1
    placed = ranked.select("digest", "total", "rank").join(plan.drop("groups"), "total")
    placed = placed.select("digest", F.get("shards", turn).alias("shard"))
    dealt = parked(rows.join(placed, "digest"), "dealt")

    held = dealt.groupBy("shard").agg(F.count("*").alias("held"))
    dealt = dealt.join(held, "shard").withColumn("hash", F.xxhash64("doc_id", "digest"))
    dealt = _numbered(dealt, "shard", "held", "repeats", "first")
    # Repeats become rows again, many of one row in several tasks.
    last = F.col("repeats") - 1
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", last, F.lit(BLOCK_ROWS))))
    blocks = dealt.withColumn("block", block).repartition("hash", "block")
    start = F.col("block") * BLOCK_ROWS
    nth = F.explode(F.sequence(start, F.least(start + BLOCK_ROWS - 1, last)))
    return blocks.withColumn("nth", nth).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("nth")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
