"""SimHash near-duplicates: fingerprints, a grid join on bit counts, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castloom.llm.base import parked, pick
from castloom.llm.components import components

SEED = 42
#: Shingles whose bits are unpacked at a time: bounds memory for very long texts.
BLOCK = 1 << 16
_EVEN = 0x5555555555555555


def fingerprint_of(text: str | None, words: int = 4) -> int:
    """Fingerprint of one text as a signed 64-bit number; 0 for null or no words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    size, join, digest = min(words, len(found)), b" ".join, xxhash.xxh64_intdigest
    count, total = len(found) - size + 1, np.zeros(64, np.int64)
    for start in range(0, count, BLOCK):
        part = found[start : start + BLOCK + size - 1]
        shingles = zip(*(part[i:] for i in range(size)), strict=False)
        hashes = np.array([digest(join(s), SEED) for s in shingles], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > count, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, words: int = 4) -> Column:
    """64-bit SimHash of `words`-word shingles, XXH64 with seed 42, A-Z lower-cased."""

    @F.arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t.as_py(), words) for t in texts], pa.int64())

    return simhash(text)


def _bit_counts(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, each as a unary code of two bits.

    The code of a count is 00, 01 or 11, so the Manhattan distance of two such points is the
    number of differing bits, and each byte is a grid cell of four segments.
    """
    shifted = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(shifted).bitwiseAND(F.lit(_EVEN))
    both = fp.bitwiseAND(shifted).bitwiseAND(F.lit(_EVEN))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def close_pairs(
    fps: DataFrame, fp: str = "fp", distance: int = 4, blocks: int | None = None
) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most `distance` bits.

    Fingerprints become points of segment bit counts, `blocks` coordinates of a few segments
    each. At Manhattan distance d, at most d coordinates differ, so with each point in the grid
    once per choice of `blocks - distance` coordinates, a close pair shares a cell of every
    choice that avoids those. In a cell the Manhattan distance bounds the bit distance from
    below, and the bits decide. A pair is taken in the first cell it shares only: the test is
    exact, every pair is returned once, nothing is dropped. Both sides of the join are the same
    rows, so that Spark deals them out once.
    """
    blocks = blocks or max(distance + 4, 8)
    fps = fps.select(F.col(fp).alias("fp")).where("fp is not null").distinct()
    # Each row becomes many: spread them before, however small they are together.
    spread = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = fps.repartition(spread, F.xxhash64("fp"))

    edges = [round(i * 32 / blocks) * 2 for i in range(blocks + 1)]
    masks = [((1 << hi) - 1) & ~((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    choices = list(combinations(range(blocks), blocks - distance))
    point = _bit_counts(F.col("fp"))
    cells = F.array(
        *(
            F.struct(
                F.lit(n).alias("choice"),
                point.bitwiseAND(_signed(sum(masks[i] for i in picked))).alias("cell"),
            )
            for n, picked in enumerate(choices)
        )
    )
    grid = fps.select("fp", F.explode(cells).alias("at")).select("fp", "at.choice", "at.cell")

    apart = _bit_counts(F.col("l.fp")).bitwiseXOR(_bit_counts(F.col("r.fp")))
    shared = sum(
        (F.when(apart.bitwiseAND(_signed(m)) == 0, F.lit(1 << i)).otherwise(0) for i, m in enumerate(masks)),
        F.lit(0),
    )
    own = F.array(*(F.lit(sum(1 << i for i in picked)) for picked in choices))
    upto = F.array(*(F.lit((2 << picked[-1]) - 1) for picked in choices))
    choice = F.col("l.choice")
    near = (
        (choice == F.col("r.choice"))
        & (F.col("l.cell") == F.col("r.cell"))
        & (F.col("l.fp") < F.col("r.fp"))
        & (F.bit_count(apart) <= distance)
        & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= distance)
        & (shared.bitwiseAND(F.get(upto, choice)) == F.get(own, choice))
    )
    # Spark does not see how many rows the grid has and would take it for small.
    pairs = grid.alias("l").join(grid.alias("r").hint("merge"), near)
    return pairs.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4
) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, n_links.

    n_links counts the other distinct fingerprints its own links to. Null and empty texts
    have fingerprint zero and are linked like any other. Repeated rows stay repeated; a null
    doc_id gets a component but never names one (a component of nulls only has a null id).
    An empty table gives an empty result. Other columns of `docs` are not used.
    """
    rows = pick(docs, doc_id=doc_id, text=text)
    rows = parked(rows.select("doc_id", fingerprint(F.col("text"), words).alias("fp")), "prints")
    return linked(rows, distance)


def linked(rows: DataFrame, distance: int = 4) -> DataFrame:
    """The components of documents whose fingerprints (doc_id, fp) are there already."""
    lowest = rows.groupBy("fp").agg(F.min("doc_id").alias("lowest"))
    pairs = parked(close_pairs(rows, distance=distance), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fp"))
    degrees = ends.groupBy("fp").agg(F.count("*").alias("n_links"))
    roots = parked(components(pairs).withColumnRenamed("node", "fp"), "roots")
    named = (
        roots.join(lowest, "fp").groupBy("root").agg(F.min("lowest").alias("component_id"))
    )
    known = parked(
        lowest.join(roots, "fp", "left")
        .join(named, "root", "left")
        .join(degrees, "fp", "left")
        .select(
            "fp",
            F.coalesce("component_id", F.when(F.col("root").isNull(), F.col("lowest"))).alias(
                "component_id"
            ),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        ),
        "named",
    )
    return rows.join(known, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        "n_links",
    )


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4
) -> DataFrame:
    """The documents without near copies: of each component one row stays, all columns.

    It is the row with the smallest doc_id (nulls last), then fingerprint; of rows equal in
    both, one. Texts move once, by (doc_id, fingerprint).
    """
    taken = docs.withColumn("__fp", fingerprint(F.col(f"`{text}`"), words))
    rows = parked(taken.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col("__fp").alias("fp")), "prints")
    roots = components(parked(close_pairs(rows, distance=distance), "pairs"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("first")
    per_print = rows.groupBy("fp").agg(first)
    best = (
        per_print.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .groupBy(F.coalesce("root", "fp").alias("root"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first.doc_id").alias("__id"), F.col("first.fp").alias("__fp"))
    )
    best = parked(best, "kept")
    kept = taken.withColumn("__id", F.col(f"`{doc_id}`")).join(
        best.withColumnsRenamed({"__id": "__k", "__fp": "__kfp"}),
        F.col("__id").eqNullSafe(F.col("__k")) & (F.col("__fp") == F.col("__kfp")),
        "left_semi",
    )
    return kept.dropDuplicates(["__id", "__fp"]).select(*(F.col(f"`{c}`") for c in docs.columns))
