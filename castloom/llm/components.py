"""Connected components of a link table, as alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castloom.llm.base import parked


def _lowest(both: DataFrame) -> DataFrame:
    """Each end with its lowest neighbour, itself included."""
    return both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step; links point from higher to lower."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = (
        both.join(_lowest(both), "a")
        .where("b > a")
        .select(F.col("b").alias("a"), F.col("low").alias("b"))
        .distinct()
    )
    low = large.groupBy("a").agg(F.min("b").alias("low"))
    small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    tips = low.select("a", F.col("low").alias("b"))
    return small.unionByName(tips).where("a > b").distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link table; root is the smallest node reachable.

    Each round is parked in the shared folder, so lineage stays short. Links of a node to
    itself and repeated links change nothing; null ends are dropped. Hubs are joined, never
    gathered into one row, so that Spark can split them. Rounds grow with the logarithm of
    the longest path.
    """
    links = (
        links.select(F.col(a).alias("x"), F.col(b).alias("y"))
        .where("x <> y")
        .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        .distinct()
    )
    links = parked(links, "links")
    state = _state(links)
    while True:
        links = parked(_stars(links), "links")
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
