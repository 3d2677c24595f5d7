"""Row-level helpers shared by the operators: ordered dedupe, set operations, checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    An aggregate rather than a window: each task keeps one candidate per key, so a key
    with very many rows costs no more than any other. The keys travel once.
    """
    return _chosen(df, keys, F.min_by, F.struct(*order))


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the last in ``order``."""
    return _chosen(df, keys, F.max_by, F.struct(*order))


def _chosen(df: DataFrame, keys: Sequence[str], pick, rank: Column) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    rows = df.groupBy(*keys).agg(pick(F.struct(*others), rank).alias("_row"))
    return rows.select(*(F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns))


def hash_sample(df: DataFrame, by: Sequence[str], count: int, most: int) -> DataFrame:
    """At most ``most`` of the ``count`` rows, those with the lowest hash of ``by``.

    The hash is cut off at twice the wanted share first, so that a task passes on a few rows
    however many tasks there are.
    """
    share = min(1.0, 2 * most / max(count, 1))
    hashed = df.withColumn("_h", F.shiftrightunsigned(F.xxhash64(*by), 2))
    low = hashed.where(F.col("_h") <= int(share * 2**62))
    return low.orderBy("_h", *by).limit(most).drop("_h")


def new_rows(rows: DataFrame, known: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``known``; a null key matches nothing, so it is new."""
    keys = [key] if isinstance(key, str) else list(key)
    return rows.join(known.select(*keys), keys, "left_anti")


def shared_rows(rows: DataFrame, known: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key is also in ``known``."""
    keys = [key] if isinstance(key, str) else list(key)
    return rows.join(known.select(*keys), keys, "left_semi")


def union_rows(first: DataFrame, *more: DataFrame) -> DataFrame:
    """All rows of all frames by column name, repeats kept."""
    for df in more:
        first = first.unionByName(df)
    return first


def distinct_union(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Each different row once."""
    return union_rows(first, *more).distinct()


def validate(
    df: DataFrame, rules: Mapping[str, Column], reasons: str = "reasons"
) -> tuple[DataFrame, DataFrame]:
    """Split rows into good ones and rejects that carry every broken rule's name.

    ``rules`` maps a reason to the condition a good row meets; unknown counts as broken.
    """
    broken = F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(condition, F.lit(False)), F.lit(reason))
                for reason, condition in rules.items()
            ]
        )
    )
    checked = df.withColumn(reasons, broken)
    good = checked.where(F.size(reasons) == 0).drop(reasons)
    return good, checked.where(F.size(reasons) > 0)
