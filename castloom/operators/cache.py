"""Caches as tables: statistics, expiry, size-bounded eviction, upsert."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castloom.functions.text import megabytes
from castloom.operators.ordered import running_sums
from castloom.operators.rows import keep_last

DEFAULT_TTL_DAYS = 30


def _expired(as_of: datetime, ttl_days: int) -> Column:
    """Strictly older than the time to live."""
    return F.coalesce(F.col("cached_at") < F.lit(as_of - timedelta(days=ttl_days)), F.lit(False))


def cache_stats(
    entries: DataFrame, as_of: datetime, ttl_days: int = DEFAULT_TTL_DAYS
) -> DataFrame:
    """One row of counts, bytes and the oldest entry's age.

    An entry that cannot be read (null ``cached_at``) counts in total and valid, but
    neither its bytes nor its age do.
    """
    readable = F.col("cached_at").isNotNull()
    n, expired = F.count(F.lit(1)), F.count_if(_expired(as_of, ttl_days))
    size = F.coalesce(F.sum(F.when(readable, F.col("size_bytes"))), F.lit(0)).cast("bigint")
    seconds = F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp(F.min("cached_at"))
    return entries.agg(
        n.alias("total"),
        expired.alias("expired"),
        (n - expired).alias("valid"),
        size.alias("size_bytes"),
        megabytes(size).alias("size_mb"),
        F.coalesce(F.round(seconds / 86400.0, 1), F.lit(0.0)).alias("oldest_age_days"),
    )


def cache_counts(entries: DataFrame, *fields: str) -> DataFrame:
    """Readable entries by each of the fields, all in one pass."""
    readable = entries.where(F.col("cached_at").isNotNull())
    pairs = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias("value"),
            )
            for f in fields
        ]
    )
    return readable.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(
        F.count(F.lit(1)).alias("entries")
    )


def suffix(filename: Column) -> Column:
    """Lower-case file suffix, ``<none>`` without one."""
    found = F.regexp_extract(F.lower(filename), r"[^/]+(\.[^./]+)$", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("<none>"))


def media_stats(files: DataFrame) -> DataFrame:
    """Files and bytes by suffix."""
    return files.groupBy(suffix(F.col("filename")).alias("extension")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes")
    )


def drop_expired(
    entries: DataFrame, as_of: datetime, ttl_days: int = DEFAULT_TTL_DAYS
) -> tuple[DataFrame, DataFrame]:
    """Entries to keep and to remove; one that cannot be read is removed."""
    keep = F.coalesce(F.col("cached_at") >= F.lit(as_of - timedelta(days=ttl_days)), F.lit(False))
    return entries.where(keep), entries.where(~keep)


def put_cache(entries: DataFrame, batch: DataFrame, key: str = "cache_key") -> DataFrame:
    """Upsert by key: the newest entry stays, the batch's among equals."""
    both = entries.withColumn("_batch", F.lit(0)).unionByName(batch.withColumn("_batch", F.lit(1)))
    return keep_last(both, [key], ["cached_at", "_batch"]).drop("_batch")


def evict(
    files: DataFrame,
    max_bytes: int | None,
    as_of: datetime,
    ttl_days: int = DEFAULT_TTL_DAYS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Files to delete and why, per cache (``keys``) or over all.

    First everything past its time to live, then the oldest until the rest fits. A file
    with ``protected`` counts in the size but is never deleted. A file goes exactly when
    the size without all older deletable files is still over the limit, so one running
    sum decides; it is computed over range partitions and holds for one huge cache too.
    """
    old = _expired(as_of, ttl_days) & ~F.col("protected")
    columns = [*keys, "file_id", "size_bytes", "cached_at", "protected"]
    judged = files.select(*columns, old.alias("_old"))
    expired = judged.where("_old").select(*keys, "file_id", "size_bytes", F.lit("expired").alias("reason"))
    if max_bytes is None:
        return expired
    rest = judged.where("NOT _old")
    free = F.when(F.col("protected"), F.lit(0)).otherwise(F.col("size_bytes")).cast("bigint")
    run = running_sums(rest, list(keys), ["cached_at", "file_id"], {"_freed": free})
    total = rest.groupBy(*keys).agg(F.sum("size_bytes").alias("_total"))
    if keys:
        sized = run.join(total, list(keys))
    else:
        sized = run.withColumn("_total", total.select("_total").scalar())
    before = F.col("_freed") - F.col("size_bytes")
    over = ~F.col("protected") & (F.col("_total") - before > max_bytes)
    return expired.unionByName(
        sized.where(over).select(*keys, "file_id", "size_bytes", F.lit("size").alias("reason"))
    )


def evict_report(evicted: DataFrame) -> DataFrame:
    """Counts by reason and bytes of what ``evict`` chose."""
    return evicted.agg(
        F.count_if(F.col("reason") == "expired").alias("expired_files"),
        F.count_if(F.col("reason") == "size").alias("size_files"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("bytes_deleted"),
    )
