"""The append logs as streams: usage ledger, costs in time windows, job states.

A watermark bounds what a stream remembers, so rows later than it are not in its output. They
are not lost: ``late_usage`` finds them in what was received, and ``with_late_costs`` adds
them to the windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from castloom.operators.rows import keep_last, new_rows
from castloom.session import shared_dir
from castloom.sinks.versions import Table

FINAL = ("succeeded", "failed", "cancelled")


def stream_usage(usage: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Ledger stream with one row per usage id.

    Ids are remembered for as long as the watermark allows; rows later than that go to
    ``late_usage``.
    """
    return usage.withWatermark("used_at", watermark).dropDuplicatesWithinWatermark(["usage_id"])


def late_usage(received: DataFrame, ledger: DataFrame) -> DataFrame:
    """The rows of a batch of received records that the ledger stream left out, each once."""
    return new_rows(received, ledger, "usage_id").dropDuplicates(["usage_id"])


def window_costs(usage: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Cost and tokens per provider in tumbling or sliding windows; for batches and streams."""
    return (
        usage.groupBy(F.window("used_at", width, slide).alias("w"), "provider")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
            F.sum("cost_usd").alias("cost_usd"),
        )
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
            "provider", "records", "tokens", "cost_usd",
        )
    )


def stream_costs(
    usage: DataFrame, width: str = "1 hour", slide: str | None = None, watermark: str = "1 hour"
) -> DataFrame:
    """Windows of a stream of usage in which a record delivered twice counts once.

    In append mode a window comes out once, when the watermark has passed its end; in update
    mode (``run_costs``) whenever it has changed.
    """
    return window_costs(stream_usage(usage, watermark), width, slide)


def with_late_costs(
    windows: DataFrame, late: DataFrame, width: str = "1 hour", slide: str | None = None
) -> DataFrame:
    """Emitted windows with the records that came after them."""
    columns = ["window_start", "window_end", "provider", "records", "tokens", "cost_usd"]
    both = windows.select(columns).unionByName(window_costs(late, width, slide))
    return both.groupBy("window_start", "window_end", "provider").agg(
        *(F.sum(c).alias(c) for c in ("records", "tokens", "cost_usd"))
    )


_JOB = "job_id bigint, seq bigint, status string, stage string"
_KNOWN = "at bigint, seq bigint, status string, stage string, expires bigint"


class JobStates(StatefulProcessor):
    """The newest row of each job, or the final one that ended it, with an event-time timer
    that drops it. Rows of a micro-batch pass by one at a time, so a busy job needs no memory."""

    def __init__(self, idle: str):
        self.patience = pd.Timedelta(idle) // pd.Timedelta("1ms")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", _KNOWN)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        stored = self.known.get() if self.known.exists() else None
        before, expires = (tuple(stored[:4]), stored[4]) if stored else (None, None)
        if before and before[2] in FINAL:
            return
        newest, ended = before, None
        for r in rows:
            row = (r["at"], r["seq"], r["status"], r["stage"])
            if newest is None or row[:2] > newest[:2]:
                newest = row
            if row[2] in FINAL and (ended is None or row[:2] < ended[:2]):
                ended = row
        now = ended or newest
        reached = max(now[0] // 1000, timerValues.getCurrentWatermarkInMs())
        if expires is not None:
            self.handle.deleteTimer(expires)
        self.handle.registerTimer(reached + self.patience)
        self.known.update((*now, reached + self.patience))
        if before is None or before[2:] != now[2:]:
            yield Row(job_id=key[0], seq=now[1], status=now[2], stage=now[3])

    def handleExpiredTimer(
        self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
    ) -> Iterator[Row]:
        self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_jobs(progress: DataFrame, watermark: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """Status and stage of each job when they change; run in update mode, on RocksDB state
    (``run_to_table`` with ``rocksdb``).

    ``progress`` has (job_id, ts, seq, status, stage); rows of a job may arrive in any order
    and more than once; ts and seq are not null. A repeat emits nothing. The first final status
    ends a job: rows behind it emit nothing. Its state, as that of a job without news, goes
    ``idle`` after its last row.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    rows = progress.withWatermark("ts", watermark).select("job_id", "ts", at, "seq", "status", "stage")
    return rows.groupBy("job_id").transformWithState(JobStates(idle), _JOB, "update", "eventTime")


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_store(spark: SparkSession, rocksdb: bool) -> Iterator[None]:
    """A query takes its state store from the session when it starts."""
    before = spark.conf.get(_STORE, None)
    if rocksdb:
        spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        if rocksdb:
            spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def run_to_table(
    stream: DataFrame, mode: str = "append", rocksdb: bool = False, base: str | None = None
) -> DataFrame:
    """Run a stream over what its source holds now and return the rows it emitted.

    Each micro-batch overwrites its own folder, so a batch run again after a failure
    leaves no repeats. Column ``batch`` tells in which one a row was emitted. With ``base``, a
    folder of the caller, a later run goes on where the one before it ended. ``rocksdb`` keeps
    the state on the executors' disks.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def store(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(store)
    )
    with _state_store(spark, rocksdb):
        query = writer.start()
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "integer")).parquet(f"{base}/out")


def run_costs(
    usage: DataFrame, path: str, width: str = "1 hour", slide: str | None = None,
    watermark: str = "1 hour", checkpoint: str | None = None,
) -> Table:
    """Costs in time windows as a table that is right after each micro-batch, in update mode.

    Each micro-batch replaces the windows it changed, as one version of the table at ``path``.
    The batch number is in the version: a micro-batch run again after a failure changes
    nothing, and neither does a whole run again from the same ``checkpoint``.
    """
    table = Table(usage.sparkSession, path, ["window_start", "provider"])
    key = table.key

    def replace(stored: DataFrame, rows: DataFrame) -> DataFrame:
        return new_rows(stored, rows, key).unionByName(rows)

    def store(rows: DataFrame, batch: int) -> None:
        table.merge(rows, replace, writer="costs", number=batch)

    query = (
        stream_costs(usage, width, slide, watermark)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint or f"{path}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()
    return table


def last_emitted(rows: DataFrame, *keys: str) -> DataFrame:
    """Newest row per key of what an update-mode stream emitted."""
    return keep_last(rows, list(keys), ["batch"]).drop("batch")


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder in the order they were written, ``files_per_batch`` to a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.parquet(path)
