"""Tables with versions: data folders first, then one manifest that makes them a version.

    <path>/data/<folder>/_bucket=<n>/part-*.parquet
    <path>/manifests/<version>.json

Rows are dealt to buckets by a hash of the key. A manifest names the folders that hold each
bucket, so a new version writes the buckets it touches and shares the others with the version
before. A reader is bound to one manifest and sees nothing of what is written meanwhile; what a
lost writer leaves is in no manifest. Of two writers that began at one version, the second to
finish is refused. A writer that numbers its batches may repeat one: it is then known already.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from castloom.operators.cache import put_cache
from castloom.operators.library import upsert_notes
from castloom.operators.rows import keep_first, new_rows
from castloom.session import delete, staged

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer committed the version that was to be written."""


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: StructType
    #: Folders of each bucket.
    parts: dict[int, list[str]]
    #: Last batch of each writer that numbers its batches.
    writers: dict[str, int] = field(default_factory=dict)

    def write(self) -> bytes:
        told = {
            "version": self.version,
            "schema": self.schema.jsonValue(),
            "parts": {str(b): folders for b, folders in self.parts.items()},
            "writers": self.writers,
        }
        return json.dumps(told).encode()

    @classmethod
    def read(cls, text: str) -> Manifest:
        told = json.loads(text)
        parts = {int(b): folders for b, folders in told["parts"].items()}
        return cls(told["version"], StructType.fromJson(told["schema"]), parts, told["writers"])


class Table:
    """A table at a path that all executors reach, one row set per version."""

    def __init__(self, spark: SparkSession, path: str, key: str | Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.key = [key] if isinstance(key, str) else list(key)

    # Files

    def _target(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, path: str) -> list[str]:
        target = self._target(path)
        system = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(target):
            return []
        return [status.getPath().getName() for status in system.listStatus(target)]

    def versions(self) -> list[int]:
        names = self._names(f"{self.path}/manifests")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> Manifest | None:
        """That of a version, of the newest without one; None for a table not there yet."""
        known = self.versions() if version is None else [version]
        if not known:
            return None
        file = f"{self.path}/manifests/{known[-1]:012d}.json"
        return Manifest.read(self.spark.read.text(file, wholetext=True).first()[0])

    def _commit(self, manifest: Manifest) -> None:
        """Make a version: its manifest appears whole, and only if no other is there."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        final = self._target(f"{self.path}/manifests/{manifest.version:012d}.json")
        made = self._target(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        system = made.getFileSystem(conf)
        out = system.create(made, False)
        out.write(manifest.write())
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf)
        try:
            context.rename(system.makeQualified(made), system.makeQualified(final), options)
        except Exception as error:
            system.delete(made, False)
            if system.exists(final):
                raise Conflict(f"version {manifest.version} of {self.path} is there already") from error
            raise

    # Rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _frame(self, manifest: Manifest, buckets: Sequence[int] | None = None) -> DataFrame:
        wanted = manifest.parts if buckets is None else buckets
        paths = [f"{self.path}/data/{f}/_bucket={b}" for b in wanted for f in manifest.parts.get(b, ())]
        if not paths:
            return self.spark.createDataFrame([], manifest.schema)
        return self.spark.read.schema(manifest.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, of the newest as it is now without one."""
        manifest = self.manifest(version)
        if manifest is None:
            raise FileNotFoundError(self.path)
        return self._frame(manifest)

    def stage(self, rows: DataFrame) -> dict[int, str]:
        """Write rows to a new folder that no version has yet: {bucket: folder}."""
        folder = uuid.uuid4().hex
        path = f"{self.path}/data/{folder}"
        dealt = rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket")
        dealt.write.partitionBy("_bucket").parquet(path)
        buckets = [n for n in self._names(path) if n.startswith("_bucket=")]
        return {int(n.removeprefix("_bucket=")): folder for n in buckets}

    def merge(
        self,
        batch: DataFrame,
        combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
        *,
        add: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
        writer: str | None = None,
        number: int = 0,
    ) -> Manifest:
        """One new version from a batch.

        ``combine(stored, batch)`` gives the rows that take the place of the buckets the batch
        touches; ``add(stored, batch)`` the rows that join them, and nothing is written anew.
        ``stored`` has the touched buckets only. The batch is computed once. A batch whose
        number is not above the writer's last one changes nothing.
        """
        base = self.manifest()
        if base and writer is not None and number <= base.writers.get(writer, -1):
            return base
        if base is None:
            base = Manifest(-1, batch.schema, {})
        elif (found := batch.schema.simpleString()) != base.schema.simpleString():
            raise ValueError(f"{found} is not {base.schema.simpleString()}")
        with staged(batch) as rows:
            touched = [r[0] for r in rows.select(self._bucket()).distinct().collect()]
            stored = self._frame(base, touched)
            made = self.stage((add or combine)(stored, rows).select(*base.schema.names))
        parts = dict(base.parts)
        if not add:
            parts = {b: folders for b, folders in parts.items() if b not in set(touched)}
        for bucket, folder in made.items():
            parts[bucket] = [*parts.get(bucket, []), folder]
        writers = base.writers | ({writer: number} if writer is not None else {})
        new = Manifest(base.version + 1, base.schema, parts, writers)
        self._commit(new)
        return new

    def sweep(self, keep: int = 1) -> None:
        """Delete all but the newest versions and the data that these do not have, that of
        lost writers included. Run it while nothing is written, and no older version read."""
        known = self.versions()
        held = {f for v in known[-keep:] for folders in self.manifest(v).parts.values() for f in folders}
        for version in known[:-keep]:
            delete(self.spark, f"{self.path}/manifests/{version:012d}.json")
        for folder in self._names(f"{self.path}/data"):
            if folder not in held:
                delete(self.spark, f"{self.path}/data/{folder}")


def ledger_table(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, "usage_id")


def append_ledger(batch: DataFrame, path: str, **told) -> Manifest:
    """Add ledger rows whose id is not stored yet; nothing is written anew."""
    fresh = lambda stored, rows: new_rows(keep_first(rows, ["usage_id"], rows.columns), stored, "usage_id")
    return ledger_table(batch.sparkSession, path).merge(batch, add=fresh, **told)


def put_notes(batch: DataFrame, path: str, key: str = "job_id", **told) -> Manifest:
    """One note per job: a job in the batch replaces its note."""
    replace = lambda stored, rows: upsert_notes(stored, rows, key)
    return Table(batch.sparkSession, path, key).merge(batch, replace, **told)


def store_cache(batch: DataFrame, path: str, key: str = "cache_key", **told) -> Manifest:
    """Upsert by key: the newest entry stays, the batch's among equals."""
    newest = lambda stored, rows: put_cache(stored, rows, key)
    return Table(batch.sparkSession, path, key).merge(batch, newest, **told)
