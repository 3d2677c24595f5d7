"""Tables kept in buckets of their key, so that a join on the key moves the other side only.

A cache or a table of note versions is joined by every plan and is far larger than what one plan
asks for. Written once in buckets by Spark, it is registered from its folder in any session, and
a join by key reads it where it lies: no exchange above its scan. Have at least as many buckets
as the session has shuffle partitions; with fewer, Spark may prefer to move both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BUCKETS = 64


def _quoted(names: Sequence[str]) -> str:
    return ", ".join("`{}`".format(n.replace("`", "``")) for n in names)


def _register(spark: SparkSession, path: str, schema: StructType, key: Sequence[str], buckets: int) -> str:
    """Name of a new catalog entry over the folder; dropping it leaves the files."""
    name = f"castloom_{uuid.uuid4().hex}"
    columns = ", ".join(f"{_quoted([f.name])} {f.dataType.simpleString()}" for f in schema.fields)
    place = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet "
        f"CLUSTERED BY ({_quoted(key)}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return name


def write_buckets(rows: DataFrame, path: str, key: str | Sequence[str], buckets: int = BUCKETS) -> None:
    """Write rows to a new folder in buckets of ``key``.

    The rows are dealt out by the same hash first, so each bucket is one file, however many
    tasks read them. ``path`` must not hold anything yet: the store is written anew elsewhere,
    and readers move on to the new folder. Null keys are rows like any other.
    """
    spark, key = rows.sparkSession, [key] if isinstance(key, str) else list(key)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise FileExistsError(path)
    name = f"castloom_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, *key)
    try:
        dealt.write.format("parquet").option("path", path).mode("error").bucketBy(
            buckets, key[0], *key[1:]
        ).saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def read_buckets(
    spark: SparkSession, path: str, key: str | Sequence[str], buckets: int = BUCKETS,
    schema: StructType | None = None,
) -> DataFrame:
    """The rows of a folder that ``write_buckets`` wrote with the same key and buckets.

    An empty table has no file to tell its columns; give the ``schema`` if it may be one.
    """
    key = [key] if isinstance(key, str) else list(key)
    schema = schema or spark.read.parquet(path).schema
    return spark.table(_register(spark, path, schema, key, buckets))
