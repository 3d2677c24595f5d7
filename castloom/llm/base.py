"""What the operators share: tables, parked intermediate results, text slices."""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castloom.session import shared_dir, tune

#: One word, for Spark's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters between words.
BLANKS = "\t\n\x0b\x0c\r "

#: Rows that Spark reads, and hands to Python, at a time: texts are long.
BATCH_ROWS = 500

_parked: list[str] = []


def ready(spark: SparkSession) -> SparkSession:
    """The session, set up for the operators."""
    tune(spark)
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder, in a session that is ready."""
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; `sweep` deletes it."""
    _parked.append(f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}")
    return _parked[-1]


def parked(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point for `sweep`: how many tables are parked so far."""
    return len(_parked)


def sweep(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Delete tables parked since a mark. Call it when no DataFrame reads them any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _parked[since:until]:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    del _parked[since:until]


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under own names: extra columns of the caller never clash."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))
