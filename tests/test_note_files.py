"""Small text files are written whole, in the layout of a partitioned text table."""

import pytest
from pyspark.sql import functions as F

from castloom.catalog.bindings import scratch
from castloom.sinks import files as sink
from castloom.sources import files


def test_as_spark_writes_them(spark):
    told = [("a/b: 1%", 1, "x"), ("a/b: 1%", 1, "y\nz"), (None, 2, "ü"), ("", 2, None), ("é", None, ""), ("s", 3, "w")]
    rows = spark.createDataFrame(told, "podcast string, episode bigint, value string")
    ours, theirs = scratch(spark, "ours"), scratch(spark, "theirs")
    sink.write_texts(rows, ours, ["podcast", "episode"])
    rows.repartition("podcast", "episode").write.partitionBy("podcast", "episode").text(theirs)

    def read(path):
        found = files.read_notes(spark, path, pattern="*.txt").select("podcast_dir", "episode_dir", "content")
        lines = F.array_sort(F.split("content", "\n")).alias("lines")
        return sorted(map(tuple, found.select("podcast_dir", "episode_dir", lines).collect()))

    assert read(ours) == read(theirs)
    assert len(read(ours)) == 4


def test_no_file_is_left_to_the_file_systems_writer(spark):
    """Which starts processes for each; it leaves a checksum beside each file."""
    path = scratch(spark, "many")
    sink.write_texts(spark.range(50).select("id", F.concat(F.lit("t"), "id").alias("value")), path, ["id"])
    names = [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).collect()]
    assert len(names) == 50 and all(n.endswith("/text.txt") for n in names)
    with pytest.raises(FileExistsError):
        sink.write_texts(spark.range(1).select("id", F.lit("t").alias("value")), path, ["id"])
