"""Folders of many small files are listed and read by tasks, with the rows of Spark's own reader."""

import os
import struct
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from castloom.sources import files, folders
from castloom.sources.folders import COLUMNS, read_whole

NAMES = (
    "pod/e1/a.md", "pod/e 1/a b.md", "pod/e%2F1/a%b.md", "pod/é/ü#?x.md", "pod/e=1/x=2.md", "pod/e[1]/{q}.md",
    "pod/e1/deep/er/y.md", "top.md", "pod/mid.md", "pod/_e/h.md", "pod/.e/h.md", "pod/_e=1/h.md", "pod/_metadata/h.md",
    "pod/x._COPYING_/h.md", "pod/e1/_h.md", "pod/e1/_h=1.md", "pod/e1/.h.md", "pod/e1/_metadata.md", "pod/e1/b.txt",
    "pod/e1/Z.MD", "pod/dir.md/in.md", "pod/e1/h.md._COPYING_",
)


def _write(folder, name, text=b"x"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text)


def _spark_rows(spark, path, pattern):
    """The rows of Spark's reader, which lists the files on the driver."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    found = read.text(path, wholetext=True).select(*(f"_metadata.{c}" for c in COLUMNS), "value")
    return _rows(found)


def _rows(found):
    return sorted(map(tuple, found.withColumn("value", F.col("value").cast("binary")).collect()))


def test_same_files_as_sparks_reader(spark, tmp_path):
    for name in NAMES:
        _write(tmp_path, name)
    _write(tmp_path, "pod/e1/empty.md", b"")
    _write(tmp_path, "pod/e1/bytes.md", b"\xef\xbb\xbf\xff\r\n")
    (tmp_path / "pod" / "void").mkdir()
    os.symlink(tmp_path / "pod" / "e1", tmp_path / "pod" / "link")
    os.symlink(tmp_path / "nowhere", tmp_path / "pod" / "e1" / "broken.md")
    os.symlink("loop", tmp_path / "pod" / "loop")
    folder = str(tmp_path)
    for pattern in ("*.md", "?.md", "{a,mid,b}.md", "[!a-z]*.md", "*.txt", "*.MD", "*.none", "*"):
        assert _rows(read_whole(spark, folder, pattern)) == _spark_rows(spark, folder, pattern), pattern
    for path in (f"{folder}/p*/e*", f"{folder}/pod/e\\[1\\]", f"{folder}/top.md", f"file:{folder}/"):
        rows = _rows(read_whole(spark, path, "*.md"))
        assert rows and rows == _spark_rows(spark, path, "*.md"), path
    assert len(_rows(read_whole(spark, folder, "*.md"))) == 18


def test_the_driver_lists_no_notes(spark, tmp_path):
    for n in range(50):
        _write(tmp_path, f"pod/e{n % 40}/n{n}.md", b"text %d" % n)
    notes = files.read_notes(spark, str(tmp_path))
    assert notes.inputFiles() == []
    assert {r["content"] for r in notes.collect()} == {f"text {n}" for n in range(50)}
    # Of unknown size, so that no join sends the texts to the driver for a broadcast.
    meta = spark.range(40).select(
        F.lit("pod").alias("podcast_dir"), F.concat(F.lit("e"), "id").alias("episode_dir"),
        F.expr("map('n1', '7')").alias("templates_versions"),
    )
    joined = files.read_notes(spark, str(tmp_path), meta)
    plan = joined._jdf.queryExecution().optimizedPlan()
    assert plan.children().apply(0).children().apply(0).stats().sizeInBytes() > 1 << 60
    assert {r["filename"]: r["version"] for r in joined.collect()}["n1.md"] == "7"


def test_batches_hold_few_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "BATCH_BYTES", 100)
    for n in range(30):
        _write(tmp_path, f"n{n}.md", b"y" * (10 + n))
    paths = pa.array([os.fsencode(tmp_path / f"n{n}.md") for n in range(30)], pa.binary())
    told = list(folders._read([pa.RecordBatch.from_arrays([paths], ["path"])]))
    assert sum(b.num_rows for b in told) == 30 and max(b.num_rows for b in told) <= 10


def test_a_folder_that_an_executor_lacks_is_no_empty_one(tmp_path):
    for deep in (False, True):
        with pytest.raises(FileNotFoundError):
            list(folders._entries([(os.fsencode(tmp_path / "none"), True)], fits=str.strip, deep=deep))


def test_checksums_of_hadoops_writer_are_compared(spark, tmp_path):
    _write(tmp_path, "pod/e/good.md", b"z" * 1300)
    sums = b"".join(struct.pack(">I", zlib.crc32(b"z" * n)) for n in (512, 512, 276))
    _write(tmp_path, "pod/e/.good.md.crc", b"crc\0" + struct.pack(">I", 512) + sums)
    _write(tmp_path, "pod/e/other.md")
    _write(tmp_path, "pod/e/.other.md.crc", b"no checksums")
    assert files.read_notes(spark, str(tmp_path)).count() == 2
    _write(tmp_path, "pod/e/good.md", b"z" * 1299 + b"a")
    for read in (read_whole(spark, str(tmp_path), "*.md"), spark.read.text(f"{tmp_path}/pod/e/good.md", wholetext=True)):
        with pytest.raises(Exception, match="(?i)checksum"):
            read.collect()
