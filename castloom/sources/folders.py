"""Very many small files, listed and read by tasks; the driver holds no list of them."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and files that a task hands over at a time.
BATCH_BYTES, BATCH_FILES = 4 << 20, 1024
COLUMNS = ("file_path", "file_name", "file_size")
#: What Java escapes in the path of a URI.
ESCAPED = re.compile(
    r"[^A-Za-z0-9;/:@&=+$,_!.~'()*\u00a1-\U0010ffff-]|[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)


def read_whole(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(file_path, file_name, file_size, value) of the files at any depth whose names fit, as Spark's reader has them.

    Spark's reader keeps the state of every file on the driver and plans a task for every few.
    On a mounted disk tasks list the folders here, level by level, what they find is dealt
    anew by its path, and tasks read the files. Other stores are left to Spark, and so are
    patterns that do not end in a plain extension, for their files may be compressed.
    """
    roots = _mounted(spark, folder) if _uncompressed(spark, pattern) else []
    if not roots:
        files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        return files.text(folder, wholetext=True).select(*(f"_metadata.{c}" for c in COLUMNS), "value")
    glob = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    fits = re.compile(glob, re.DOTALL).fullmatch
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = [r for r in roots if r[1] or _wanted(r[0], fits)]
    found = spark.sparkContext.parallelize(found, max(1, min(tasks, len(found))))
    for deep in (False, False, True):
        found = found.mapPartitions(partial(_entries, fits=fits, deep=deep)).partitionBy(tasks, zlib.crc32)
    # Not a table of known size: Spark would take the texts to be as short as their paths.
    paths = spark.createDataFrame(found.keys().map(lambda p: (p,)), "path binary", verifySchema=False)
    schema = "file_path string NOT NULL, file_name string NOT NULL, file_size bigint NOT NULL, value binary"
    read = paths.mapInArrow(_read, schema)
    return read.withColumn("value", F.col("value").cast("string"))


def _uncompressed(spark: SparkSession, pattern: str) -> bool:
    extension = re.search(r"\.\w+$", pattern)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    codecs = hadoop.io.compress.CompressionCodecFactory(conf)
    return extension is not None and codecs.getCodec(hadoop.fs.Path(f"x{extension[0]}")) is None


def _mounted(spark: SparkSession, folder: str) -> list[tuple[bytes, bool]]:
    """(path, is a folder) of what the path or glob names on a mounted disk."""
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    path = fs.Path(folder)
    scheme = path.toUri().getScheme() or fs.FileSystem.getDefaultUri(conf).getScheme()
    if scheme != "file":
        return []
    found = path.getFileSystem(conf).globStatus(path) or []
    return [(os.fsencode(f.getPath().toUri().getPath()), f.isDirectory()) for f in found]


def _passed_over(name: bytes) -> bool:
    """Names that Spark does not look at."""
    return name.startswith(b".") or name.endswith(b"._COPYING_") or (name.startswith(b"_") and b"=" not in name)


def _wanted(path: bytes, fits: Callable) -> bool:
    name = os.path.basename(path)
    return not _passed_over(name) and fits(name.decode(errors="replace")) is not None


def _entries(found: Iterable[tuple[bytes, bool]], fits: Callable, deep: bool) -> Iterator[tuple[bytes, bool]]:
    """The files, and what lies in the folders: one level, or all files below them.

    A folder that is not there is an error, for the executor may lack the disk.
    """
    for path, is_folder in found:
        if not is_folder:
            yield path, False
            continue
        folders = [path]
        while folders:
            with os.scandir(folders.pop()) as entries:
                for entry in entries:
                    linked = entry.is_symlink()
                    if os.path.isdir(entry.path) if linked else entry.is_dir():
                        # Spark passes over files of these names, but not over folders.
                        if _passed_over(entry.name) and not entry.name.startswith((b"_metadata", b"_common_metadata")):
                            continue
                        if deep:
                            folders.append(entry.path)
                        else:
                            yield entry.path, True
                    elif _wanted(entry.path, fits) and (os.path.isfile(entry.path) if linked else entry.is_file()):
                        yield entry.path, False


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths, texts, size = [], [], 0
    for path in (p for batch in batches for p in batch.column(0).to_pylist()):
        with open(path, "rb") as file:
            text = file.read()
        if not text:  # Spark reads no empty file
            continue
        _verify(path, text)
        paths.append(f"file:{ESCAPED.sub(lambda m: quote(m[0], safe=''), path.decode(errors='replace'))}")
        texts.append(text)
        size += len(text)
        if size >= BATCH_BYTES or len(paths) >= BATCH_FILES:
            yield _batch(paths, texts)
            paths, texts, size = [], [], 0
    yield _batch(paths, texts)


def _batch(paths: list[str], texts: list[bytes]) -> pa.RecordBatch:
    names = pa.array([os.path.basename(p) for p in paths], pa.string())
    sizes = pa.array([len(t) for t in texts], pa.int64())
    columns = [pa.array(paths, pa.string()), names, sizes, pa.array(texts, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, [*COLUMNS, "value"])


def _verify(path: bytes, text: bytes) -> None:
    """Check the text against the checksums that Hadoop's writer leaves beside a file, as its reader does."""
    folder, name = os.path.split(path)
    try:
        with open(os.path.join(folder, b"." + name + b".crc"), "rb") as file:
            sums = file.read()
    except FileNotFoundError:
        return
    step = int.from_bytes(sums[4:8], "big")
    if not sums.startswith(b"crc\0") or not step:
        return
    ours = b"".join(zlib.crc32(text[i : i + step]).to_bytes(4, "big") for i in range(0, len(text), step))
    if not sums[8:].startswith(ours):
        raise OSError(f"checksum error: {path.decode(errors='replace')}")
