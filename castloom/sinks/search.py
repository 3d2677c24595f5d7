"""Signatures of a table's files, so that a search reads only those that may hold its words.

Beside the table lies a row of bits per file and task that read it: a bit for each string of three
characters in the file's searched columns, in lower case. A file that lacks the bit of any such
string of the needle holds the needle nowhere and is not read; what is read is searched exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castloom.operators.library import search_notes

#: Bits of a file. A file of n different strings rules out a needle of k strings that it does
#: not hold with a probability of 1 - (n / BITS) ** k at least.
BITS = 1 << 18
#: Rows whose characters are looked at together.
ROWS = 1000
SEARCHED = ("title", "summary", "source_url", "source_title")


def _bits_of(texts: pa.ChunkedArray | pa.Array, bits: np.ndarray) -> None:
    """Set the bits of all strings of three characters of the lower-case texts.

    Whole batches at once: a batch is one array of characters, and strings that reach over the
    end of a text are left out.
    """
    full = texts.drop_null()
    lengths = pc.utf8_length(full).to_numpy()
    text = np.frombuffer("".join(full.to_pylist()).encode("utf-32-le"), "uint32").astype("uint64")
    if len(text) < 3:
        return
    inner = np.ones(len(text), bool)
    ends = np.cumsum(lengths)
    for back in (1, 2):
        # A text of one character has no last but one: that place is in the text before.
        inner[np.maximum(ends - back, 0)[ends >= back]] = False
    grams = (text[:-2] << np.uint64(42) | text[1:-1] << np.uint64(21) | text[2:])[inner[:-2]]
    bits[(grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)] = True


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (file, bits) for each file that a task sees; a task sees few."""
    files: dict[str, np.ndarray] = {}
    for batch in batches:
        for file in pc.unique(batch["file"]).to_pylist():
            bits = files.setdefault(file, np.zeros(BITS, bool))
            rows = batch.filter(pc.equal(batch["file"], file))
            for column in rows.columns[1:]:
                for at in range(0, len(rows), ROWS):
                    _bits_of(column.slice(at, ROWS), bits)
    for file, bits in files.items():
        yield pa.RecordBatch.from_pylist([{"file": file, "bits": np.packbits(bits).tobytes()}])


def _texts(table: DataFrame, file: Column, columns: Sequence[str]) -> DataFrame:
    return table.select(file.alias("file"), *(F.lower(F.col(c)).alias(c) for c in columns))


def write_signatures(spark: SparkSession, path: str, to: str, columns: Sequence[str] = SEARCHED) -> None:
    """Signatures of all files of a Parquet table, in one pass over the searched columns.

    Each task adds up the bits of its files and passes on a row of BITS / 8 bytes for each; a
    file that several tasks read has several rows.
    """
    table = spark.read.parquet(path)
    there = [c for c in columns if c in table.columns]
    texts = _texts(table, F.col("_metadata.file_path"), there)
    texts.mapInArrow(_signatures, "file string, bits binary").write.mode("overwrite").parquet(to)


def files_for(spark: SparkSession, signatures: str, needle: str) -> list[str]:
    """Files that may hold the needle, all of them for one of under three characters."""
    asked = np.zeros(BITS, bool)
    low = spark.range(1).select(F.lower(F.lit(needle))).first()[0]
    _bits_of(pa.array([low]), asked)
    at = [int(i) for i in np.flatnonzero(asked)]
    found = spark.read.parquet(signatures)
    # The bit of a string is in one row at least of a file that holds it.
    byte = lambda i: F.conv(F.hex(F.substring("bits", i // 8 + 1, 1)), 16, 10).cast("int")
    has = [F.max(F.shiftright(byte(i), 7 - i % 8).bitwiseAND(1)).alias(f"_{i}") for i in at]
    held = found.groupBy("file").agg(F.count("*").alias("_n"), *has)
    for i in at:
        held = held.where(F.col(f"_{i}") == 1)
    return [r["file"] for r in held.select("file").collect()]


def search_files(
    spark: SparkSession, path: str, signatures: str, needle: str, mode: str = "all"
) -> DataFrame:
    """``search_notes`` over the notes stored at a path, reading only the files that may match."""
    wanted = needle.strip()
    table = spark.read.parquet(path)
    files = files_for(spark, signatures, wanted)
    some = spark.read.schema(table.schema).option("basePath", path).parquet(*files) if files else table.where("false")
    return search_notes(some, wanted, mode)
