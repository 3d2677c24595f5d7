"""Searching stored notes reads the files that may match, and finds the same rows."""

import random

import pytest

from castloom.operators.library import search_notes
from castloom.session import shared_dir
from castloom.sinks import search


@pytest.fixture(scope="module")
def stored(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    told = [(i, f"Note {i}", " ".join(word() for _ in range(30)), f"https://h{i // 100}.example/x", None) for i in range(2000)]
    told[777] = (777, "Zürich Q&A", "A Needle in the hay", "https://needle.example/", "Häufig")
    told[1500] = (1500, None, None, None, None)
    notes = spark.createDataFrame(told, "note_id bigint, title string, summary string, source_url string, source_title string")
    path = f"{shared_dir(spark)}/searched"
    notes.repartitionByRange(20, "note_id").write.mode("overwrite").parquet(f"{path}/rows")
    search.write_signatures(spark, f"{path}/rows", f"{path}/signatures")
    return path, notes


def ids(df):
    return sorted(r["note_id"] for r in df.collect())


@pytest.mark.parametrize(
    "needle, most",
    [("Needle in", 1), (" ZÜRICH q&a ", 1), ("h7.example", 3), ("not there at all", 0), ("note 19", 20), ("ab", 20), ("", 20), ("ü", 20)],
)
def test_files_read(spark, stored, needle, most):
    path, notes = stored
    files = search.files_for(spark, f"{path}/signatures", needle.strip())
    assert len(files) <= most
    found = search.search_files(spark, f"{path}/rows", f"{path}/signatures", needle)
    assert ids(found) == ids(search_notes(notes, needle))
    assert len(found.inputFiles()) == len(files) or not files


def test_signatures_come_from_tasks_without_an_exchange(spark, stored):
    """One row of bits per file that a task read, not one row per string of characters."""
    path, _ = stored
    rows = spark.read.parquet(f"{path}/signatures")
    assert set(rows.columns) == {"file", "bits"} and rows.count() <= 40
    assert {len(r["bits"]) for r in rows.collect()} == {search.BITS // 8}


def test_characters_of_short_texts_do_not_run_together():
    import numpy as np
    import pyarrow as pa

    def bits(*texts):
        found = np.zeros(search.BITS, bool)
        search._bits_of(pa.array(texts, pa.string()), found)
        return set(np.flatnonzero(found))

    assert bits("ab", "c", "", None, "d", "ef") == set() == bits()
    assert bits("x", "abcd", "ü", "efg", "") == bits("abc") | bits("bcd") | bits("efg")
    assert bits("😀ü€") and not bits("😀ü")
