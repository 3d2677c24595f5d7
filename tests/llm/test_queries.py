"""Every query of the subpackage against its SQL twin, or at least whole."""

import pytest

from castloom.llm.queries import ORACLES, QUERIES
from tests.oracle import ROOT, compare, connect

FOLDER = str(ROOT / "sf0.001")
#: Tested against brute force in this folder, for SQL can't express them.
NO_SQL = {
    "op1_near_duplicates",
    "op5_sentence_pieces",
    "op8_substring_chunks",
    "op9_suffix_dedup",
    "op10_personal_data",
    "op12_periodic_runs",
    "op13_shards",
}
#: The same, but with a row per word.
WORDS = {"op11_spelling_variants"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, name):
    assert compare(QUERIES[name](spark, FOLDER), duck, ORACLES[name]) is None


def test_every_query_is_tested():
    assert set(QUERIES) == set(ORACLES) | NO_SQL | WORDS


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_one_row_per_document(spark, name):
    ids = [r["doc_id"] for r in QUERIES[name](spark, FOLDER).collect()]
    want = [r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted(ids) == sorted(want)


def test_one_row_per_word(spark):
    words = [r["word"] for r in QUERIES["op11_spelling_variants"](spark, FOLDER).collect()]
    assert len(words) == len(set(words)) > 100
