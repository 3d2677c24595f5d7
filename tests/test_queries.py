"""Every registered query of the library against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from castloom import catalog
from tests.oracle import ROOT, compare, connect

FOLDER = str(ROOT / "sf0.001")
#: Queries without rows on the smallest tables, compared on the next larger ones.
LARGER, NEEDS_LARGER = str(ROOT / "sf0.01"), {"latest_n"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    folder, con = (LARGER, connect(LARGER)) if name in NEEDS_LARGER else (FOLDER, duck)
    problem = compare(catalog.QUERIES[name](spark, folder), con, catalog.ORACLES[name])
    assert problem is None, problem


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
