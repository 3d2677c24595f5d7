"""Repeated strings against a table of all strings."""

import random

import numpy as np
import pytest

from castloom.llm import suffixes
from tests.llm.cases import documents, empty, rows, words


def compare(spark, table, length, gram):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(table)], "doc_id int, text string, k1 int, told string")
    found = {r["doc_id"]: tuple(r)[1:5] for r in suffixes.remove_repeats(df.repartition(3), length=length, gram=gram).collect()}
    want = suffixes.brute_force(table, length)
    assert [found[i] for i in range(len(table))] == want


def test_cases(spark):
    found = sorted((repr(r["doc_id"]), tuple(r)[1:5]) for r in suffixes.remove_repeats(documents(spark)).collect())
    want = [(repr(r[0]), w) for r, w in zip(rows(), suffixes.brute_force([r[1] for r in rows()]), strict=True)]
    assert found == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_near_copies(spark, seed):
    """Edited copies of a few texts, so that steps and single strings have to be told apart."""
    rng, table = random.Random(seed), []
    bases = [words(seed * 10 + i, 150) for i in range(4)]
    for _ in range(40):
        text = list(rng.choice(bases))
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 3)] = rng.choice(["", "ü", "zz", "q"])
        table.append("".join(text)[rng.randint(0, 50) :])
    compare(spark, table, 60, 16)


def test_few_letters_and_periods(spark):
    rng = random.Random(9)
    table = ["".join(rng.choices("ab", k=rng.randint(0, 120))) for _ in range(40)]
    table += ["ab" * 100, "a" * 90, "ab" * 30 + "c" + "ab" * 30, None, ""]
    compare(spark, table, 24, 8)


def test_blocks(monkeypatch):
    raw = (words(40, 300) + "x" * 700 + words(41, 300)).encode()
    whole = suffixes.anchors(raw)
    monkeypatch.setattr(suffixes, "BLOCK", 97)
    assert all(np.array_equal(a, b) for a, b in zip(whole, suffixes.anchors(raw), strict=True))


def test_runs_cover_all_windows():
    rng = np.random.default_rng(1)
    for n, width, top in ((50, 7, 5), (300, 20, 1 << 62), (2000, 337, 1 << 63)):
        h = rng.integers(0, top, n).astype(np.uint64)
        place, first, last = suffixes._runs(h, width)
        got = np.concatenate([np.full(b - a + 1, p) for p, a, b in zip(place, first, last, strict=True)])
        assert got.tolist() == [i + int(h[i : i + width].argmin()) for i in range(n - width + 1)]


def test_empty(spark):
    assert suffixes.remove_repeats(empty(spark)).collect() == []


def test_planted_passages_go(spark):
    """A passage of 400 bytes or more in several texts goes in all of them, a shorter one stays."""
    rng = random.Random(12)
    planted, texts = [words(900 + i, 140)[: rng.randint(400, 700)] for i in range(20)], []
    short = [words(950 + i, 140)[:390] for i in range(20)]
    for i, passage in enumerate(planted + short):
        for copy in range(2 + i % 3):
            texts.append(f"{words(2000 + 10 * i + copy, 60)}\n{passage}\n{words(5000 + 10 * i + copy, rng.randint(5, 90))}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    gone = {r["doc_id"]: r["n_removed"] for r in suffixes.remove_repeats(docs.repartition(3)).collect()}
    at = 0
    for i, passage in enumerate(planted + short):
        for _ in range(2 + i % 3):
            assert (gone[at] >= len(passage)) == (i < len(planted)) and (gone[at] == 0) == (i >= len(planted))
            at += 1
