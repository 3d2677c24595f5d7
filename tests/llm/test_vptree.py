"""Nearest neighbours against a full scan."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from castloom.llm import vptree

ASKS = "vec_id % 20 = 0"


def vectors(n=700, dims=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims))
    rows = []
    for i in range(n):
        v = centres[i % 8] + rng.normal(size=dims) * 0.7
        rows.append((i, [float(x) for x in (v * rng.uniform(0.5, 2)).astype(np.float32)]))
    same = rows[3][1]
    rows += [(1000 + i, same) for i in range(90)]  # one vector of many ids, some of which ask
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, rep int, score double")
    out = defaultdict(list)
    for r in vptree.search(df.repartition(3), F.expr(ASKS), **options).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("shard_rows", [8192, 100])
def test_factor_one_is_exact(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(vptree, "LEAF_ROWS", 16)
    rows = vectors()
    found = run(spark, rows, factor=1.0, shard_rows=shard_rows)
    want = vptree.brute_force(rows, 20, lambda i: i % 20 == 0)
    assert {q: [v for _, v, _ in x] for q, x in found.items()} == want
    assert all([r for r, *_ in x] == list(range(1, 21)) for x in found.values())


def test_recall_of_the_default(spark):
    rows = vectors(3000)
    found = run(spark, rows, shard_rows=256)
    want = vptree.brute_force(rows, 20, lambda i: i % 20 == 0)
    hits = sum(len({v for _, v, _ in found[q]} & set(w)) for q, w in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i + 1), 1.0]) for i in range(41)]
    odd = [(60, None), (80, [0.0, 0.0]), (100, [nan, 1.0]), (120, [inf, 1.0]), (140, [None, 1.0]), (None, [1.0, 1.0]), (160, [1.0])]
    found = run(spark, good + odd)
    assert set(found) == {0, 20, 40}
    want = vptree.brute_force(good, 20, lambda i: i % 20 == 0)
    assert {q: [v for _, v, _ in x] for q, x in found.items()} == want


def test_few_rows_repeats_and_equal_distances(spark):
    assert run(spark, [(0, [1.0, 2.0])]) == {}
    assert run(spark, [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (7, [2.0, 2.0])]) == {0: [(1, 7, 6.0)]}
    units = [(i, [1.0 if j == i else 0.0 for j in range(300)]) for i in range(300)]
    found = run(spark, units, factor=1.0)
    assert [v for _, v, _ in found[0]] == list(range(1, 21))


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    out = vptree.search(df, F.expr(ASKS))
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.collect() == []


def test_doubles_keep_their_digits(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = vptree.search(df, F.expr(ASKS), factor=1.0).orderBy("query_id", "rank").collect()
    got = defaultdict(list)
    for r in found:
        got[r["query_id"]].append(r["vec_id"])
        assert r["score"] == pytest.approx(np.dot(rows[r["query_id"]][1], rows[r["vec_id"]][1]), rel=1e-14)
    assert got == vptree.brute_force(rows, 20, lambda i: i % 20 == 0)
