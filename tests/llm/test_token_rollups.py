"""Totals after every batch against totals counted anew."""

import random
from collections import Counter

import pytest

from castloom.llm.base import scratch
from castloom.llm.token_rollups import Rollup

SCHEMA = "op string, doc_id bigint, version string, source string, lang string, tokens bigint, seq int, docs int, sign int"


def totals(rollup):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}


def counted(state):
    sums, docs = Counter(), Counter()
    for (_, version), (source, lang, tokens) in state.items():
        sums[source, lang, version] += tokens
        docs[source, lang, version] += 1
    return {k: (docs[k], sums[k]) for k in docs}


def test_batches(spark):
    rng, state = random.Random(3), {}
    rollup = Rollup(spark, scratch(spark, "test"))
    for batch in range(1, 5):
        rows = []
        for seq in range(60):
            key = (rng.choice([None, *range(25)]), rng.choice(["v1", "v2", None]))
            value = (rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice([0, 5, 7, 11]))
            op = rng.choice(["insert", "revise", "delete"])
            rows.append((op, *key, *value, seq, 1, 1))
            if op == "delete":
                state.pop(key, None)
            else:
                state[key] = value
        changes = spark.createDataFrame(rows, SCHEMA)
        assert rollup.apply(batch, changes)
        assert totals(rollup) == counted(state)
        assert not rollup.apply(batch, changes)
        assert totals(rollup) == counted(state)
    with pytest.raises(ValueError):
        rollup.apply(0, changes)


def test_a_lost_batch_is_written_again(spark):
    rollup = Rollup(spark, scratch(spark, "test"))
    one = spark.createDataFrame([("insert", 1, "v", "s", "en", 5, 0, 1, 1)], SCHEMA)
    two = spark.createDataFrame([("revise", 1, "v", "s", "en", 9, 0, 1, 1)], SCHEMA)
    rollup.apply(1, one)
    # Half a batch: its state and deltas are there, the commit is not.
    two.selectExpr("doc_id", "version", "source", "lang", "1000 tokens", "false deleted", "2L batch").write.parquet(f"{rollup.folder}/state/2")
    two.selectExpr("source", "lang", "version", "7L docs", "1000L tokens", "2L batch").write.parquet(f"{rollup.folder}/deltas/2")
    assert totals(rollup) == {("s", "en", "v"): (1, 5)}
    assert rollup.apply(2, two)
    assert totals(rollup) == {("s", "en", "v"): (1, 9)}


def test_repeats_nulls_and_nothing(spark):
    rollup = Rollup(spark, scratch(spark, "test"))
    assert rollup.totals().collect() == []
    assert rollup.apply(1, spark.createDataFrame([], SCHEMA))
    rows = [("insert", 1, "v", "s", "en", 5, 0, 1, 1)] * 3 + [("insert", 2, "v", "s", "en", None, 0, 1, 1), ("delete", 9, "v", "s", "en", 4, 0, 1, 1)]
    rollup.apply(2, spark.createDataFrame(rows, SCHEMA))
    assert totals(rollup) == {("s", "en", "v"): (2, 5)}
    rollup.apply(3, spark.createDataFrame([("delete", 1, "v", None, None, None, 0, 1, 1), ("delete", 2, "v", None, None, None, 0, 1, 1)], SCHEMA))
    assert totals(rollup) == {}
