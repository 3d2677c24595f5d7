"""The mix against its rules in plain Python."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from castloom.llm import mixing
from tests.llm.cases import documents, empty, rows, words


def shares(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    """Targets by handing out and taking back until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(epochs * sizes[s] for s in full)
        by = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if by[s] > epochs * sizes[s]}
        if not over:
            return {s: float(epochs * sizes[s]) if s in full else by[s] for s in order}
        full |= over


def check(spark, table, **options):
    found = mixing.mix(documents(spark, table), **options).collect()
    sizes = Counter()
    for r in table:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = shares(sizes, **options)
    taken = Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= options.get("epochs", 2) * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= 1
    assert sorted(map(repr, (r[0] for r in table))) == sorted(repr(r["doc_id"]) for r in found)


def test_cases(spark):
    check(spark, rows())
    check(spark, rows(), weights=(1, 5), share=0.4, epochs=3)


def test_hot_source_spans_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    rest = (None, 1, True, 2, 3, "f", "key", "told", 4)
    table = [(i, words(i, 1 + i % 9), "en", "hot" if i % 3 else "é", *rest) for i in range(300)]
    check(spark, table + rows())


def test_reruns_agree(spark):
    a, b = (sorted(map(repr, mixing.mix(documents(spark).repartition(n)).collect())) for n in (1, 7))
    assert a == b


def test_mixed_emits_what_mix_takes(spark):
    docs = documents(spark)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    copies = Counter(r["doc_id"] for r in out.collect())
    plan = defaultdict(int)
    for r in mixing.mix(docs).where("size > 0").collect():
        plan[r["doc_id"]] += r["taken"] // r["size"] + (2 * (r["taken"] % r["size"]) >= r["size"] > r["taken"] % r["size"] > 0)
    assert copies == {k: v for k, v in plan.items() if v}


def test_word_count(spark):
    df = documents(spark).select("text", mixing.word_count(F.col("text")).alias("n"))
    assert all(r["n"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in df.collect())


def test_empty(spark):
    assert mixing.mix(empty(spark)).collect() == []
    assert mixing.mixed(empty(spark)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
