"""The caller's functions: each row once, tried again, its failure its own."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from castloom.plans import run

QUICK = {"first_wait": 0.01, "longest_wait": 0.02}


@pytest.fixture
def calls(tmp_path):
    """Counts calls by name in files, so that workers and driver see the same."""
    folder = str(tmp_path)

    def called(name):
        with open(os.path.join(folder, name), "a") as file:
            file.write("x")
        return os.path.getsize(os.path.join(folder, name))

    called.counts = lambda: {n: os.path.getsize(os.path.join(folder, n)) for n in os.listdir(folder)}
    return called


def answers(called):
    def fn(row):
        name = row["template_name"][0]
        n = called(name)
        if name == "broken" or (name == "slow" and n < 3):
            raise ValueError("no answer, key sk-ant-abcdefghijklmnopqrstuvwxyz0123456789ABCD")
        told = {"summary": "plain", "quotes": '{"quotes": []}', "bad": "{"}.get(name, "late")
        return pd.DataFrame(
            {"raw_content": [told], "input_tokens": [7], "output_tokens": [3], "cost_usd": [0.5], "cost_known": [True]}
        )

    return fn


def test_extraction(spark, calls):
    work = spark.createDataFrame(
        [("e1", t, "text" if t in ("summary", "slow", "broken") else "json", "p") for t in ("summary", "quotes", "slow", "broken", "bad")],
        "episode_id string, template_name string, expected_format string, prompt string",
    ).withColumn("output_schema", F.lit(None).cast("string"))
    done = run.run_extraction(work, answers(calls.__call__), **QUICK)
    rows = {r["template_name"]: r for r in done.collect()}
    assert len(rows) == 5 and done.count() == 5
    assert rows["summary"]["content_text"] == "plain" and rows["quotes"]["content_json"]
    assert rows["slow"]["success"] and rows["slow"]["cost_usd"] == 0.5
    assert not rows["broken"]["success"] and rows["broken"]["cost_usd"] == 0
    assert "ValueError" in rows["broken"]["error"] and "0123456789ABCD" not in rows["broken"]["error"]
    assert not rows["bad"]["success"]
    # Three actions, but no call again: answers are written down at once.
    assert calls.counts() == {"summary": 1, "quotes": 1, "slow": 3, "broken": 3, "bad": 1}


def test_transcription(spark, calls):
    def fn(row):
        calls(f"{row['chunk'][0]}")
        if row["chunk"][0] == 2:
            raise OSError("gone")
        return pd.DataFrame({"text": [f"[00:4{row['chunk'][0]}] Ann: part {row['chunk'][0]}"]})

    chunks = spark.createDataFrame([("e", c, 600.0 * c) for c in range(3)], "episode_id string, chunk bigint, offset_s double")
    segments, failed = run.run_transcription(chunks, fn, attempts=2, **QUICK)
    assert [(r["episode_id"], r["chunk"], r["error"]) for r in failed.collect()] == [("e", 2, "OSError: gone")]
    assert sorted(r["text"] for r in segments.collect()) == ["[00:40] Ann: part 0", "[00:41] Ann: part 1"]
    assert calls.counts() == {"0": 1, "1": 1, "2": 2}


def test_ocr(spark, calls):
    def fn(row):
        calls(f"{row['page_no'][0]}")
        if row["page_no"][0] == 3:
            raise ValueError("blurred")
        told = ["Hello", "there"] if row["page_no"][0] == 1 else []
        n = len(told)
        return pd.DataFrame(
            {"word_no": range(n), "word": told, "block_no": [1] * n, "par_no": [1] * n, "line_no": [1] * n, "confidence": [90.0] * n}
        )

    images = spark.createDataFrame([("x" if p == 3 else "d", p, bytearray(b"png")) for p in (1, 2, 3)], "doc_id string, page_no bigint, content binary")
    pages = spark.createDataFrame([("x" if p == 3 else "d", p, "", False) for p in (1, 2, 3)], "doc_id string, page_no bigint, text string, failed boolean")
    docs, rejects = run.run_ocr(images, pages, fn, attempts=1, **QUICK)
    told = {r["doc_id"]: r["text"] for r in docs.collect()}
    # A page without words is read all the same; a page that can't be read is missing.
    assert "Hello there" in told["d"] and not told.get("x")
    assert calls.counts() == {"1": 1, "2": 1, "3": 1}


def test_render_with(spark):
    results = spark.createDataFrame([("a", 1), ("b", None)], "name string, n int")
    text = run.render_with(results, lambda rows: rows["name"] + ":" + rows["n"].map(str))
    told = [r[0] for r in results.select(text).collect()]
    assert told[0].startswith("a:1") and told[1].startswith("b:")
