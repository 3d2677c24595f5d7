"""Readers and writers on a few files."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from castloom.sinks import notes as sink
from castloom.sources import files
from castloom.sources.feeds import empty_feeds, read_cut_feeds, read_feeds
from castloom.sources.templates import read_templates


def test_notes_of_known_episodes_only(spark, tmp_path):
    for episode, text in (("e1", "---\ntemplate_version: '1.1'\n---\n\nBody"), ("e2", "Plain")):
        folder = tmp_path / "pod" / episode
        folder.mkdir(parents=True)
        (folder / "summary.md").write_text(text)
        (folder / "quotes.md").write_text(text)
    meta = spark.createDataFrame(
        [("pod", "e1", {"quotes": "2.0"})],
        "podcast_dir string, episode_dir string, templates_versions map<string,string>",
    )
    rows = {r["template_name"]: r for r in files.read_notes(spark, str(tmp_path), meta).collect()}
    assert {n: (r["version"], r["content"]) for n, r in rows.items()} == {
        "summary": ("1.1", "Body"), "quotes": ("2.0", "Body"),
    }
    versions = {r["version"] for r in files.read_notes(spark, str(tmp_path)).where("episode_dir = 'e2'").collect()}
    assert versions == {"unknown"}


def test_missing_usage_ids_are_stable(spark, tmp_path):
    row = {"provider": "gemini", "input_tokens": 3, "output_tokens": 4, "timestamp": "2024-01-02T03:04:05"}
    (tmp_path / "costs.json").write_text(json.dumps([row, row, {**row, "usage_id": "u"}]))
    first = files.read_usage(spark, str(tmp_path)).orderBy("usage_id").collect()
    again = files.read_usage(spark, str(tmp_path)).orderBy("usage_id").collect()
    assert first == again and len({r["usage_id"] for r in first}) == 3
    assert first[0]["total_tokens"] == 7 and first[0]["used_at"] == datetime(2024, 1, 2, 3, 4, 5)


def test_texts_that_cannot_be_used_are_rejected(spark, tmp_path):
    (tmp_path / "a.md").write_text("good")
    (tmp_path / "b.txt").write_text(" \n")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "d.bin").write_text("ignored")
    good, bad = files.read_texts(spark, str(tmp_path))
    assert [r["text"] for r in good.collect()] == ["good"]
    assert sorted(r["reasons"][0] for r in bad.collect()) == ["empty", "not UTF-8"]


def test_user_template_shadows_builtin(spark, tmp_path):
    (tmp_path / "summary.yaml").write_text(
        "name: summary\nversion: '9'\ndescription: d\nsystem_prompt: s\n"
        "user_prompt_template: 'x {{ transcript }}'\nexpected_format: text\n"
    )
    rows = {r["name"]: r["version"] for r in read_templates(spark, tmp_path).collect()}
    assert rows["summary"] == "9" and rows["quotes"] == "2.0" and len(rows) == 6


def test_cut_and_empty_feeds(spark, tmp_path):
    item = "<item><title>T</title><enclosure url='u' type='audio/x'/></item>"
    (tmp_path / "cut.xml").write_text(f"<rss><channel><title>A</title>{item}{item}<item><ti")
    (tmp_path / "none.xml").write_text("<rss><channel><title>B</title></channel></rss>")
    path = str(tmp_path)
    assert read_feeds(spark, path).count() == 0
    assert read_cut_feeds(spark, path).count() == 2
    assert empty_feeds(spark, path).select("reason").collect()[0][0] == "no entries"


def test_existing_episode_needs_overwrite(spark, tmp_path):
    rows = spark.createDataFrame(
        [("p", "e", 1, "a.md", "a", "1", "x", 0.5), ("p", "f", 1, "a.md", "a", "1", "x", 0.5)],
        "podcast_slug string, episode_slug string, file_no bigint, filename string, "
        "template_name string, template_version string, content string, cost_usd double",
    ).withColumn("size_bytes", F.lit(1).cast("bigint"))
    path = str(tmp_path / "notes")
    sink.write_notes(rows, path)
    one = rows.where("episode_slug = 'e'").withColumn("content", F.lit("new"))
    with pytest.raises(FileExistsError):
        sink.write_notes(one, path)
    sink.write_notes(one, path, overwrite=True)
    got = {r["episode_slug"]: r["content"] for r in spark.read.parquet(path).collect()}
    assert got == {"e": "new", "f": "x"}
