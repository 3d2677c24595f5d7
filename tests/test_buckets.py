"""Stores in buckets: joins on the key leave them where they lie."""

import re
from datetime import datetime

import pytest

from castloom.plans import extraction as ex
from castloom.session import shared_dir
from castloom.sinks.buckets import read_buckets, write_buckets

AS_OF = datetime(2024, 2, 20)


@pytest.fixture
def joined_by_sorting(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield spark
    spark.conf.set(name, before)


def place(spark, tmp_path):
    return f"{shared_dir(spark)}/buckets-{tmp_path.parent.name}-{tmp_path.name}"


def moves_above(plan, path):
    """Whether an exchange lies between the scan of a folder and the join above it."""
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and path in line)
    depth = len(re.match(r"[ :|+-]*", lines[at])[0])
    for line in reversed(lines[:at]):
        own = len(re.match(r"[ :|+-]*", line)[0])
        if own < depth:
            depth = own
            if "Join" in line:
                return False
            if "Exchange" in line:
                return True
    raise AssertionError("no join above the scan")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cache_stays(joined_by_sorting, tmp_path):
    spark, path = joined_by_sorting, place(joined_by_sorting, tmp_path)
    rows = [(f"k{i}" if i % 50 else None, datetime(2024, 2, 1 + i % 19)) for i in range(500)]
    cache = spark.createDataFrame(rows, "cache_key string, cached_at timestamp")
    write_buckets(cache, path, "cache_key", 16)
    kept = read_buckets(spark, path, "cache_key", 16)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, cache.collect()))
    asked = spark.createDataFrame([(i, f"k{i}") for i in range(0, 900, 3)], "n int, cache_key string")
    found = ex.cache_lookup(asked, kept, AS_OF)
    assert not moves_above(plan_of(found), path.rsplit("/", 1)[-1][:20])
    want = ex.cache_lookup(asked, cache, AS_OF)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_versions_stay(joined_by_sorting, tmp_path):
    spark, path = joined_by_sorting, place(joined_by_sorting, tmp_path)
    key = ["episode_id", "template_name"]
    stored = spark.createDataFrame(
        [(i, t, v) for i in range(200) for t, v in (("a", "1"), ("b", "unknown"))],
        "episode_id int, template_name string, version string",
    )
    write_buckets(stored, path, key, 16)
    kept = read_buckets(spark, path, key, 16)
    work = spark.createDataFrame(
        [(i, t, "1") for i in range(150, 260) for t in "abc"],
        "episode_id int, template_name string, template_version string",
    )
    found = ex.stale_templates(work, kept, keep_fresh=True)
    assert not moves_above(plan_of(found), path.rsplit("/", 1)[-1][:20])
    want = ex.stale_templates(work, stored, keep_fresh=True)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_unbucketed_moves(joined_by_sorting, tmp_path):
    """The check of the plan sees an exchange where there is one."""
    spark, path = joined_by_sorting, place(joined_by_sorting, tmp_path)
    spark.createDataFrame([("k", AS_OF)], "cache_key string, cached_at timestamp").write.parquet(path)
    asked = spark.createDataFrame([(1, "k")], "n int, cache_key string")
    found = ex.cache_lookup(asked, spark.read.parquet(path), AS_OF)
    assert moves_above(plan_of(found), path.rsplit("/", 1)[-1][:20])


def test_no_second_write_and_empty(spark, tmp_path):
    path = place(spark, tmp_path)
    none = spark.createDataFrame([], "k string, `a b` decimal(10, 2)")
    write_buckets(none, path, "k", 8)
    assert read_buckets(spark, path, "k", 8, none.schema).collect() == []
    with pytest.raises(FileExistsError):
        write_buckets(none, path, "k", 8)
