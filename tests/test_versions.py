"""Versioned tables: lost and late writers, repeats, older versions."""

import pytest
from pyspark.sql import functions as F

from castloom.operators.rows import new_rows
from castloom.session import shared_dir
from castloom.sinks import versions
from castloom.streaming import streams

SCHEMA = "usage_id string, cost double"


def rows(spark, *ids, cost=1.0):
    return spark.createDataFrame([(i, cost) for i in ids], SCHEMA)


def ids(df):
    return sorted(r["usage_id"] for r in df.collect())


@pytest.fixture
def path(spark, request):
    return f"{shared_dir(spark)}/{request.node.name}"


def replace(stored, batch):
    return new_rows(stored, batch, "usage_id").unionByName(batch)


def test_versions_can_be_read_again(spark, path):
    table = versions.Table(spark, path, "usage_id", buckets=4)
    assert table.manifest() is None
    with pytest.raises(FileNotFoundError):
        table.read()
    table.merge(rows(spark, "a", "b", "c"), replace)
    before = table.read()
    table.merge(rows(spark, "b", "d", cost=2.0), replace)
    assert table.versions() == [0, 1]
    assert ids(before) == ids(table.read(0)) == ["a", "b", "c"]
    assert {tuple(r) for r in table.read().collect()} == {("a", 1.0), ("b", 2.0), ("c", 1.0), ("d", 2.0)}


def test_untouched_buckets_are_shared(spark, path):
    table = versions.Table(spark, path, "usage_id", buckets=16)
    first = table.merge(rows(spark, *map(str, range(200))), replace)
    second = table.merge(rows(spark, "7", cost=5.0), replace)
    assert sum(first.parts[b] != second.parts[b] for b in first.parts) == 1
    assert table.read().count() == 200 and table.read().where("cost = 5").count() == 1


def test_what_a_lost_writer_left_is_not_seen(spark, path):
    versions.append_ledger(rows(spark, "a"), path)
    table = versions.ledger_table(spark, path)
    table.stage(rows(spark, "lost"))
    versions.append_ledger(rows(spark, "a", "b", "b"), path)
    assert ids(table.read()) == ["a", "b"]
    folders = len(table._names(f"{path}/data"))
    table.sweep()
    assert len(table._names(f"{path}/data")) < folders
    assert table.versions() == [1] and ids(table.read()) == ["a", "b"]


def test_the_second_of_two_writers_is_refused(spark, path):
    table = versions.ledger_table(spark, path)
    versions.append_ledger(rows(spark, "a"), path)

    def overtaken(stored, batch):
        versions.append_ledger(rows(spark, "first"), path)
        return batch

    with pytest.raises(versions.Conflict):
        table.merge(rows(spark, "second"), overtaken)
    assert ids(table.read()) == ["a", "first"]
    with pytest.raises(ValueError):
        table.merge(rows(spark, "a").drop("cost"), replace)


def test_a_batch_sent_again_changes_nothing(spark, path):
    for number in (0, 1, 1, 0):
        versions.append_ledger(rows(spark, f"n{number}"), path, writer="w", number=number)
    table = versions.ledger_table(spark, path)
    assert table.versions() == [0, 1] and ids(table.read()) == ["n0", "n1"]


def test_rows_may_all_go(spark, path):
    table = versions.Table(spark, path, "usage_id", buckets=2)
    table.merge(rows(spark, "a", "b"), replace)
    table.merge(rows(spark, "a", "b"), lambda stored, batch: batch.where("false"))
    assert ids(table.read()) == []
    table.merge(rows(spark), replace)
    assert table.versions() == [0, 1, 2] and ids(table.read()) == []


def test_cost_windows_in_update_mode(spark, path):
    kind = "usage_id string, provider string, input_tokens bigint, output_tokens bigint, cost_usd double, used_at timestamp"

    def deliver(*records):
        told = [(i, "p", 1, 1, 1.0, f"2024-01-01 {t}") for i, t in records]
        rows = spark.createDataFrame(told, kind.replace("timestamp", "string"))
        rows.withColumn("used_at", F.to_timestamp("used_at")).write.mode("append").parquet(f"{path}/in")

    def run():
        source = streams.file_stream(spark, f"{path}/in", kind)
        return streams.run_costs(source, f"{path}/out/table", checkpoint=f"{path}/out/checkpoint")

    def windows(table, version=None):
        return {(r["window_start"].hour, r["records"]) for r in table.read(version).collect()}

    deliver(("a", "10:05:00"), ("b", "11:05:00"), ("a", "10:05:00"))
    table = run()
    assert windows(table) == {(10, 1), (11, 1)}
    known = table.versions()
    deliver(("c", "10:50:00"), ("b", "11:05:00"), ("d", "11:30:00"))
    assert windows(run()) == {(10, 2), (11, 2)}
    assert windows(table, known[-1]) == {(10, 1), (11, 1)}
    done = table.versions()
    assert run().versions() == done
