"""Shapes that grow: hot keys, many names, long transcripts, streams over several batches."""

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from castloom.catalog import library as library_queries
from castloom.catalog import transcripts as transcript_queries
from castloom.functions import text
from castloom.operators import costs, feeds, ordered
from castloom.operators import transcripts as tr
from castloom.session import shared_dir, staged
from castloom.sinks import notes as sink
from castloom.sources import files
from castloom.streaming import streams
from tests.oracle import ROOT


@pytest.fixture
def cut(monkeypatch):
    """Keys of over 50 rows are hot."""
    monkeypatch.setattr(ordered, "HOT_ROWS", 50)
    monkeypatch.setattr(ordered, "PARTS", 8)


def _rows(n=400, seed=3):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 1, 5])) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("keys", [["k"], []])
def test_cut_keys_give_the_same_sums_and_neighbours(spark, cut, keys):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint").repartition(5)
    sums = {r["o"]: r["s"] for r in ordered.running_sums(df, keys, ["o"], {"s": F.col("v")}).collect()}
    after = {r["o"]: r["n"] for r in ordered.neighbour(df, keys, ["o"], "v", "n").collect()}
    before = {r["o"]: r["n"] for r in ordered.neighbour(df, keys, ["o"], "v", "n", following=False).collect()}
    groups = {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(k if keys else 0, []).append((o, v))
    for own in groups.values():
        total = None
        for i, (o, v) in enumerate(own):
            total = total if v is None else (total or 0) + v
            assert sums[o] == total
            assert after[o] == (own[i + 1][1] if i + 1 < len(own) else None)
            assert before[o] == (own[i - 1][1] if i else None)


def test_one_exchange_of_the_rows_without_a_hot_key(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    plan = ordered.running_sums(df, ["k"], ["o"], {"s": F.col("o")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Scan ExistingRDD" not in plan


def test_close_candidates_are_few_and_miss_none(spark):
    from difflib import SequenceMatcher

    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    stored = [f"{word(rng.randint(4, 9))}-{word(rng.randint(4, 9))}" for _ in range(2000)]
    asked = []
    for i in range(2000):
        name = list(stored[i]) if i % 2 else list(f"{word(7)}-{word(8)}")
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(name))
            name[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "q"])
        asked.append("".join(name))
    left = spark.createDataFrame([(a,) for a in asked], "_slug string").distinct()
    right = spark.createDataFrame([(s,) for s in stored], "_key string").distinct()
    found = {tuple(r) for r in feeds.close_candidates(left, right).collect()}
    assert len(found) < 0.05 * 2000 * 2000
    for i in range(1, 2000, 2):
        if SequenceMatcher(None, stored[i], asked[i]).ratio() >= feeds.CLOSE_RATIO:
            assert (asked[i], stored[i]) in found
    for a in asked[:60]:
        for s in stored:
            if SequenceMatcher(None, s, a).ratio() >= feeds.CLOSE_RATIO:
                assert (a, s) in found


def test_a_common_first_word_brings_no_names_together(spark):
    from difflib import SequenceMatcher

    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    stored = [f"the-great-show-{word(rng.randint(6, 12))}" for _ in range(1500)]
    asked = [s.replace("great", "graet") if i % 3 else f"the-great-shaw-{word(9)}" for i, s in enumerate(stored)]
    left = spark.createDataFrame([(a,) for a in asked], "_slug string").distinct()
    right = spark.createDataFrame([(s,) for s in stored], "_key string").distinct()
    found = {tuple(r) for r in feeds.close_candidates(left, right).collect()}
    assert len(found) < 0.05 * 1500 * 1500
    close = lambda s, a: SequenceMatcher(None, s, a).ratio() >= feeds.CLOSE_RATIO
    for i, (a, s) in enumerate(zip(asked, stored, strict=True)):
        assert (a, s) in found or not close(s, a), i
    for a in rng.sample(asked, 40):
        assert {(a, s) for s in stored if close(s, a)} <= found


def test_short_and_odd_names_miss_no_close_one(spark):
    from difflib import SequenceMatcher

    rng = random.Random(6)
    names = sorted({"".join(rng.choices("ab-é", k=rng.randint(1, 14))) for _ in range(250)} | {"a" * 30, "ab" * 40})
    df = spark.createDataFrame([(n,) for n in names], "_slug string")
    found = {tuple(r) for r in feeds.close_candidates(df, df.withColumnRenamed("_slug", "_key")).collect()}
    for a in names:
        for s in names:
            if SequenceMatcher(None, s, a).ratio() >= feeds.CLOSE_RATIO:
                assert (a, s) in found


def test_segments_of_any_length_take_two_cells(spark):
    ends = [1.0, 59.0, 61.0, 3600.0, 3.2e7, 1e12, float("inf")]
    data = [("e", i, f"t{i}", 30.0 * i, d) for i, d in enumerate(ends)] + [("e", 99, "zero", 5.0, 0.0)]
    segments = spark.createDataFrame(data, "episode_id string, seg_no bigint, text string, start_s double, duration_s double")
    cells = tr._in_cells(segments, F.col("start_s"), F.col("start_s") + F.col("duration_s"))
    assert max(r["count"] for r in cells.groupBy("seg_no").count().collect()) <= 2
    times = [0.0, 0.5, 1.0, 29.0, 45.0, 100.0, 119.9, 3000.0, 1e7, 1e11, 5e12]
    probes = spark.createDataFrame([("e", t) for t in [*times, -1.0]], "episode_id string, at_s double")
    got = {r["at_s"]: r["seg_no"] for r in tr.segment_at(segments, probes).collect()}
    for t in [*times, -1.0]:
        assert got[t] == min((n for _, n, _, s, d in data if d > 0 and s <= t < s + d), default=None)
    spans = [(a, b) for a in times for b in [*times, float("inf"), -5.0]]
    ranges = spark.createDataFrame([("e", *x) for x in spans], "episode_id string, from_s double, to_s double")
    pairs = sorted((r["from_s"], r["to_s"], r["seg_no"]) for r in tr.segments_in_range(segments, ranges).collect())
    want = sorted((a, b, n) for a, b in spans for _, n, _, s, d in data if s < b and s + d > a)
    assert pairs == want


def test_transcripts_and_headings_are_cut_once_and_stay_in_their_task(spark):
    from castloom.operators import results

    df = spark.createDataFrame([(1, "x")], "episode_id int, text string")
    for parsed in (tr.parse_transcript(df, "episode_id"), tr.parse_transcript_lines(df, "episode_id")):
        plan = parsed._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1 and plan.count("regexp_extract_all(") <= 3
    plan = results.headings(df, F.col("text"), "episode_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_many_clashing_names_take_no_quadratic_step(spark, cut):
    n = 3000
    names = [("show" if i % 2 else f"show-{i + 1}") for i in range(n)]
    df = spark.createDataFrame(list(enumerate(names)), "no bigint, base string")
    got = [r["name"] for r in feeds.unique_names(df, "base", "no").orderBy("no").collect()]
    used, want, nxt = set(), [], 2
    for name in names:
        if name in used:
            while f"show-{nxt}" in used and name == "show":
                nxt += 1
            k, chosen = nxt if name == "show" else 2, ""
            while (chosen := f"{name}-{k}") in used:
                k += 1
            name = chosen
        used.add(name)
        want.append(name)
    assert got == want and len(set(got)) == n


def test_long_transcripts_are_parsed_in_proportion(spark):
    def seconds(stamps, copies, parse):
        told = "\n".join(f"[{i // 60:02d}:{i % 60:02d}] Ann: word {i}" for i in range(stamps))
        df = spark.createDataFrame([(i, told) for i in range(copies)], "episode_id int, text string").cache()
        df.count()
        start = time.perf_counter()
        assert parse(df, "episode_id").agg(F.count_if(F.hash("text") != 0)).first()[0] == stamps * copies
        return time.perf_counter() - start

    for parse in (tr.parse_transcript, tr.parse_transcript_lines):
        seconds(2, 10, parse)
        assert seconds(2000, 1, parse) < 5 * seconds(2, 1000, parse) + 2


@pytest.mark.parametrize(
    "given, want",
    [("3rd-part.md", "3Rd Part"), ("what's_new.md", "What'S New"), ("o'NEILL.txt", "O'Neill"), ("été-élan", "Été Élan"), (".md", ".Md")],
)
def test_title_case(spark, given, want):
    df = spark.createDataFrame([(given,)], "x string")
    assert df.select(text.title_case(F.col("x"))).first()[0] == want


def test_clips_cover_long_and_unknown_recordings(spark):
    df = spark.createDataFrame([(1, 7300.0), (2, None)], "id int, duration_s double")
    rows = tr.clip_plan(df).collect()
    assert max(r["end_s"] for r in rows if r["id"] == 1) == 7300
    assert {r["length_assumed"] for r in rows if r["id"] == 2} == {True}
    capped = tr.clip_plan(df, most_s=3600).where("id = 1").collect()
    assert max(r["end_s"] for r in capped) == 3600 and {r["rest_s"] for r in capped} == {3700}


def test_unknown_providers_are_rejects(spark):
    rows = [("u1", "gemini", 10, 10), ("u2", "youtube", 1, 1), ("u3", "nobody", 1, 1)]
    usage = spark.createDataFrame(rows, "usage_id string, provider string, input_tokens bigint, output_tokens bigint")
    good, bad = costs.price(usage, costs.prices(spark), costs.FREE)
    assert {r["usage_id"]: r["cost_usd"] > 0 for r in good.collect()} == {"u1": True, "u2": False}
    assert [r["usage_id"] for r in bad.collect()] == ["u3"]


def test_broken_files_are_told(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps([{"provider": "gemini", "usage_id": "u"}]))
    (tmp_path / "bad.json").write_text("{not json")
    assert files.read_usage(spark, str(tmp_path)).count() == 1
    assert [r["file"].endswith("bad.json") for r in files.unread_usage(spark, str(tmp_path)).collect()] == [True]
    (tmp_path / "log.jsonl").write_text('{"operation": "x", "details": {"a": 1}}\n{"operation": \n')
    good, bad = files.read_audit(spark, str(tmp_path / "log.jsonl"))
    assert [(r["operation"], r["details"]) for r in good.collect()] == [("x", '{"a":1}')]
    assert [r["line"] for r in bad.collect()] == ['{"operation": ']


def test_replacing_an_episode_leaves_other_folders_alone(spark, tmp_path):
    rows = spark.createDataFrame(
        [("p", f"e{i}", 1, "a.md", "a", "1", "old", 0.5, 1) for i in range(40)],
        "podcast_slug string, episode_slug string, file_no bigint, filename string, template_name string, "
        "template_version string, content string, cost_usd double, size_bytes bigint",
    )
    path = str(tmp_path / "notes")
    sink.write_notes(rows, path)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "notes").rglob("*.parquet")}
    sink.write_notes(rows.where("episode_slug = 'e7'").withColumn("content", F.lit("new")), path, overwrite=True)
    kept = [f for f, at in before.items() if f.exists() and f.stat().st_mtime_ns == at]
    assert len(kept) == len(before) - 1
    got = {r["episode_slug"]: r["content"] for r in spark.read.parquet(path).collect()}
    assert got == {f"e{i}": "new" if i == 7 else "old" for i in range(40)}


def test_staged_rows_are_deleted(spark):
    import os

    with staged(spark.range(3).toDF("x")) as rows:
        assert rows.count() == 3
        where = rows.inputFiles()[0].removeprefix("file://")
    assert not os.path.exists(os.path.dirname(where)) and shared_dir(spark)


def _deliver(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_job_states_end(spark, tmp_path):
    schema = "job_id bigint, ts timestamp, seq bigint, status string, stage string"
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    path = str(tmp_path / "jobs")
    deliveries = [
        [(1, at(0), 1, "running", "a"), (1, at(1), 2, "running", "b"), (2, at(1), 1, "running", "a")],
        [(1, at(1), 2, "running", "b"), (1, at(0), 1, "running", "a"), (2, at(2), 2, "running", "a")],
        [(1, at(5), 4, "succeeded", "c"), (1, at(6), 5, "running", "d"), (2, at(7), 3, "failed", "a")],
        [(1, at(8), 6, "running", "e"), (2, at(7), 3, "failed", "a")],
        [(3, at(10_000), 1, "running", "a")],
        [(3, at(20_000), 2, "running", "a")],
    ]
    for rows in deliveries:
        _deliver(spark, path, rows, schema)
    stream = streams.stream_jobs(streams.file_stream(spark, path, schema, 1), "10 minutes", "1 hour")
    emitted = streams.run_to_table(stream, "update", rocksdb=True).orderBy("batch", "job_id").collect()
    told = [(r["batch"], r["job_id"], r["status"], r["stage"]) for r in emitted]
    assert told[:4] == [(0, 1, "running", "b"), (0, 2, "running", "a"), (2, 1, "succeeded", "c"), (2, 2, "failed", "a")]
    assert [t[1] for t in told[4:]].count(1) == 0 and {t[1] for t in told[4:]} == {3}


def test_job_states_go_on_after_a_restart(spark, tmp_path):
    schema = "job_id bigint, ts timestamp, seq bigint, status string, stage string"
    path, base = str(tmp_path / "jobs"), str(tmp_path / "run")
    rng = random.Random(2)
    state = lambda: rng.choice(["running"] * 9 + ["failed"])
    rows = [
        (rng.randrange(20), datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(500)), i, state(), rng.choice("abc"))
        for i in range(400)
    ]
    known, changes = {}, []
    for n in range(4):
        sent = rows[n * 100 : n * 100 + 100] + rows[: n * 20]  # some rows again, and late
        _deliver(spark, path, sent, schema)
        # Each delivery is a run of its own, from the checkpoint of the one before.
        stream = streams.stream_jobs(streams.file_stream(spark, path, schema), "30 days", "30 days")
        emitted = streams.run_to_table(stream, "update", rocksdb=True, base=base)
        for job in {r[0] for r in sent}:
            before = known.get(job)
            if before and before[3] in streams.FINAL:
                continue
            own = sorted((r for r in sent if r[0] == job), key=lambda r: r[1:3])
            ended = [r for r in own if r[3] in streams.FINAL]
            now = ended[0] if ended else max([own[-1], *([before] if before else [])], key=lambda r: r[1:3])
            known[job] = now
            if before is None or before[3:] != now[3:]:
                changes.append((n, job, *now[2:]))
    found = emitted.select(F.dense_rank().over(Window.orderBy("batch")) - 1, "job_id", "seq", "status", "stage")
    assert sorted(map(tuple, found.collect())) == sorted(changes)


def test_late_and_repeated_usage(spark, tmp_path):
    schema = "usage_id string, provider string, input_tokens bigint, output_tokens bigint, cost_usd double, used_at timestamp"
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    path = str(tmp_path / "usage")
    one = lambda i, h: (f"u{i}", "gemini", 1, 1, 1.0, at(h))
    for rows in ([one(1, 1), one(2, 2)], [one(2, 2), one(3, 9)], [one(4, 20)], [one(5, 1), one(6, 21)], [one(99, 500)]):
        _deliver(spark, path, rows, schema)
    source = lambda: streams.file_stream(spark, path, schema, 1)
    ledger = streams.run_to_table(streams.stream_usage(source(), "1 hour"))
    late = streams.late_usage(spark.read.schema(schema).parquet(path), ledger)
    assert [r["usage_id"] for r in late.collect()] == ["u5"]
    windows = streams.run_to_table(streams.stream_costs(source(), "1 hour", None, "1 hour"))
    whole = streams.with_late_costs(windows, late).where("window_start < '2024-01-10'").collect()
    assert {r["window_start"].hour: r["records"] for r in whole} == {1: 2, 2: 1, 9: 1, 20: 1, 21: 1}


def test_many_keywords_meet_few_titles(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    titles = [f"Episode {i}: {word(6)} and {word(7)}" for i in range(10_000)]
    entries = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(titles)], "feed string, position bigint, title string")
    words = [titles[i].split(" and ")[1] for i in range(0, 10_000, 2)] + [word(8) for _ in range(4990)]
    words += ["EPISODE", "e", "pi", "and", "absent here", "9999:", ": ", "qqq", "Episode 77: "]
    asked = spark.createDataFrame([(i, "f", w) for i, w in enumerate(words)], "selector_id int, feed string, selector string")
    good, bad = feeds.select_episodes(entries, asked)
    start = time.perf_counter()
    got = {r["selector_id"]: r["position"] for r in good.collect()}
    assert time.perf_counter() - start < 60
    refused = {r["selector_id"] for r in bad.collect()}
    low = [t.lower() for t in titles]
    for i in [*range(0, 5000, 100), *range(5000, 9990, 500), *range(9990, len(words))]:
        want = next((n for n, t in enumerate(low, 1) if words[i].strip().lower() in t), None)
        assert got.get(i) == want and (i in refused) == (want is None)


def test_names_of_few_letters_move_no_pairs(spark):
    """A task counts what two blocks of keys share: no row per pair is dealt out."""
    rng = random.Random(5)
    told = ["show-" + "".join(rng.choices("0123456789abcdef", k=24)) for _ in range(400)]
    asked = [t[:14] + "zz" + t[16:] for t in told[:200]] + ["shaw-" + "".join(rng.choices("0123456789abcdef", k=24)) for _ in range(200)]
    found = feeds.close_candidates(
        spark.createDataFrame([(a,) for a in asked], "_slug string"),
        spark.createDataFrame([(t,) for t in told], "_key string"),
    )
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} >= set(zip(asked[:200], told[:200], strict=True))


def test_blocks_of_keys_are_compared_each_with_each(spark, monkeypatch):
    monkeypatch.setattr(feeds, "ASKED_BLOCK", 7)
    monkeypatch.setattr(feeds, "STORED_BLOCK", 5)
    keys = spark.createDataFrame([(f"grand-show-{i}",) for i in range(40)], "_slug string")
    found = feeds.close_candidates(keys, keys.withColumnRenamed("_slug", "_key")).count()
    assert found == 40 * 40


def test_notes_are_found_without_moving_their_summaries(spark):
    """The join with sources comes before the texts, which no later exchange moves."""
    plan = library_queries.search_notes(spark, f"{ROOT}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert "_text_no" in joins[0] and "source_id" in joins[1]


def test_stamped_texts_are_dealt_once(spark):
    for query in (transcript_queries.parse_transcript, transcript_queries.parse_transcript_lines):
        plan = query(spark, f"{ROOT}/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1, plan


def test_stamped_texts_of_one_id_are_told_at_once(spark, tmp_path):
    rows = [(1, "a b\u00a0c  d e", "en", "s", 9), (1, "v w x y z\n", "en", "s", 9), (2, " ", "en", "s", 1), (None, "k: [l]", "en", "s", 6)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    told = {r["episode_id"]: r["text"] for r in transcript_queries._stamped(spark, str(tmp_path), "A: ").collect()}
    assert told == {1: "[00:00:00] A: a v b w c x d y\n[00:00:01] A: e z", None: "[00:00:00] A: k; (l)"}
