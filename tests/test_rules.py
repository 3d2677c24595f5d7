"""Rules that are easy to get wrong, checked against plain loops and literal cases."""

import random
from datetime import datetime, timedelta
from difflib import get_close_matches

import pytest
from pyspark.sql import functions as F

from castloom.functions import documents as doc
from castloom.functions import text, urls
from castloom.operators import cache, costs, feeds, ordered
from castloom.operators import transcripts as tr
from castloom.sources.feeds import read_feeds


def _one(spark, column, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(column(F.col("x"))).first()[0]


def _by_hand(names):
    used, out = set(), []
    for name in names:
        chosen, n = name, 2
        while chosen in used:
            chosen, n = f"{name}-{n}", n + 1
        used.add(chosen)
        out.append(chosen)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_unique_names_match_a_loop(spark, seed):
    rng = random.Random(seed)
    names = [rng.choice(["a", "a-2", "a-3", "a-2-2", "b", "b-2"]) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(names)), "no bigint, base string")
    got = feeds.unique_names(df, "base", "no").orderBy("no").collect()
    assert [r["name"] for r in got] == _by_hand(names)


def test_closest_feed_matches_the_standard_library(spark):
    rng = random.Random(1)
    shown = [f"the grand show {i}" for i in range(6)] + ["daily news hour", "deep dives", "talk of town"]
    stored = [(f"k{i}", i, s) for i, s in enumerate(shown)]
    names = []
    for s in shown * 3:
        letters = list(s)
        for _ in range(rng.randint(1, 3)):
            letters[rng.randrange(len(letters))] = rng.choice("abcxyz ")
        names.append("".join(letters))
    feeds_df = spark.createDataFrame(stored, "feed string, feed_no bigint, display_name string")
    asked = spark.createDataFrame(list(enumerate(names)), "name_id bigint, name string")
    got = {r["name_id"]: r["feed"] for r in feeds.resolve_feed(asked, feeds_df).collect()}

    def key(s):
        return "-".join("".join(c if c.isalnum() else " " for c in s.lower()).split())

    by_slug = {key(s): f for f, _, s in stored}
    for i, name in enumerate(names):
        near = get_close_matches(key(name), list(by_slug), n=1, cutoff=0.82)
        assert got[i] == (by_slug[near[0]] if near else None), name


def test_evict_matches_a_loop(spark):
    as_of, rng = datetime(2024, 6, 1), random.Random(5)
    files = [
        (i, rng.randint(1, 50), as_of - timedelta(days=rng.randint(0, 40)), rng.random() < 0.1)
        for i in range(200)
    ]
    df = spark.createDataFrame(files, "file_id bigint, size_bytes bigint, cached_at timestamp, protected boolean")
    got = {(r["file_id"], r["reason"]) for r in cache.evict(df, 1500, as_of, 30).collect()}
    want, rest = set(), []
    for f in files:
        if not f[3] and as_of - f[2] > timedelta(days=30):
            want.add((f[0], "expired"))
        else:
            rest.append(f)
    total = sum(f[1] for f in rest)
    for f in sorted(rest, key=lambda f: (f[2], f[0])):
        if total <= 1500:
            break
        if not f[3]:
            want.add((f[0], "size"))
            total -= f[1]
    assert got == want


def test_running_sums_hold_for_one_hot_key(spark):
    rows = [(i % 10 == 0, i, 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "k boolean, o bigint, v bigint")
    got = ordered.running_sums(df, ["k"], ["o"], {"s": F.col("v")}).where("NOT k")
    assert got.agg(F.max("s")).first()[0] == 2700
    assert got.where("o = 2999").first()["s"] == 2700


def test_neighbour_crosses_partitions(spark):
    df = spark.range(500).select(F.lit("a").alias("k"), F.col("id").alias("o"))
    got = ordered.neighbour(df, ["k"], ["o"], "o", "n")
    assert got.where("n = o + 1").count() == 499
    assert got.where("n IS NULL").first()["o"] == 499


@pytest.mark.parametrize(
    "given, want",
    [("Étude One", "étude-one"), ("  A_b--C!  ", "a-b-c"), ("x" * 60, "x" * 50)],
)
def test_slug(spark, given, want):
    assert _one(spark, text.slug, given) == want


def test_first_typed_enclosure_decides(spark):
    row = spark.sql(
        "SELECT array(named_struct('type', 'audio/mpeg', 'href', '', 'url', CAST(NULL AS STRING))) AS e, "
        "array(named_struct('rel', 'enclosure', 'href', 'x')) AS l, 'a' AS link, 'abcdefghijk' AS v"
    )
    assert row.select(feeds.media_url(F.col("link"), F.col("e"), F.col("l"), F.col("v"))).first()[0] is None


def test_video_id_of_ten_characters_is_refused(spark):
    row = spark.sql(
        "SELECT CAST(NULL AS STRING) AS link, CAST(array() AS array<struct<type:string,href:string,url:string>>) AS e, "
        "CAST(array() AS array<struct<rel:string,href:string>>) AS l, '0123456789' AS v"
    )
    assert row.select(feeds.media_url(F.col("link"), F.col("e"), F.col("l"), F.col("v"))).first()[0] is None


@pytest.mark.parametrize(
    "d, chunks", [(0, 0), (29, 1), (599, 1), (600, 2), (901, 2), (1500, 3)]
)
def test_chunk_plan(spark, d, chunks):
    df = spark.createDataFrame([(float(d),)], "duration_s double")
    assert tr.chunk_plan(df).count() == chunks


def test_transcript_speakers(spark):
    said = "SUMMARY: short\n\nIntro\n[00:05] Ann: hi\n[1:02:03] Bob Q: bye [9] x"
    df = spark.createDataFrame([(1, said)], "episode_id bigint, text string")
    rows = tr.parse_transcript(df, "episode_id").orderBy("seg_no").collect()
    assert [(r["text"], r["start_s"]) for r in rows] == [
        ("[00:05] Ann: hi", 5.0), ("[1:02:03] Bob Q: bye [9] x", 3723.0),
    ]
    assert _one(spark, tr.transcript_summary, said) == "short"


def test_stamp_without_colon_is_no_segment(spark):
    df = spark.createDataFrame([(1, "[00:05] no colon here")], "episode_id bigint, text string")
    rows = tr.parse_transcript(df, "episode_id").collect()
    assert [(r["text"], r["start_s"]) for r in rows] == [("[00:05] no colon here", 0.0)]


@pytest.mark.parametrize(
    "given, want",
    [("{}", None), ('{"a": "[[[["}', None), ("[" * 10 + "1" + "]" * 10, None),
     ("[" * 11 + "1" + "]" * 11, "too deep"), ("[" * 11 + "]" * 11, None), ("{", "invalid")],
)
def test_json_depth(spark, given, want):
    assert _one(spark, doc.json_problem, given) == want


def test_empty_ledger(spark):
    empty = spark.createDataFrame(
        [], "input_tokens bigint, output_tokens bigint, cost_usd double, cost_known boolean"
    )
    row = costs.cost_summary(empty).first()
    assert (row["total_operations"], row["total_cost_usd"], row["total_cost_known"]) == (0, 0.0, True)


def test_titles_and_scheme_less_addresses(spark):
    assert _one(spark, urls.title_from_url, "https://x.test/a/My-Show_1.MP3") == "My Show 1"
    assert _one(spark, urls.title_from_url, "https://x.test/watch?v=1") is None
    assert _one(spark, urls.source_kind, "x.test/a.mp3") == "direct_media"


def test_read_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<rss version='2.0'><channel><title>A</title><item><title>One</title>"
        "<pubDate>Wed, 06 Nov 2024 10:00:00 EST</pubDate>"
        "<enclosure url='https://x/1.mp3' type='audio/mpeg'/></item></channel></rss>"
    )
    (tmp_path / "b.xml").write_text(
        "<feed xmlns='http://www.w3.org/2005/Atom'><title>B</title><entry><title>Two</title>"
        "<updated>2024-11-06T10:00:00Z</updated>"
        "<link rel='enclosure' type='audio/mpeg' href='https://x/2.mp3'/></entry></feed>"
    )
    good, bad = feeds.episodes(read_feeds(spark, str(tmp_path)), datetime(2025, 1, 1))
    rows = {r["title"]: r for r in good.collect()}
    assert bad.count() == 0
    assert rows["One"]["published"] == datetime(2024, 11, 6, 15, 0)
    assert (rows["Two"]["feed"], rows["Two"]["url"]) == ("B", "https://x/2.mp3")
