"""Feed entries to episodes, selection by position and keyword, feed name resolution."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from castloom.functions import urls
from castloom.functions.text import fmt_duration, key_slug, strip
from castloom.operators.ordered import positions, running_sums
from castloom.operators.rows import keep_first, keep_last
from castloom.session import shared_dir

#: Fixed values.
MAX_SELECTED = 100
CLOSE_RATIO = 0.82
ZONES = {
    "GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def media_url(entry_link: Column, enclosures: Column, links: Column, video: Column) -> Column:
    """Address of an entry's audio or video.

    The first enclosure typed audio or video decides, even when it has no address; then
    the first enclosure link; then, for video feeds, the entry's link or its watch page.
    """
    kind = lambda e: F.coalesce(e["type"], F.lit(""))
    typed = F.get(
        F.filter(enclosures, lambda e: kind(e).startswith("audio/") | kind(e).startswith("video/")),
        F.lit(0),
    )
    linked = F.get(F.filter(links, lambda x: x["rel"] == "enclosure"), F.lit(0))
    watch = F.when(
        F.regexp_like(video, F.lit(r"^[A-Za-z0-9_-]{11}$")),
        F.concat(F.lit("https://www.youtube.com/watch?v="), video),
    )
    return (
        F.when(typed.isNotNull(), F.coalesce(_some(typed["href"]), _some(typed["url"])))
        .when(linked.isNotNull(), _some(linked["href"]))
        .when(F.coalesce(video, F.lit("")) != "", F.coalesce(_some(entry_link), watch))
    )


def parse_when(text: Column) -> Column:
    """Instant of an RFC 822 or ISO 8601 date, null when it is neither."""
    bare = F.regexp_replace(strip(text), r"^[A-Za-z]{3,9},\s*", "")
    for zone, offset in ZONES.items():
        bare = F.regexp_replace(bare, rf"(?<=[0-9 ]){zone}$", offset)
    spaced = F.regexp_replace(bare, r"\s+", " ")
    mail = F.try_to_timestamp(spaced, F.lit("d MMM yyyy HH:mm[:ss] Z"))
    return F.coalesce(mail, strip(text).try_cast("timestamp"))


def published_at(published: Column, updated: Column, as_of: datetime) -> Column:
    return F.coalesce(parse_when(published), parse_when(updated), F.lit(as_of))


def description(summary: Column, text: Column, content: Column) -> Column:
    """Presence counts, not content: an empty summary wins over a full description."""
    first = F.get(content, F.lit(0))["value"]
    return F.coalesce(summary, text, first, F.lit(""))


def whole_number(text: Column) -> Column:
    """Integer value, null for anything else."""
    plain = strip(text)
    return F.when(F.regexp_like(plain, F.lit(r"^[+-]?\d+$")), plain.try_cast("int"))


def duration_seconds(text: Column) -> Column:
    """Seconds of ``H:M:S``, ``M:S`` or a plain number, null for anything else."""
    parts = F.transform(F.split(text, ":"), whole_number)
    long = parts[0] * 3600 + F.get(parts, F.lit(1)) * 60 + F.get(parts, F.lit(2))
    return (
        F.when(F.size(parts) == 3, long)
        .when(F.size(parts) == 2, parts[0] * 60 + F.get(parts, F.lit(1)))
        .when(F.size(parts) == 1, parts[0])
    )


def episodes(entries: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """Entries as episodes, and those without a title or media address with the reason."""
    url = media_url(F.col("link"), F.col("enclosures"), F.col("links"), F.col("yt_videoid"))
    rows = entries.select(
        "*",
        url.alias("_url"),
        F.when(F.coalesce("title", F.lit("")) == "", "missing title")
        .when(url.isNull(), "no media address")
        .alias("reason"),
    )
    good = rows.where("reason IS NULL").select(
        "feed",
        "position",
        "title",
        F.col("_url").alias("url"),
        published_at(F.col("published"), F.col("updated"), as_of).alias("published"),
        description(F.col("summary"), F.col("description"), F.col("content")).alias("description"),
        duration_seconds(F.col("itunes_duration")).alias("duration_seconds"),
        F.col("feed").alias("podcast_name"),
        whole_number(F.col("itunes_episode")).alias("episode_number"),
        whole_number(F.col("itunes_season")).alias("season_number"),
        F.coalesce(_some(F.col("id")), _some(F.col("guid"))).alias("guid"),
    )
    return good, rows.where("reason IS NOT NULL").select("feed", "position", "title", "reason")


def feed_sizes(entries: DataFrame) -> DataFrame:
    return entries.groupBy("feed").agg(F.count(F.lit(1)).alias("feed_size"))


def latest(feeds: DataFrame, entries: DataFrame, as_of: datetime) -> DataFrame:
    """First entry in feed order per feed, with its status.

    A feed without entries, or whose first entry is no episode, is ``empty``; a feed that
    could not be read (column ``error``) is ``error``.
    """
    first = keep_first(entries, ["feed"], ["position"])
    good, _ = episodes(first, as_of)
    return run_status(feeds.join(good, "feed", "left"))


def run_status(rows: DataFrame) -> DataFrame:
    """Label each feed success, empty or error and keep the text of the error."""
    failed, found = F.col("error").isNotNull(), F.col("title").isNotNull()
    status = F.when(failed, "error").when(found, "success").otherwise("empty")
    told = F.when(failed, F.coalesce(_some(F.col("error")), F.lit("Unknown error"))).when(
        ~found, "No episodes yet"
    )
    return rows.withColumn("status", status).withColumn("error", told)


def latest_summary(rows: DataFrame) -> DataFrame:
    """Feeds in total, read (an empty one counts as read) and failed."""
    failed = F.count_if(F.col("status") == "error")
    return rows.agg(
        F.count(F.lit(1)).alias("total_feeds"),
        (F.count(F.lit(1)) - failed).alias("successful"),
        failed.alias("failed"),
    )


def latest_n(entries: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """First ``n`` entries per feed, and the feeds with fewer than ``n``."""
    if not 1 <= n <= MAX_SELECTED:
        raise ValueError(f"count must be between 1 and {MAX_SELECTED}")
    sizes = feed_sizes(entries)
    enough = sizes.where(F.col("feed_size") >= n).select("feed")
    chosen = entries.where(F.col("position") <= n).join(enough, "feed", "left_semi")
    return chosen, sizes.where(F.col("feed_size") < n)


def latest_view(entries: DataFrame, as_of: datetime, limit: int = 10) -> DataFrame:
    """Listing of each feed's first ``limit`` entries.

    Entries that are no episodes are left out but count in positions and totals.
    """
    good, _ = episodes(entries.where(F.col("position") <= limit), as_of)
    return good.join(feed_sizes(entries), "feed").select(
        "feed",
        "position",
        "title",
        F.date_format("published", "yyyy-MM-dd").alias("day"),
        F.when(
            F.coalesce("duration_seconds", F.lit(0)) != 0, fmt_duration(F.col("duration_seconds"))
        ).alias("duration"),
        "url",
        F.col("feed_size").alias("total"),
        F.least(F.lit(limit), F.col("feed_size")).cast("bigint").alias("showing"),
    )


def feeds_view(feeds: DataFrame) -> DataFrame:
    """Listing of the feeds, with their number."""
    total = feeds.agg(F.count(F.lit(1)))
    return feeds.select(
        "feed",
        F.coalesce(_some(F.col("display_name")), F.col("feed")).alias("display_name"),
        "url",
        F.coalesce("auth_type", F.lit("none")).alias("auth"),
        F.coalesce("category", F.lit("")).alias("category"),
        F.col("custom_templates").alias("extra_templates"),
    ).withColumn("total", total.scalar())


#: Characters of a gram of the title index; shorter words are looked up whole.
GRAM = 3


def _grams_of(text: Column, size: Column) -> Column:
    """The different strings of a size in a text; the empty one for size 0."""
    starts = _range(F.lit(1), F.length(text) - size + 1)
    grams = F.array_distinct(F.transform(starts, lambda at: F.substring(text, at, size)))
    return F.when(size == 0, F.array(F.lit(""))).otherwise(grams)


def _first_titles(words: DataFrame, titles: DataFrame) -> DataFrame:
    """Position of the first title (_feed, _title, position) that contains each (_feed, _word).

    An index of the titles' grams, inside each feed: a word is looked up by that of its grams
    which the fewest titles have, and only these titles are searched for it. A word with a gram
    that no title has is in none.
    """
    sized = words.withColumn("_size", F.least(F.lit(GRAM), F.length("_word")))
    sizes = sized.select("_feed", "_size").distinct()
    index = titles.join(sizes, "_feed").select(
        "_feed", "_title", "position", F.explode(_grams_of(F.col("_title"), F.col("_size"))).alias("_gram")
    )
    often = index.groupBy("_feed", "_gram").agg(F.count("*").alias("_often"))
    asked = sized.select("_feed", "_word", F.explode(_grams_of(F.col("_word"), F.col("_size"))).alias("_gram"))
    rarest = (
        asked.join(often, ["_feed", "_gram"], "left")
        .groupBy("_feed", "_word")
        .agg(F.min(F.struct(F.coalesce("_often", F.lit(0)), "_gram")).alias("_best"))
        .select("_feed", "_word", F.col("_best._gram").alias("_gram"))
    )
    found = rarest.join(index, ["_feed", "_gram"]).where(F.contains("_title", "_word"))
    return found.groupBy("_feed", "_word").agg(F.min("position").alias("position"))


def select_episodes(
    entries: DataFrame, selectors: DataFrame, most: int = MAX_SELECTED
) -> tuple[DataFrame, DataFrame]:
    """Entries named by selectors (selector_id, feed, selector), and refused selectors.

    A selector is a position, a range (either way round), a list (order and repeats are
    kept) or, failing these, a keyword for the first title that contains it. One position
    outside the feed, or more than ``most`` of them, refuses the whole selector.
    """
    text = strip(F.col("selector"))
    number = lambda c: c.try_cast("bigint")
    low = number(F.regexp_extract(text, r"^(\d+)-(\d+)$", 1))
    high = number(F.regexp_extract(text, r"^(\d+)-(\d+)$", 2))
    listed = F.transform(F.split(text, r",\s*"), number)
    many = F.lit(most)
    kind = (
        F.when(F.regexp_like(text, F.lit(r"^\d+$")), "one")
        .when(F.regexp_like(text, F.lit(r"^\d+-\d+$")), "range")
        .when(F.regexp_like(text, F.lit(r"^\d+(,\s*\d+)+$")), "list")
        .otherwise("keyword")
    )
    read = selectors.select(
        "selector_id", "feed", text.alias("_text"), kind.alias("_kind"),
        F.when(kind == "range", F.abs(high - low) + 1)
        .when(kind == "list", F.size(listed).cast("bigint"))
        .otherwise(1)
        .alias("_wanted"),
        F.when(kind == "range", low).alias("_low"),
        F.when(kind == "range", high).alias("_high"),
        F.when(kind.isin("one", "list"), listed).alias("_listed"),
    ).join(feed_sizes(entries), "feed", "left")
    fits = F.coalesce(F.col("_wanted") <= many, F.lit(False))
    asked = read.withColumn(
        "_positions",
        F.when(
            (F.col("_kind") == "range") & fits,
            F.sequence(F.least("_low", "_high"), F.greatest("_low", "_high")),
        ).otherwise(F.col("_listed")),
    )
    size = F.coalesce("feed_size", F.lit(0))
    outside = F.exists("_positions", lambda p: F.coalesce((p < 1) | (p > size), F.lit(True)))
    reason = F.when(F.col("_kind") != "keyword", F.when(~fits, "too many").when(outside, "no such position"))
    judged = asked.withColumn("reason", reason)

    numbered = judged.where("_kind <> 'keyword' AND reason IS NULL").select(
        "selector_id", "feed", F.posexplode("_positions").alias("ordinal", "position")
    )
    by_position = numbered.join(entries, ["feed", "position"])

    words = judged.where("_kind = 'keyword'").select(
        "selector_id", F.col("feed").alias("_feed"), F.lower("_text").alias("_word")
    )
    # Each different word of a feed is looked for once, in the different titles that may hold it.
    first = _first_titles(
        words.select("_feed", "_word").distinct(),
        entries.groupBy(F.col("feed").alias("_feed"), F.lower(F.coalesce("title", F.lit(""))).alias("_title")).agg(
            F.min("position").alias("position")
        ),
    )
    hits = words.join(first, ["_feed", "_word"]).select(
        "selector_id", F.col("_feed").alias("feed"), "position"
    )
    by_word = hits.withColumn("ordinal", F.lit(0)).join(entries, ["feed", "position"])
    missed = words.join(hits.select("selector_id"), "selector_id", "left_anti").select(
        "selector_id", F.lit("no title matches").alias("reason")
    )
    refused = judged.where("reason IS NOT NULL").select("selector_id", "reason")
    columns = ["selector_id", "ordinal", *entries.columns]
    return by_position.select(columns).unionByName(by_word.select(columns)), refused.unionByName(
        missed
    )


def _fold(text: Column) -> Column:
    return F.lower(F.upper(text))


def _edits(own: Column, other: Column) -> Column:
    """Most characters outside the matching blocks of two close keys of these lengths.

    Blocks of a ratio of r or more hold at least r / 2 of all characters.
    """
    return own + other - 2 * F.ceil(CLOSE_RATIO * (own + other) / 2 - 1e-9).cast("int")


def _range(first: Column, last: Column) -> Column:
    """The numbers from ``first`` to ``last``; none if the first is greater."""
    none = F.array().cast("array<int>")
    return F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(none)


def _matched(own, other):
    """Least characters in the matching blocks of two close keys of these lengths."""
    return np.ceil(CLOSE_RATIO * (own + other) / 2 - 1e-9).astype(int)


#: Keys of a block on either side: a task compares one block of each at a time.
ASKED_BLOCK, STORED_BLOCK = 8192, 32768
#: Bits of a key, in words of 64: one for each kind of pair of neighbouring characters.
WORDS = 4


def _pair_bits(keys: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of each key, the bits of its pairs of neighbours (ends included), and how many
    pairs have a bit that another pair of the key has too."""
    lengths = keys.str.len().to_numpy(dtype=int)
    text = np.frombuffer("".join("\u0001" + k + "\u0002" for k in keys).encode("utf-32-le", "surrogatepass"), "uint32")
    row = np.repeat(np.arange(len(keys)), lengths + 2)
    inner = row[1:] == row[:-1]
    pairs = (text[:-1].astype("uint64") << np.uint64(21) | text[1:])[inner]
    bit = (pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    flags = np.zeros((len(keys), 64 * WORDS), bool)
    flags[row[1:][inner], bit.astype(int)] = True
    repeats = lengths + 1 - flags.sum(axis=1)
    return lengths, np.packbits(flags, axis=1).view("uint64"), repeats


def _close_in_blocks(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
    """The pairs of two blocks whose shared pairs of neighbours do not rule them out.

    Close keys share all pairs of neighbours but the spoilt ones: each character outside the
    matching blocks spoils two of its own key's and one of the other's. Pairs that have a bit
    in common are as many kinds, and more by the repeats that both have at most.
    """
    found = []
    if len(asked) and len(stored):
        stored = stored.assign(_len=stored["_key"].str.len()).sort_values("_len", ignore_index=True)
        (own, bits, again), (others, their, theirs) = _pair_bits(asked["_slug"]), _pair_bits(stored["_key"])
        columns = [np.ascontiguousarray(their[:, w]) for w in range(WORDS)]
        needed = {n: _needed(n, others) for n in np.unique(own)}
        spans = {n: _span(n, others) for n in needed}
        for slug, n, mine, more in zip(asked["_slug"], own, bits, again, strict=True):
            some = slice(*spans[n])
            shared = np.bitwise_count(columns[0][some] & mine[0]).astype("uint16")
            for w in range(1, WORDS):
                shared += np.bitwise_count(columns[w][some] & mine[w])
            fits = shared >= needed[n][some] - np.minimum(theirs[some], more)
            found += [(slug, k) for k in stored["_key"].to_numpy()[some][fits]]
    return pd.DataFrame(found, columns=["_slug", "_key"], dtype=object)


def _span(own: int, others: np.ndarray) -> tuple[int, int]:
    """Where the lengths that a close key can have stand in the sorted lengths."""
    fits = np.flatnonzero(_matched(own, others) <= np.minimum(own, others))
    return (int(fits[0]), int(fits[-1]) + 1) if len(fits) else (0, 0)


def _needed(own: int, others: np.ndarray) -> np.ndarray:
    """Pairs of neighbours that close keys of these lengths share at least."""
    return own + 1 - (2 * own + others - 3 * _matched(own, others))


@F.pandas_udf(DoubleType())
def _ratios(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for stored, asked in frames:
        yield pd.Series(
            [SequenceMatcher(None, s, a).ratio() for s, a in zip(stored, asked, strict=True)],
            dtype="float64",
        )


def close_candidates(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """Pairs (_slug, _key) of different rows that may be close; no close pair is missed.

    Both sides are dealt to blocks and each task compares one block of each, so that only the
    keys are moved, never the pairs that are looked at: names of few letters share most of
    their parts with very many others. Time grows with the product of both sides, by some
    nanoseconds a pair; memory is bounded by the blocks, the bytes moved by the keys times the
    blocks of the other side. An edit distance with a bound decides before ratios are counted.
    """
    left = asked.where(F.length("_slug") > 0).select("_slug").distinct()
    right = stored.where(F.length("_key") > 0).select("_key").distinct()
    rows, columns = -(-left.count() // ASKED_BLOCK), -(-right.count() // STORED_BLOCK)
    if not rows or not columns:
        return left.crossJoin(right).where("false")
    spread = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(rows * columns, 4096))

    def dealt(df: DataFrame, key: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return df.select(key, block.alias(own), every.alias(other)).repartition(spread, "_i", "_j")

    a = dealt(left, "_slug", "_i", rows, "_j", columns)
    b = dealt(right, "_key", "_j", columns, "_i", rows)
    named = a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInPandas(
        _close_in_blocks, "_slug string, _key string"
    )
    edits = _edits(F.length("_slug"), F.length("_key"))
    return named.where(F.call_function("levenshtein", F.col("_slug"), F.col("_key"), edits) >= 0)


def resolve_feed(names: DataFrame, feeds: DataFrame) -> DataFrame:
    """Stored feed for each name (name_id, name), null when there is none.

    Tried in turn: the key, the key of the name, the display name in any case, its key,
    and the closest display key. When feeds share a display name the last one stored
    (greatest ``feed_no``) wins.
    """
    asked = names.select("name").distinct().withColumn("_slug", key_slug(F.col("name")))
    shown = feeds.where(F.coalesce("display_name", F.lit("")) != "")

    def lookup(rank: int, rows: DataFrame, key: Column) -> DataFrame:
        keyed = rows.select(F.lit(rank).alias("rank"), key.alias("key"), "feed", "feed_no")
        return keep_last(keyed.where("key <> ''"), ["rank", "key"], ["feed_no"])

    own = feeds.select("feed", "feed_no")
    by_slug = lookup(4, shown, key_slug(F.col("display_name")))
    table = (
        lookup(1, own, F.col("feed"))
        .unionByName(lookup(2, own, F.col("feed")))
        .unionByName(lookup(3, shown, _fold(F.col("display_name"))))
        .unionByName(by_slug)
    )
    keys = F.array(F.col("name"), F.col("_slug"), _fold(F.col("name")), F.col("_slug"))
    tried = asked.select("name", "_slug", F.posexplode(keys).alias("rank", "key")).withColumn(
        "rank", F.col("rank") + 1
    )
    exact = tried.join(table, ["rank", "key"]).groupBy("name").agg(F.min_by("feed", "rank").alias("feed"))

    rest = asked.join(exact, "name", "left_anti").select("_slug").distinct()
    near = (
        close_candidates(rest, by_slug.select(F.col("key").alias("_key")))
        .withColumn("_ratio", _ratios("_key", "_slug"))
        .where(F.col("_ratio") >= CLOSE_RATIO)
    )
    best = near.groupBy("_slug").agg(F.max(F.struct("_ratio", "_key")).alias("_best"))
    close = best.join(by_slug, F.col("_best._key") == F.col("key")).select("_slug", "feed")
    fuzzy = asked.join(close, "_slug").select("name", "feed")
    return names.join(exact.unionByName(fuzzy), "name", "left")


def same_channel(feeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """First stored feed with the channel of each candidate address, null without one."""
    stored = feeds.select("feed", "feed_no", urls.channel_id(F.col("url")).alias("channel_id"))
    first = keep_first(stored.where("channel_id IS NOT NULL"), ["channel_id"], ["feed_no"])
    asked = candidates.withColumn("channel_id", urls.channel_id(F.col("url")))
    return asked.join(first.select("channel_id", "feed"), "channel_id", "left")


def feed_templates(requests: DataFrame, feeds: DataFrame) -> DataFrame:
    """Templates of each request plus its feed's own, first mention kept.

    The feed's category is used only when the request names none.
    """
    stored = feeds.select(
        "feed", F.col("category").alias("_category"), F.col("custom_templates").alias("_extra")
    )
    none = F.array().cast("array<string>")
    return requests.join(stored, "feed", "left").select(
        *[c for c in requests.columns if c not in ("templates", "category")],
        F.array_distinct(F.concat(F.coalesce("templates", none), F.coalesce("_extra", none))).alias(
            "templates"
        ),
        F.coalesce(_some(F.col("category")), F.col("_category")).alias("category"),
    )


def _turn(stage: int, order: Column) -> Column:
    return F.struct(F.lit(stage).alias("stage"), order.alias("order"))


def unique_names(
    df: DataFrame, base: str, order: str, existing: DataFrame | None = None, name: str = "name"
) -> DataFrame:
    """Distinct names: the base, then ``base-2``, ``base-3`` … in input order.

    ``existing`` (column ``name``) is taken before any row. A generated name can meet a
    base that looks like it; whoever comes first has it and the other takes its next
    number. Such meetings are settled on a table of the meeting names alone, parents
    before children, until nothing changes.
    """
    shared_dir(df.sparkSession)
    rows = df.select(F.col(base).alias("_base"), _turn(1, F.col(order)).alias("_at"))
    if existing is not None:
        old = existing.select(
            F.col("name").alias("_base"),
            _turn(0, F.lit(0).cast(df.schema[order].dataType)).alias("_at"),
        )
        rows = rows.unionByName(old)
    numbered = positions(rows, ["_base"], ["_at"], "_k").checkpoint()
    bases = numbered.groupBy("_base").agg(F.min("_at").alias("_first"), F.max("_k").alias("_count"))
    split = r"^(.+)-([1-9][0-9]{0,17})$"
    children = bases.select(
        F.col("_base").alias("_child"),
        F.col("_first"),
        F.regexp_extract("_base", split, 1).alias("_parent"),
        F.regexp_extract("_base", split, 2).try_cast("bigint").alias("_n"),
    ).where("_n >= 2")
    parents = bases.select(F.col("_base").alias("_parent"), "_count")
    meetings = children.join(parents, "_parent").checkpoint()
    final = numbered.withColumn("_n", F.col("_k"))
    if not meetings.isEmpty():
        lost, skipped = _settle(meetings, numbered)
        late = lost.select(F.col("_child").alias("_base"), F.lit(1).cast("bigint").alias("_late"))
        shifted = numbered.join(late, "_base", "left").withColumn(
            "_n", F.col("_k") + F.coalesce("_late", F.lit(0))
        )
        # The i-th number that is skipped shifts every row that would reach it after i - 1.
        holes = positions(skipped.select(F.col("_parent").alias("_base"), "_n"), ["_base"], ["_n"], "_i")
        steps = shifted.select("_base", "_at", "_n", F.lit(1).alias("_row")).unionByName(
            holes.select(
                "_base", F.lit(None).cast(shifted.schema["_at"].dataType).alias("_at"),
                (F.col("_n") - F.col("_i") + 1).alias("_n"), F.lit(0).alias("_row"),
            )
        )
        passed = running_sums(
            steps, ["_base"], ["_n", "_row", "_at"], {"_holes": (1 - F.col("_row")).cast("bigint")}
        )
        final = passed.where("_row = 1").withColumn("_n", F.col("_n") + F.col("_holes"))
    named = final.select(
        F.col("_base"),
        F.col("_at"),
        F.when(F.col("_n") == 1, F.col("_base"))
        .otherwise(F.concat("_base", F.lit("-"), "_n"))
        .alias(name),
    )
    tagged = df.withColumn("_at", _turn(1, F.col(order)))
    back = named.withColumnsRenamed({"_base": "_b", "_at": "_a"})
    return tagged.join(
        back, (F.col("_a") == F.col("_at")) & (F.col("_b") == F.col(base))
    ).drop("_a", "_b", "_at")


def _settle(meetings: DataFrame, numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Children that lose their own name, and the numbers that parents skip.

    A name with k suffixes is settled after its parents, so rounds are bounded by the
    deepest nesting of suffixes among the meeting names.
    """
    turns = numbered.join(
        meetings.select(F.col("_parent").alias("_base")).distinct(), "_base", "left_semi"
    ).select(F.col("_base").alias("_parent"), F.col("_k"), F.col("_at").alias("_taken"))
    turns = turns.checkpoint()
    state = meetings.withColumn("_parent_takes", F.lit(False)).checkpoint()
    while True:
        late = state.where("_parent_takes").select(
            F.col("_child").alias("_parent"), F.lit(1).cast("bigint").alias("_late")
        )
        free = (~F.col("_parent_takes")).cast("bigint")
        counted = running_sums(state, ["_parent"], ["_n"], {"_upto": free})
        below = F.col("_upto") - free
        asked = counted.join(late, "_parent", "left").withColumn(
            "_k", F.col("_n") - F.coalesce("_late", F.lit(0)) - below
        )
        judged = asked.join(turns, ["_parent", "_k"], "left").select(
            "_parent", "_child", "_n", "_first", "_count",
            F.coalesce(F.col("_taken") < F.col("_first"), F.lit(False)).alias("_parent_takes"),
            F.col("_parent_takes").alias("_before"),
        ).checkpoint()
        changed = not judged.where("_parent_takes <> _before").isEmpty()
        state = judged.drop("_before")
        if not changed:
            return state.where("_parent_takes"), state.where("NOT _parent_takes")


def transcript_paths(df: DataFrame, order: str) -> DataFrame:
    """File name per transcript from its title, else its URL, else a fixed word."""
    readable = F.coalesce(
        _some(F.col("title")), urls.title_from_url(F.col("url")), F.lit("transcript")
    )
    base = F.coalesce(_some(key_slug(readable)), F.lit("transcript"))
    named = unique_names(df.withColumn("_slug", base), "_slug", order)
    return named.withColumn("path", F.concat("name", F.lit(".transcript.md"))).drop("_slug", "name")


def dedupe_names(channels: DataFrame, order: str, existing: DataFrame | None = None) -> DataFrame:
    """Feed names for channels (channel_name, feed_url) that clash with nothing stored."""
    base = urls.feed_name_base(F.col("channel_name"), F.col("feed_url"))
    named = unique_names(channels.withColumn("_slug", base), "_slug", order, existing, "feed")
    return named.drop("_slug")


_CHANGES = ("url", "auth_type", "category", "display_name", "custom_templates")


def feed_changes(
    before: DataFrame, after: DataFrame, renames: DataFrame | None = None
) -> DataFrame:
    """Audit rows (operation, feed, details) between two states of the feed table.

    ``renames`` (old, new) names keys that were moved; other keys are added, removed or
    updated. Only changed fields are told for an update.
    """
    old = before.select("feed", F.struct(*_CHANGES).alias("_old"))
    new = after.select("feed", F.struct(*_CHANGES).alias("_new"))
    moved = None
    if renames is not None:
        old = old.join(renames.select(F.col("old").alias("feed"), "new"), "feed", "left")
        moved = old.where("new IS NOT NULL").select(F.col("feed").alias("_from"), F.col("new").alias("feed"))
        overwritten = old.join(moved.select("feed"), "feed", "left_semi").select(
            "feed", F.col("_old.url").alias("_overwritten")
        )
        old = (
            old.join(moved.select("feed"), "feed", "left_anti")
            .withColumn("feed", F.coalesce("new", "feed"))
            .drop("new")
        )
    both = old.join(new, "feed", "full")
    told = F.to_json(
        F.struct(
            *[
                F.when(
                    ~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")),
                    F.struct(
                        F.coalesce(F.col(f"_old.{c}").cast("string"), F.lit("")).alias("old"),
                        F.coalesce(F.col(f"_new.{c}").cast("string"), F.lit("")).alias("new"),
                    ),
                ).alias(c)
                for c in _CHANGES
            ]
        )
    )
    operation = (
        F.when(F.col("_old").isNull(), "add_feed")
        .when(F.col("_new").isNull(), "remove_feed")
        .when(told != "{}", "update_feed")
    )
    state = F.coalesce("_new", "_old")
    full = [state[c].alias(c) for c in _CHANGES]
    details = F.when(
        F.col("operation") == "update_feed",
        F.concat(F.lit('{"feed_name":'), F.to_json(F.array("feed")).substr(F.lit(2), F.length(F.to_json(F.array("feed"))) - 2), F.lit(',"changes":'), told, F.lit("}")),
    ).otherwise(F.to_json(F.struct(F.col("feed").alias("feed_name"), *full)))
    rows = both.withColumn("operation", operation).where("operation IS NOT NULL")
    changes = rows.select("operation", "feed", details.alias("details"))
    if moved is None:
        return changes
    renamed = moved.join(new, "feed").join(overwritten, "feed", "left").select(
        F.lit("rename_feed").alias("operation"),
        "feed",
        F.to_json(
            F.struct(
                F.col("_from").alias("old_feed_name"),
                F.col("feed").alias("new_feed_name"),
                F.col("_new.display_name").alias("display_name"),
                F.col("_new.url").alias("url"),
                F.col("_overwritten").alias("overwritten_url"),
            )
        ).alias("details"),
    )
    return renamed.unionByName(changes)


def feed_history(audit: DataFrame, feed: str) -> DataFrame:
    """Changes of one feed in time order; renames name two feeds and are not matched."""
    return audit.where(F.get_json_object("details", "$.feed_name") == feed).orderBy("timestamp")


def recent_changes(audit: DataFrame, n: int = 10) -> DataFrame:
    return audit.orderBy(F.col("timestamp").desc()).limit(n)
