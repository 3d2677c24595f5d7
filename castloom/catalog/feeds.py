"""Queries over feeds and their entries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from castloom.catalog import bindings as b
from castloom.catalog.bindings import oracle, table
from castloom.operators import feeds as fd

AS_OF = datetime(2025, 1, 1)


def _entries(spark, folder):
    """Entries of the page table with the nested fields a feed carries."""
    e = F.col("entry_id")
    rows = b.entries(spark, folder)

    def fields(*pairs):
        return F.struct(*[v.cast("string").alias(n) for n, v in pairs])

    none = F.lit(None)
    audio = F.array(
        fields(("type", F.lit("image/png")), ("href", F.lit("x.png")), ("url", none)),
        fields(
            ("type", F.lit("audio/mpeg")),
            ("href", F.when(e % 10 == 0, F.lit("")).otherwise(F.concat("url", F.lit("/a.mp3")))),
            ("url", F.when(e % 20 != 0, F.concat("url", F.lit("/b.mp3")))),
        ),
    )
    link = F.array(
        fields(("rel", F.lit("self")), ("href", F.lit("s"))),
        fields(("rel", F.lit("enclosure")), ("href", F.concat("url", F.lit("/l.mp3")))),
    )
    day = F.timestamp_add("HOUR", (e * 31).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    return rows.select(
        "feed",
        "position",
        "entry_id",
        F.when(e % 11 != 3, F.concat(F.lit("Talk "), "entry_id", F.lit(" "), "url")).alias("title"),
        F.when(e % 10 == 9, F.concat(F.lit("https://v/"), "entry_id")).alias("link"),
        F.when(e % 5 < 3, audio).otherwise(F.slice(audio, 1, 1)).alias("enclosures"),
        F.when(e % 5 == 3, link).otherwise(F.slice(link, 1, 1)).alias("links"),
        F.when(e % 5 == 4, F.when(e % 3 == 0, F.lit("short")).otherwise(F.lpad(e.cast("string"), 11, "v"))).alias("yt_videoid"),
        F.when(e % 4 == 0, F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(e % 4 == 1, F.date_format(day, "dd MMM yyyy HH:mm:ss '-0500'"))
        .when(e % 4 == 2, F.lit("soon"))
        .alias("published"),
        F.when(e % 8 < 4, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("updated"),
        F.when(e % 6 == 0, F.lit("")).when(e % 6 == 1, F.col("url")).alias("summary"),
        F.when(e % 6 < 3, F.concat(F.lit("d "), "url")).alias("description"),
        F.when(e % 6 < 5, F.array(F.struct(F.concat(F.lit("c "), "url").alias("value")))).alias("content"),
        F.when(e % 7 == 0, F.concat(e, F.lit(":05:09")))
        .when(e % 7 == 1, F.concat(e, F.lit(":30")))
        .when(e % 7 == 2, e.cast("string"))
        .when(e % 7 == 3, F.lit("1:xx"))
        .when(e % 7 == 4, F.lit("0"))
        .alias("itunes_duration"),
        F.when(e % 3 != 0, e.cast("string")).otherwise(F.lit("ep")).alias("itunes_episode"),
        F.lit("2").alias("itunes_season"),
        F.when(e % 2 == 0, F.concat(F.lit("id"), e)).otherwise(F.lit("")).alias("id"),
        F.concat(F.lit("guid"), e).alias("guid"),
    )


def episodes(spark, folder):
    good, _ = fd.episodes(_entries(spark, folder), AS_OF)
    return good.select(
        "feed", "position", "title", "url",
        F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"),
        "description",
        F.coalesce("duration_seconds", F.lit(-1)).alias("duration_seconds"),
        F.coalesce("episode_number", F.lit(-1)).alias("episode_number"),
        "season_number", "guid",
    )


def episode_rejects(spark, folder):
    return fd.episodes(_entries(spark, folder), AS_OF)[1].select("feed", "position", "reason")


def media_url(spark, folder):
    url = fd.media_url(F.col("link"), F.col("enclosures"), F.col("links"), F.col("yt_videoid"))
    return _entries(spark, folder).select("entry_id", url.alias("media_url"))


def published_at(spark, folder):
    when = fd.published_at(F.col("published"), F.col("updated"), AS_OF)
    return _entries(spark, folder).select(
        "entry_id", F.date_format(when, "yyyy-MM-dd HH:mm:ss").alias("published")
    )


def description(spark, folder):
    text = fd.description(F.col("summary"), F.col("description"), F.col("content"))
    return _entries(spark, folder).select("entry_id", text.alias("description"))


def feed_numbers(spark, folder):
    return _entries(spark, folder).select(
        "entry_id",
        F.coalesce(fd.duration_seconds(F.col("itunes_duration")), F.lit(-1)).alias("duration"),
        F.coalesce(fd.whole_number(F.col("itunes_episode")), F.lit(-1)).alias("episode"),
    )


def _feeds(spark, folder):
    """One feed per supplier; every fifth has no entries, every seventh could not be read."""
    entries = b.entries(spark, folder).select("feed").distinct()
    others = table(spark, folder, "supplier").select(F.col("s_name").alias("feed"))
    error = F.when(F.crc32("feed") % 7 == 0, F.lit(None)).otherwise(F.lit(None)).cast("string")
    return entries.unionByName(others).withColumn(
        "error", F.when(F.col("feed").endswith("7"), F.lit("timed out")).otherwise(error)
    )


def latest(spark, folder):
    rows = fd.latest(_feeds(spark, folder), _entries(spark, folder), AS_OF)
    return rows.select("feed", "status", "error", "title", "url")


def run_status(spark, folder):
    jobs = b.jobs(spark, folder)
    rows = jobs.select(
        "job_id",
        F.when(F.col("status") == "failed", F.lit(""))
        .when(F.col("status") == "cancelled", F.lit("stopped"))
        .alias("error"),
        F.when(F.col("status") == "succeeded", F.lit("t")).alias("title"),
    )
    return fd.run_status(rows).select("job_id", "status", "error")


def latest_summary(spark, folder):
    rows = fd.latest(_feeds(spark, folder), _entries(spark, folder), AS_OF)
    return fd.latest_summary(rows)


def latest_n(spark, folder):
    return fd.latest_n(b.entries(spark, folder), 60)[0].select("feed", "position", "entry_id")


def latest_view(spark, folder):
    return fd.latest_view(_entries(spark, folder), AS_OF, 20)


def feeds_view(spark, folder):
    return fd.feeds_view(_stored(spark, folder)).select(
        "feed", "display_name", "url", "auth", "category",
        F.array_join("extra_templates", ",").alias("extra_templates"), "total",
    )


def _selectors(spark, folder):
    """One selector per customer, over the feeds of the page table."""
    k = F.col("c_custkey")
    feed = F.when(k % 3 == 0, "example.com").when(k % 3 == 1, "example.net").otherwise("example.org")
    text = (
        F.when(k % 6 == 0, (k % 130).cast("string"))
        .when(k % 6 == 1, F.concat(k % 60 + 1, F.lit("-"), k % 90 + 1))
        .when(k % 6 == 2, F.concat(k % 40 + 1, F.lit(", "), k % 7 + 1, F.lit(","), k % 40 + 1))
        .when(k % 6 == 3, F.concat(F.lit("1-"), k % 50 + 90))
        .when(k % 6 == 4, F.concat(F.lit(" TALK "), k % 300, F.lit(" ")))
        .otherwise(F.concat(F.lit("a-"), k))
    )
    return table(spark, folder, "customer").select(
        k.alias("selector_id"), feed.alias("feed"), text.alias("selector")
    )


def _titled(spark, folder):
    return b.entries(spark, folder).withColumn("title", F.concat(F.lit("Talk "), "entry_id"))


def select_episodes(spark, folder):
    good, _ = fd.select_episodes(_titled(spark, folder), _selectors(spark, folder))
    return good.select("selector_id", F.col("ordinal").cast("bigint").alias("ordinal"), "entry_id")


def select_rejects(spark, folder):
    return fd.select_episodes(_titled(spark, folder), _selectors(spark, folder))[1]


def _stored(spark, folder):
    k = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        fd.key_slug(F.col("s_name")).alias("feed"),
        k.alias("feed_no"),
        F.when(k % 4 != 0, F.concat(F.lit("The Grand Show "), (k % 40).cast("string"))).alias("display_name"),
        F.concat(F.lit("https://www.youtube.com/feeds/videos.xml?channel_id=UC"), k % 50).alias("url"),
        F.when(k % 5 == 0, F.lit("basic")).alias("auth_type"),
        F.when(k % 3 == 0, F.lit("tech")).alias("category"),
        F.when(k % 2 == 0, F.array(F.lit("tools-mentioned"), F.concat(F.lit("t"), k % 5)))
        .otherwise(F.array().cast("array<string>"))
        .alias("custom_templates"),
    )


def resolve_feed(spark, folder):
    k = F.col("c_custkey")
    shown = k % 6 + 1 + F.floor(k % 6 / 3)
    name = (
        F.when(k % 5 == 0, F.concat(F.lit("supplier-"), F.lpad((k % 130).cast("string"), 9, "0")))
        .when(k % 5 == 1, F.concat(F.lit("Supplier "), F.lpad((k % 130).cast("string"), 9, "0")))
        .when(k % 5 == 2, F.concat(F.lit("THE grand show "), shown))
        .when(k % 5 == 3, F.concat(F.lit("the_grand_show!"), shown))
        .otherwise(F.concat(F.lit("unknown "), k))
    )
    names = table(spark, folder, "customer").select(k.alias("name_id"), name.alias("name"))
    return fd.resolve_feed(names, _stored(spark, folder)).select("name_id", "feed")


def resolve_close_feed(spark, folder):
    """Misspelt display names, which only the closest match finds, among unrelated ones."""
    told = lambda n: F.substring(F.md5(n.cast("string")), 1, 24)
    k = F.col("s_suppkey")
    stored = table(spark, folder, "supplier").select(
        F.concat(F.lit("feed-"), k).alias("feed"), k.alias("feed_no"),
        F.concat(F.lit("Show "), told(k)).alias("display_name"),
    )
    c = F.col("c_custkey")
    meant = told(c % stored.count())
    wrong = F.concat(F.lit("show "), F.substring(meant, 1, 9), F.lit("zz"), F.substring(meant, 11, 14))
    name = F.when(c % 3 != 0, wrong).otherwise(F.concat(F.lit("shaw "), told(F.concat(F.lit("x"), c))))
    names = table(spark, folder, "customer").select(c.alias("name_id"), name.alias("name"))
    return fd.resolve_feed(names, stored).select("name_id", "feed")


def same_channel(spark, folder):
    k = F.col("c_custkey")
    asked = table(spark, folder, "customer").select(
        k.alias("candidate_id"),
        F.concat(F.lit("https://m.youtube.com/feeds/videos.xml?channel_id=UC"), k % 70).alias("url"),
    )
    rows = fd.same_channel(_stored(spark, folder), asked)
    return rows.select("candidate_id", "channel_id", "feed")


def feed_templates(spark, folder):
    k = F.col("c_custkey")
    feed = F.concat(F.lit("supplier-"), F.lpad((k % 130).cast("string"), 9, "0"))
    requests = table(spark, folder, "customer").select(
        k.alias("request_id"),
        feed.alias("feed"),
        F.when(k % 2 == 0, F.array(F.lit("summary"), F.concat(F.lit("t"), k % 5))).alias("templates"),
        F.when(k % 4 == 0, F.lit("interview")).alias("category"),
    )
    rows = fd.feed_templates(requests, _stored(spark, folder))
    return rows.select("request_id", F.array_join("templates", ",").alias("templates"), "category")


def transcript_paths(spark, folder):
    """Titles repeat, and some look like the second name of another."""
    e = F.col("entry_id")
    rows = b.entries(spark, folder).select(
        "entry_id",
        F.when(e % 3 == 0, F.lit("My Show"))
        .when(e % 3 == 1, F.concat(F.lit("Part "), e % 20))
        .alias("title"),
        "url",
    )
    return fd.transcript_paths(rows, "entry_id").select("entry_id", "path")


def dedupe_names(spark, folder):
    k = F.col("c_custkey")
    channels = table(spark, folder, "customer").select(
        k.alias("no"),
        F.when(k % 3 != 0, F.concat(F.lit("Show "), k % 90)).otherwise(F.lit("!!")).alias("channel_name"),
        F.when(k % 6 == 0, F.lit("https://x.test/feed"))
        .otherwise(F.concat(F.lit("https://www.youtube.com/feeds/videos.xml?channel_id=UC"), k % 9))
        .alias("feed_url"),
    )
    existing = table(spark, folder, "nation").select(
        F.concat(F.lit("show-"), F.col("n_nationkey") * 3).alias("name")
    )
    return fd.dedupe_names(channels, "no", existing).select("no", "feed")


def feed_changes(spark, folder):
    before = _stored(spark, folder)
    k = F.col("feed_no")
    after = before.where(k % 7 != 0).withColumn(
        "category", F.when(k % 3 == 0, F.lit("talk")).otherwise(F.col("category"))
    )
    changes = fd.feed_changes(before.where(k % 11 != 0), after)
    return changes.select(
        "operation", "feed",
        F.get_json_object("details", "$.feed_name").alias("told_feed"),
        F.coalesce(F.get_json_object("details", "$.changes.category.new"), F.lit("")).alias("new_category"),
    )


def _audit(spark, folder):
    e = F.col("event_id")
    return table(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(F.col("event_type") == "error", "rename_feed").otherwise("update_feed").alias("operation"),
        F.when(
            F.col("event_type") == "error",
            F.concat(F.lit('{"old_feed_name":"feed-'), F.col("user_id"), F.lit('"}')),
        )
        .otherwise(F.concat(F.lit('{"feed_name":"feed-'), F.col("user_id"), F.lit('","no":'), e, F.lit("}")))
        .alias("details"),
    )


def feed_history(spark, folder):
    return fd.feed_history(_audit(spark, folder), "feed-7").select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("changed_at"), "details"
    )


def recent_changes(spark, folder):
    return fd.recent_changes(_audit(spark, folder), 25).select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("changed_at"), "operation", "details"
    )


QUERIES = {
    "episodes": episodes,
    "episode_rejects": episode_rejects,
    "media_url": media_url,
    "published_at": published_at,
    "description": description,
    "feed_numbers": feed_numbers,
    "latest": latest,
    "run_status": run_status,
    "latest_summary": latest_summary,
    "latest_n": latest_n,
    "latest_view": latest_view,
    "feeds_view": feeds_view,
    "select_episodes": select_episodes,
    "select_rejects": select_rejects,
    "resolve_feed": resolve_feed,
    "resolve_close_feed": resolve_close_feed,
    "same_channel": same_channel,
    "feed_templates": feed_templates,
    "transcript_paths": transcript_paths,
    "dedupe_names": dedupe_names,
    "feed_changes": feed_changes,
    "feed_history": feed_history,
    "recent_changes": recent_changes,
}

_MEDIA = """CASE WHEN e % 5 < 3 THEN CASE WHEN e % 20 = 0 THEN NULL WHEN e % 10 = 0
       THEN url || '/b.mp3' ELSE url || '/a.mp3' END
     WHEN e % 5 = 3 THEN url || '/l.mp3'
     WHEN e % 10 = 9 THEN 'https://v/' || e
     WHEN e % 3 <> 0 THEN 'https://www.youtube.com/watch?v=' || lpad(e::VARCHAR, 11, 'v') END"""
_AT = """CASE WHEN e % 4 = 0 THEN day WHEN e % 4 = 1 THEN day + INTERVAL 5 HOUR
     WHEN e % 8 < 4 THEN day ELSE TIMESTAMP '2025-01-01 00:00:00' END"""
_TOLD = """CASE WHEN e % 6 = 0 THEN '' WHEN e % 6 = 1 THEN url WHEN e % 6 < 3 THEN 'd ' || url
     WHEN e % 6 < 5 THEN 'c ' || url ELSE '' END"""
_SECONDS = """CASE e % 7 WHEN 0 THEN e * 3600 + 309 WHEN 1 THEN e * 60 + 30 WHEN 2 THEN e
     WHEN 4 THEN 0 ELSE -1 END"""
_FULL = f"""SELECT *, CASE WHEN e % 11 <> 3 THEN 'Talk ' || e || ' ' || url END AS title,
       {_MEDIA} AS media, {_AT} AS published, {_TOLD} AS told, {_SECONDS} AS seconds
FROM (SELECT *, entry_id AS e, TIMESTAMP '2024-01-01' + entry_id * 31 * INTERVAL 1 HOUR AS day
      FROM entries)"""


def _sql(select, **extra):
    return oracle(select, "entries", full_entries=_FULL, **extra)


_KEYS = """SELECT lower(replace(s_name, '#', '-')) AS raw, s_suppkey AS k,
       trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS feed,
       CASE WHEN s_suppkey % 4 <> 0 THEN 'The Grand Show ' || s_suppkey % 40 END AS display_name
FROM supplier"""
_LATEST = """SELECT f.feed, CASE WHEN f.feed LIKE '%7' THEN 'error'
       WHEN title IS NOT NULL AND media IS NOT NULL THEN 'success' ELSE 'empty' END AS status,
       CASE WHEN title IS NOT NULL AND media IS NOT NULL THEN title END AS title,
       CASE WHEN title IS NOT NULL AND media IS NOT NULL THEN media END AS url
FROM (SELECT DISTINCT feed FROM entries UNION ALL SELECT s_name FROM supplier) f
LEFT JOIN full_entries e ON e.feed = f.feed AND e.position = 1"""
_SELECTORS = """SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'example.com'
       WHEN 1 THEN 'example.net' ELSE 'example.org' END AS feed,
       CASE c_custkey % 6 WHEN 0 THEN [c_custkey % 130]
         WHEN 1 THEN range(least(c_custkey % 60, c_custkey % 90) + 1,
                           greatest(c_custkey % 60, c_custkey % 90) + 2)
         WHEN 2 THEN [c_custkey % 40 + 1, c_custkey % 7 + 1, c_custkey % 40 + 1]
         WHEN 3 THEN range(1, c_custkey % 50 + 91)
         WHEN 4 THEN [(SELECT min(position) FROM entries e WHERE contains('talk ' || e.entry_id,
           'talk ' || c_custkey % 300) AND e.feed = CASE c_custkey % 3 WHEN 0 THEN 'example.com'
           WHEN 1 THEN 'example.net' ELSE 'example.org' END)]
         ELSE [NULL] END AS wanted FROM customer"""
_JUDGED = """SELECT s.k, s.feed, wanted, CASE
         WHEN k % 6 >= 4 THEN CASE WHEN wanted[1] IS NULL THEN 'no title matches' END
         WHEN len(wanted) > 100 THEN 'too many'
         WHEN len(list_filter(wanted, lambda p: p < 1 OR p > z.size)) > 0 THEN 'no such position'
       END AS reason
FROM selectors s LEFT JOIN (SELECT feed, count(*) AS size FROM entries GROUP BY feed) z
  ON z.feed = s.feed"""

ORACLES = {
    "episodes": _sql("""
SELECT feed, position, title, media AS url, strftime(published, '%Y-%m-%d %H:%M:%S') AS published,
       told AS description, CAST(seconds AS INT) AS duration_seconds,
       CAST(CASE WHEN e % 3 = 0 THEN -1 ELSE e END AS INT) AS episode_number,
       2 AS season_number, CASE WHEN e % 2 = 0 THEN 'id' || e ELSE 'guid' || e END AS guid
FROM full_entries WHERE title IS NOT NULL AND media IS NOT NULL"""),
    "episode_rejects": _sql("""
SELECT feed, position, CASE WHEN title IS NULL THEN 'missing title' ELSE 'no media address' END
       AS reason FROM full_entries WHERE title IS NULL OR media IS NULL"""),
    "media_url": _sql("SELECT entry_id, media AS media_url FROM full_entries"),
    "published_at": _sql("""
SELECT entry_id, strftime(published, '%Y-%m-%d %H:%M:%S') AS published FROM full_entries"""),
    "description": _sql("SELECT entry_id, told AS description FROM full_entries"),
    "feed_numbers": _sql("""
SELECT entry_id, CAST(seconds AS INT) AS duration,
       CAST(CASE WHEN e % 3 = 0 THEN -1 ELSE e END AS INT) AS episode FROM full_entries"""),
    "latest": _sql(
        """SELECT feed, status, CASE status WHEN 'error' THEN 'timed out'
       WHEN 'empty' THEN 'No episodes yet' END AS error, title, url FROM newest""",
        newest=_LATEST,
    ),
    "run_status": oracle(
        """SELECT job_id, CASE WHEN status IN ('failed', 'cancelled') THEN 'error'
       WHEN status = 'succeeded' THEN 'success' ELSE 'empty' END AS status,
       CASE status WHEN 'failed' THEN 'Unknown error' WHEN 'cancelled' THEN 'stopped'
         WHEN 'succeeded' THEN NULL ELSE 'No episodes yet' END AS error FROM jobs""",
        "jobs",
    ),
    "latest_summary": _sql(
        """SELECT count(*) AS total_feeds, count(*) FILTER (status <> 'error') AS successful,
       count(*) FILTER (status = 'error') AS failed FROM newest""",
        newest=_LATEST,
    ),
    "latest_n": oracle(
        """SELECT feed, position, entry_id FROM entries WHERE position <= 60 AND feed IN
       (SELECT feed FROM entries GROUP BY feed HAVING count(*) >= 60)""",
        "entries",
    ),
    "latest_view": _sql("""
SELECT feed, position, title, strftime(published, '%Y-%m-%d') AS day,
       CASE WHEN seconds > 0 THEN CASE WHEN seconds >= 3600
         THEN printf('%d:%02d:%02d', seconds // 3600, seconds % 3600 // 60, seconds % 60)
         ELSE printf('%d:%02d', seconds // 60, seconds % 60) END END AS duration,
       media AS url, total, least(20, total) AS showing
FROM (SELECT *, count(*) OVER (PARTITION BY feed) AS total FROM full_entries)
WHERE position <= 20 AND title IS NOT NULL AND media IS NOT NULL"""),
    "feeds_view": oracle(
        """SELECT feed, coalesce(display_name, feed) AS display_name,
       'https://www.youtube.com/feeds/videos.xml?channel_id=UC' || k % 50 AS url,
       CASE WHEN k % 5 = 0 THEN 'basic' ELSE 'none' END AS auth,
       CASE WHEN k % 3 = 0 THEN 'tech' ELSE '' END AS category,
       CASE WHEN k % 2 = 0 THEN 'tools-mentioned,t' || k % 5 ELSE '' END AS extra_templates,
       (SELECT count(*) FROM supplier) AS total FROM stored""",
        stored=_KEYS,
    ),
    "select_episodes": oracle(
        """SELECT w.k AS selector_id, w.ordinal, e.entry_id FROM (
  SELECT k, feed, unnest(wanted) AS position, unnest(range(len(wanted))) AS ordinal
  FROM judged WHERE reason IS NULL) w
JOIN entries e ON e.feed = w.feed AND e.position = w.position""",
        "entries",
        selectors=_SELECTORS,
        judged=_JUDGED,
    ),
    "select_rejects": oracle(
        "SELECT k AS selector_id, reason FROM judged WHERE reason IS NOT NULL",
        "entries",
        selectors=_SELECTORS,
        judged=_JUDGED,
    ),
    "resolve_feed": oracle(
        """SELECT c.c_custkey AS name_id, coalesce(own.feed, shown.feed) AS feed
FROM customer c
LEFT JOIN stored own ON c.c_custkey % 5 < 2
  AND own.feed = 'supplier-' || lpad((c.c_custkey % 130)::VARCHAR, 9, '0')
LEFT JOIN (SELECT display_name, arg_max(feed, k) AS feed FROM stored
           WHERE display_name IS NOT NULL GROUP BY display_name) shown
  ON c.c_custkey % 5 IN (2, 3) AND shown.display_name =
     'The Grand Show ' || (c.c_custkey % 6 + 1 + c.c_custkey % 6 // 3)""",
        stored=_KEYS,
    ),
    "resolve_close_feed": oracle(
        """SELECT c_custkey AS name_id, CASE WHEN c_custkey % 3 <> 0
       THEN 'feed-' || c_custkey % (SELECT count(*) FROM supplier) END AS feed FROM customer"""
    ),
    "transcript_paths": oracle(
        """SELECT entry_id, base || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.transcript.md' AS path
FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY entry_id) AS n FROM (
  SELECT entry_id, CASE entry_id % 3 WHEN 0 THEN 'my-show' WHEN 1 THEN 'part-' || entry_id % 20
         ELSE replace(regexp_extract(regexp_extract(url, '^[^?#]*'), '([^/]+)/*$', 1), '.', '-') END AS base
  FROM entries))""",
        "entries",
    ),
    "dedupe_names": oracle(
        """SELECT no, base || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS feed
FROM (SELECT no, base, row_number() OVER (PARTITION BY base ORDER BY no)
        + (base IN (SELECT 'show-' || n_nationkey * 3 FROM nation))::INT AS n FROM (
  SELECT c_custkey AS no, CASE WHEN c_custkey % 3 <> 0 THEN 'show-' || c_custkey % 90
         WHEN c_custkey % 6 = 0 THEN 'youtube-feed' ELSE 'uc' || c_custkey % 9 END AS base FROM customer))"""
    ),
    "same_channel": oracle(
        """SELECT c_custkey AS candidate_id, 'UC' || c_custkey % 70 AS channel_id, feed
FROM customer LEFT JOIN (SELECT k % 50 AS ch, arg_min(feed, k) AS feed FROM stored GROUP BY ALL) s
  ON s.ch = c_custkey % 70""",
        stored=_KEYS,
    ),
    "feed_templates": oracle(
        """SELECT c_custkey AS request_id,
       concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'summary,t' || c_custkey % 5 END,
         CASE WHEN k % 2 = 0 THEN 'tools-mentioned' END,
         CASE WHEN k % 2 = 0 AND NOT (c_custkey % 2 = 0 AND c_custkey % 5 = k % 5)
           THEN 't' || k % 5 END) AS templates,
       CASE WHEN c_custkey % 4 = 0 THEN 'interview' WHEN k % 3 = 0 THEN 'tech' END AS category
FROM customer LEFT JOIN stored
  ON feed = 'supplier-' || lpad((c_custkey % 130)::VARCHAR, 9, '0')""",
        stored=_KEYS,
    ),
    "feed_changes": oracle(
        """SELECT CASE WHEN k % 11 = 0 THEN 'add_feed' WHEN k % 7 = 0 THEN 'remove_feed'
       ELSE 'update_feed' END AS operation, feed, feed AS told_feed,
       CASE WHEN k % 11 <> 0 AND k % 7 <> 0 THEN 'talk' ELSE '' END AS new_category
FROM stored WHERE (k % 11 = 0 AND k % 7 <> 0) OR (k % 11 <> 0 AND k % 7 = 0)
   OR (k % 11 <> 0 AND k % 7 <> 0 AND k % 3 = 0)""",
        stored=_KEYS,
    ),
    "feed_history": oracle("""
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS changed_at,
       '{"feed_name":"feed-7","no":' || event_id || '}' AS details
FROM events WHERE user_id = 7 AND event_type <> 'error'"""),
    "recent_changes": oracle("""
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS changed_at,
       CASE WHEN event_type = 'error' THEN 'rename_feed' ELSE 'update_feed' END AS operation,
       CASE WHEN event_type = 'error' THEN '{"old_feed_name":"feed-' || user_id || '"}'
         ELSE '{"feed_name":"feed-' || user_id || '","no":' || event_id || '}' END AS details
FROM events ORDER BY ts DESC LIMIT 25"""),
}
