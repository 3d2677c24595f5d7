"""Queries through files, streams and the caller's functions, all fed from the tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from castloom.catalog import bindings as b
from castloom.catalog.bindings import oracle, scratch, table
from castloom.catalog.costs import _PRICED, _ledger
from castloom.operators import feeds as fd
from castloom.operators import transcripts as tr
from castloom.sinks import notes as sink
from castloom.sinks.files import write_texts
from castloom.sources import feeds, files, templates
from castloom.streaming import streams

AS_OF = datetime(2025, 1, 1)


def _escaped(column):
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        column = F.replace(column, F.lit(raw), F.lit(safe))
    return column


def _feed_files(spark, folder):
    """One RSS document per ten pages, one Atom document per ten more."""
    e = F.col("page_id")
    url = _escaped(F.col("url"))
    rss = F.concat(
        F.lit("<item><title>Talk "), e, F.lit("</title><guid>g"), e, F.lit("</guid><link>"), url,
        F.lit("</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><itunes:duration>01:02:"),
        F.lpad((e % 60).cast("string"), 2, "0"), F.lit('</itunes:duration><enclosure type="audio/mpeg" url="'),
        url, F.lit('"/></item>'),
    )
    atom = F.concat(
        F.lit("<entry><title>Talk "), e, F.lit('</title><id>g'), e, F.lit('</id><link href="'), url,
        F.lit('"/><updated>2024-02-03T04:05:06Z</updated><link rel="enclosure" type="audio/mpeg" href="'),
        url, F.lit('"/></entry>'),
    )
    pages = table(spark, folder, "pages")
    number = F.floor(e / 10).cast("bigint")
    is_rss = number % 2 == 0
    docs = pages.groupBy(number.alias("n")).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(e.alias("e"), F.when(is_rss, rss).otherwise(atom).alias("x")))),
                lambda s: s["x"],
            ), "",
        ).alias("items")
    )
    head = '<rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel><title>Feed '
    body = F.when(
        F.col("n") % 2 == 0,
        F.concat(F.lit(head), "n", F.lit("</title>"), "items", F.lit("</channel></rss>")),
    ).otherwise(
        F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed '), "n", F.lit("</title>"), "items", F.lit("</feed>"))
    )
    path = scratch(spark, "feeds")
    write_texts(docs.select("n", body.alias("value")), path, ["n"])
    return path


def read_feeds(spark, folder):
    entries = feeds.read_feeds(spark, _feed_files(spark, folder))
    good, _ = fd.episodes(entries, AS_OF)
    return good.select(
        "feed", "position", "title", "url", "guid",
        F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"),
        F.coalesce("duration_seconds", F.lit(-1)).alias("duration_seconds"),
    )


def read_cut_feeds(spark, folder):
    """RSS documents that break off in their last item, which is lost with them."""
    path, cut = _feed_files(spark, folder), scratch(spark, "cut")
    texts = spark.read.text(path, wholetext=True).where("n % 2 = 0")
    broken = F.regexp_replace("value", r"(?s)</enclosure>?\s*|</item></channel></rss>.*$", "")
    write_texts(texts.select("n", broken.alias("value")), cut, ["n"])
    return feeds.read_cut_feeds(spark, cut).select("position", "title", "link")


def read_texts(spark, folder):
    """Conversations written as text files, one to a folder, and read back."""
    texts = tr.full_text(b.segments(spark, folder), "\n")
    path = scratch(spark, "texts")
    write_texts(texts.select("episode_id", F.col("text").alias("value")), path, ["episode_id"])
    good, _ = files.read_texts(spark, path)
    return good.select(
        F.regexp_extract("path", r"episode_id=(\d+)/", 1).cast("bigint").alias("episode_id"),
        F.sha2("text", 256).alias("text_hash"),
    )


def read_notes(spark, folder):
    """Documents written as notes, every other one with front matter, and read back."""
    k = F.col("doc_id")
    front = F.concat(F.lit("---\ntemplate_version: '"), k % 5, F.lit(".0'\ntitle: x\n---\n\n"))
    text = F.concat(F.lit("# "), "text")
    notes = table(spark, folder, "documents").select(
        F.col("source").alias("podcast"), k.alias("episode"),
        F.when(k % 2 == 0, F.concat(front, text)).otherwise(text).alias("value"),
    )
    path = scratch(spark, "notes")
    write_texts(notes, path, ["podcast", "episode"])
    read = files.read_notes(spark, path, pattern="*.txt")
    return read.select("podcast_dir", "episode_dir", "version", F.sha2("content", 256).alias("content_hash"))


def read_templates(spark, folder):
    """One template file a nation; one of them takes the place of a built-in template."""
    k, path = F.col("n_nationkey"), scratch(spark, "templates")
    name = F.when(k == 3, F.lit("summary")).otherwise(F.lower("n_name"))
    text = F.concat(
        F.lit("name: '"), name, F.lit("'\nversion: '"), k, F.lit(".1'\ndescription: d\nsystem_prompt: s\npriority: "), k,
        F.lit("\nuser_prompt_template: '{{ transcript }}'\nexpected_format: json\noutput_schema: {required: [a, b]}\n"),
        F.when(k % 2 == 0, "category: tech\n").otherwise(""),
    )
    rows = table(spark, folder, "nation").select(k.alias("k"), text.alias("value"))
    rows.repartition("k").write.partitionBy("k").text(path)
    read = templates.read_templates(spark, path, pattern="*.txt")
    return read.where("expected_format = 'json' AND system_prompt = 's'").select(
        "name", "version", "priority", "category", "required_fields", "max_tokens"
    )


def _read_ledger(spark, folder):
    """The ledger written as JSON arrays of at most a thousand rows, and read back."""
    rows = _ledger(spark, folder)
    number = F.col("position")
    record = F.struct(
        F.when(number % 4 != 0, F.col("usage_id")).alias("usage_id"), "provider", "operation",
        "input_tokens", "output_tokens", "cost_usd", "cost_known",
        F.date_format("used_at", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
    )
    arrays = rows.groupBy(F.floor(number / 1000).alias("part")).agg(F.collect_list(record).alias("rows"))
    path = scratch(spark, "usage")
    arrays.repartition(F.col("part")).select("part", F.to_json("rows").alias("value")).write.partitionBy("part").text(path)
    return files.read_usage(spark, path)


def read_usage(spark, folder):
    read = _read_ledger(spark, folder)
    return read.groupBy("provider", "operation").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("total_tokens").alias("total_tokens"),
        F.count_distinct("usage_id").alias("ids"),
        F.date_format(F.max("used_at"), "yyyy-MM-dd HH:mm:ss").alias("last_used"),
    )


def _read_changes(spark, folder):
    """Feed changes appended as JSON lines among broken ones, and read back."""
    from castloom.catalog.feeds import _stored

    before = _stored(spark, folder)
    after = before.where(F.col("feed_no") % 7 != 0)
    path = scratch(spark, "audit")
    sink.append_audit(fd.feed_changes(before, after), path, datetime(2024, 5, 6))
    broken = before.where(F.col("feed_no") % 9 == 0)
    broken.select(F.concat(F.lit('{"timestamp": "broken '), "feed_no").alias("value")).write.mode("append").text(path)
    return files.read_audit(spark, path)


def read_audit(spark, folder):
    read, _ = _read_changes(spark, folder)
    return read.select(
        "operation", F.get_json_object("details", "$.feed_name").alias("feed"),
        F.date_format("timestamp", "yyyy-MM-dd").alias("day"),
    )


def audit_rejects(spark, folder):
    return _read_changes(spark, folder)[1]


def _note_rows(spark, folder):
    docs = table(spark, folder, "documents")
    results = docs.where(F.col("doc_id") % 2 == 0).select(
        F.col("source").alias("podcast"), F.concat(F.lit("Doc "), "doc_id").alias("episode"),
        F.lit(None).cast("timestamp").alias("published"), F.lit(AS_OF).alias("processed"),
        F.lit(0).alias("result_no"), F.lit("summary").alias("template_name"),
        F.lit("2.0").alias("template_version"), F.lit("gemini").alias("provider"),
        F.lit(0.5).alias("cost_usd"), F.lit(True).alias("cost_known"), F.lit("known").alias("billing_mode"),
        F.lit("m").alias("model"), F.lit(False).alias("bypassed"), F.lit("").alias("bypass_reason"),
        F.lit("").alias("url"), F.lit("").alias("source_kind"),
        F.col("text").alias("content_text"), F.lit(None).cast("string").alias("content_json"),
    )
    spoken = docs.select(
        F.col("source").alias("podcast"), F.concat(F.lit("Doc "), "doc_id").alias("episode"), "text",
        F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("timestamp").alias("published"), F.lit(AS_OF).alias("processed"),
    )
    return sink.note_rows(results, spoken, F.lit(AS_OF))


def write_notes(spark, folder):
    """Notes written, then every tenth episode written again over them."""
    rows = _note_rows(spark, folder)
    path = scratch(spark, "notes")
    sink.write_notes(rows, path)
    again = rows.where(F.col("episode_slug").endswith("0")).withColumn("cost_usd", F.lit(2.0))
    sink.write_notes(again, path, overwrite=True)
    return spark.read.parquet(path).groupBy("podcast_slug", "episode_slug").agg(
        F.count(F.lit(1)).alias("files"), F.sum("cost_usd").alias("cost_usd"),
        F.max(F.when(F.col("file_no") == 0, F.col("size_bytes"))).alias("transcript_bytes"),
    )


def load_meta(spark, folder):
    rows = table(spark, folder, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 4 != 3, (F.col("doc_id") % 4).cast("int")).alias("schema_version")
    )
    return files.load_meta(rows)


#: Files of a delivery, so that none of them is empty in a small table.
MOST_FILES = 64

_EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, late boolean"


def _received(spark, folder):
    """The event table in four deliveries by time. Every fifth record comes twice, the second
    time one delivery later; every 97th comes with the last delivery only, long overdue."""
    path = scratch(spark, "events")
    events = table(spark, folder, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        (F.col("event_id") % 97 == 3).alias("late"),
    )
    days = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    whole = F.unix_micros(days.select("b").scalar()) - F.unix_micros(days.select("a").scalar()) + 1
    part = F.floor((F.unix_micros("ts") - F.unix_micros(days.select("a").scalar())) * 4 / whole).cast("int")
    parts = events.withColumn("part", F.when(F.col("late"), 3).otherwise(part))
    again = parts.where("event_id % 5 = 0").withColumn("part", F.least(F.col("part") + 1, F.lit(3)))
    # The last delivery ends with a mark in the far future, which closes all windows.
    mark = days.select(
        F.lit(-1).cast("bigint").alias("event_id"), F.timestamp_add("DAY", F.lit(30), "b").alias("ts"),
        F.lit(-1).cast("bigint").alias("user_id"), F.lit("mark").alias("event_type"), F.lit(0.0).alias("value"),
        F.lit(False).alias("late"), F.lit(4).alias("part"),
    )
    every = parts.unionByName(again).unionByName(mark)
    # As many files as the cluster has tasks, and one micro-batch of them per delivery.
    for n in range(5):
        every.where(F.col("part") == n).drop("part").repartition(_files(spark)).write.mode("append").parquet(path)
    return path


def _files(spark):
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_FILES)


def _usage_of(events):
    e = F.col("event_id")
    return events.select(
        b.usage_id(e).alias("usage_id"),
        F.when(F.col("event_type") == "purchase", "claude")
        .when(F.col("event_type") == "mark", "mark").otherwise("gemini").alias("provider"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("input_tokens"),
        F.floor(F.col("value") * 50).cast("bigint").alias("output_tokens"),
        (e % 8 / 8).alias("cost_usd"),
        F.col("ts").alias("used_at"),
    )


def _usage_stream(spark, path):
    return _usage_of(streams.file_stream(spark, path, _EVENTS, files_per_batch=_files(spark)))


def _ledger_and_late(spark, path):
    """What the ledger stream emits, and what comes too late for it."""
    ledger = streams.run_to_table(streams.stream_usage(_usage_stream(spark, path)))
    return ledger, streams.late_usage(_usage_of(spark.read.schema(_EVENTS).parquet(path)), ledger)


def stream_usage(spark, folder):
    ledger, late = _ledger_and_late(spark, _received(spark, folder))
    rows = ledger.withColumn("late", F.lit(False)).unionByName(
        late.withColumn("late", F.lit(True)), allowMissingColumns=True
    )
    return rows.where("provider <> 'mark'").select("usage_id", "provider", "input_tokens", "late")


def stream_costs(spark, folder):
    path = _received(spark, folder)
    _, late = _ledger_and_late(spark, path)
    emitted = streams.run_to_table(streams.stream_costs(_usage_stream(spark, path), "6 hours", "3 hours"))
    rows = streams.with_late_costs(emitted, late, "6 hours", "3 hours").where("provider <> 'mark'")
    return _told(rows)


def _told(windows):
    return windows.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "provider", "records", "tokens", "cost_usd",
    )


def stream_cost_updates(spark, folder):
    """The windows of a stream in update mode, kept in a table; the run is repeated once, as
    after a lost driver."""
    path = _received(spark, folder)
    _, late = _ledger_and_late(spark, path)
    place = scratch(spark, "costs")
    for _ in range(2):
        windows = streams.run_costs(_usage_stream(spark, path), place, "6 hours", "3 hours")
    rows = streams.with_late_costs(windows.read(), late, "6 hours", "3 hours").where("provider <> 'mark'")
    return _told(rows)


def stream_jobs(spark, folder):
    """A job per user; a sign-up ends it."""
    kind = F.col("event_type")
    events = streams.file_stream(spark, _received(spark, folder), _EVENTS, files_per_batch=_files(spark))
    progress = events.where("event_type <> 'mark'").select(
        F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"),
        F.when(kind == "signup", "succeeded").otherwise("running").alias("status"), kind.alias("stage"),
    )
    emitted = streams.run_to_table(streams.stream_jobs(progress, "365 days", "365 days"), "update", rocksdb=True)
    return emitted.select("job_id", F.col("batch").cast("int").alias("batch"), "status", "stage")


QUERIES = {
    "read_feeds": read_feeds,
    "read_cut_feeds": read_cut_feeds,
    "read_texts": read_texts,
    "read_usage": read_usage,
    "read_audit": read_audit,
    "audit_rejects": audit_rejects,
    "read_notes": read_notes,
    "read_templates": read_templates,
    "write_notes": write_notes,
    "load_meta": load_meta,
    "stream_usage": stream_usage,
    "stream_costs": stream_costs,
    "stream_cost_updates": stream_cost_updates,
    "stream_jobs": stream_jobs,
}

_KEY = "trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-')"
_USED = """SELECT event_id, regexp_replace(md5(CAST(event_id AS VARCHAR)),
         '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS usage_id, CASE WHEN event_type = 'purchase' THEN 'claude' ELSE 'gemini' END AS provider,
       CAST(floor(value * 1000) AS BIGINT) AS input_tokens,
       CAST(floor(value * 50) AS BIGINT) AS output_tokens, event_id % 8 / 8.0::DOUBLE AS cost_usd, ts
FROM events"""

_COSTS = oracle(
    """SELECT strftime(to_timestamp(w * 10800) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS window_start,
   provider, count(*) AS records, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens,
   sum(cost_usd) AS cost_usd
FROM (SELECT *, unnest([s // 10800, s // 10800 - 1]) AS w FROM (
  SELECT *, epoch(date_trunc('second', ts))::BIGINT AS s FROM used)) GROUP BY w, provider""",
    used=_USED,
)

ORACLES = {
    "read_feeds": oracle(
        """SELECT 'Feed ' || page_id // 10 AS feed, page_id % 10 + 1 AS position, 'Talk ' || page_id AS title,
       url, 'g' || page_id AS guid,
       CASE WHEN page_id // 10 % 2 = 0 THEN '2024-01-01 10:00:00' ELSE '2024-02-03 04:05:06' END AS published,
       CAST(CASE WHEN page_id // 10 % 2 = 0 THEN 3720 + page_id % 60 ELSE -1 END AS INT) AS duration_seconds
FROM pages"""
    ),
    "read_usage": oracle(
        """SELECT provider, operation, count(*) AS records,
       CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, count(*) AS ids,
       strftime(max(used_at), '%Y-%m-%d %H:%M:%S') AS last_used FROM ledger GROUP BY ALL""",
        "usage",
        ledger=_PRICED,
    ),
    "read_audit": oracle(
        f"""SELECT 'remove_feed' AS operation, {_KEY} AS feed, '2024-05-06' AS day FROM supplier
WHERE s_suppkey % 7 = 0"""
    ),
    "write_notes": oracle(
        f"""SELECT source AS podcast_slug, '2025-01-01-doc-' || doc_id AS episode_slug,
       CASE WHEN text = '' THEN 0 ELSE 1 END + (doc_id % 2 = 0)::BIGINT AS files,
       CASE WHEN doc_id % 10 = 0 THEN 4.0 WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS cost_usd,
       strlen(text) + 14 AS transcript_bytes FROM documents"""
    ),
    "load_meta": oracle(
        """SELECT doc_id, CAST(CASE WHEN doc_id % 4 = 2 THEN 2 ELSE 1 END AS INT) AS schema_version,
       CASE WHEN doc_id % 4 = 2 THEN 'newer schema version' END AS warning FROM documents"""
    ),
    "stream_usage": oracle(
        """SELECT usage_id, provider, input_tokens, event_id % 97 = 3 AND epoch_us(ts) <= mark AS late
FROM used, watermark""",
        used=_USED,
        watermark="""SELECT max(us) // 1000 * 1000 - 3600000000 AS mark FROM (
  SELECT event_id, epoch_us(ts) AS us, min(epoch_us(ts)) OVER () AS a, max(epoch_us(ts)) OVER () AS z FROM events)
WHERE event_id % 97 <> 3 AND floor((us - a) * 4 / (z - a + 1)) < 2""",
    ),
    "stream_costs": _COSTS,
    "stream_cost_updates": _COSTS,
    "stream_jobs": oracle(
        """SELECT job_id, part AS batch, CASE WHEN stage = 'signup' THEN 'succeeded' ELSE 'running' END AS status, stage
FROM (SELECT *, lag(stage) OVER (PARTITION BY job_id ORDER BY part) AS before FROM (
  SELECT user_id AS job_id, part, CASE WHEN part = ended THEN 'signup'
         ELSE arg_max(newest, seen) OVER (PARTITION BY user_id ORDER BY part) END AS stage
  FROM news LEFT JOIN ends USING (user_id) WHERE ended IS NULL OR part <= ended))
WHERE before IS DISTINCT FROM stage""",
        parts="""SELECT *, CASE WHEN event_id % 97 = 3 THEN 3
         ELSE CAST(floor((epoch_us(ts) - a) * 4 / (z - a + 1)) AS INT) END AS part FROM events,
       (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS z FROM events)""",
        ends="SELECT user_id, min(part) AS ended FROM parts WHERE event_type = 'signup' GROUP BY user_id",
        news="""SELECT user_id, part, max((ts, event_id)) AS seen, arg_max(event_type, (ts, event_id)) AS newest
FROM parts GROUP BY ALL""",
    ),
    "read_cut_feeds": oracle(
        """SELECT page_id % 10 + 1 AS position, 'Talk ' || page_id AS title, url AS link
FROM pages WHERE page_id // 10 % 2 = 0 AND page_id NOT IN (
  SELECT max(page_id) FROM pages GROUP BY page_id // 10)"""
    ),
    "read_texts": oracle(
        """SELECT episode_id, sha256(string_agg(text, chr(10) ORDER BY seg_no) || chr(10)) AS text_hash
FROM segments GROUP BY episode_id""",
        "segments",
    ),
    "audit_rejects": oracle(
        """SELECT '{"timestamp": "broken ' || s_suppkey AS line, 'not JSON' AS reason FROM supplier
WHERE s_suppkey % 9 = 0"""
    ),
    "read_notes": oracle(
        """SELECT 'podcast=' || source AS podcast_dir, 'episode=' || doc_id AS episode_dir,
       CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 || '.0' ELSE 'unknown' END AS version,
       sha256('# ' || text || chr(10)) AS content_hash FROM documents"""
    ),
    "read_templates": oracle(
        """SELECT CASE n_nationkey WHEN 3 THEN 'summary' ELSE lower(n_name) END AS name,
       n_nationkey || '.1' AS version, CAST(n_nationkey AS INT) AS priority,
       CASE WHEN n_nationkey % 2 = 0 THEN 'tech' END AS category, 2::INT AS required_fields,
       2000::INT AS max_tokens FROM nation"""
    ),
}
