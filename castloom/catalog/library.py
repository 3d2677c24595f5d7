"""Queries over notes, jobs and caches, and the plain set operations."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from castloom.catalog import bindings as b
from castloom.catalog.bindings import oracle, scratch, table
from castloom.catalog.functions import _SP
from castloom.operators import cache as ca
from castloom.operators import library as lib
from castloom.operators import rows as rw
from castloom.sinks import search, versions

AS_OF = datetime(2024, 2, 20)


def _when(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def _sources(spark, folder):
    return b.sources(spark, folder).select("source_id", "url", F.col("host").alias("title"))


def notes_with_source(spark, folder):
    rows = lib.with_source(b.notes(spark, folder), _sources(spark, folder))
    return rows.select("note_id", F.col("source.url").alias("url"))


def jobs_with_source(spark, folder):
    rows = lib.with_source(b.jobs(spark, folder), _sources(spark, folder))
    return rows.select("job_id", "status", F.col("source.title").alias("source_title"))


def job_note(spark, folder):
    return lib.job_note(b.jobs(spark, folder), b.notes(spark, folder)).select("job_id", "note_id")


def library_tables(spark, folder):
    """Filter, projection, order and limit that reach the scan."""
    jobs = b.jobs(spark, folder).where("status = 'failed'")
    return jobs.orderBy(F.col("created_at").desc(), "job_id").limit(20).select("job_id", "user_id")


def library_rows(spark, folder):
    """The same filter and projection without a limit."""
    jobs = b.jobs(spark, folder).where("status = 'failed'")
    return jobs.select("job_id", "user_id", "source_id")


def _searchable(spark, folder):
    rows = lib.with_source(b.bare_notes(spark, folder), _sources(spark, folder))
    return b.with_summaries(spark, folder, rows).select(
        "note_id", "title", "summary", "created_at",
        F.col("source.url").alias("source_url"), F.col("source.title").alias("source_title"),
    )


def search_notes(spark, folder):
    found = lib.search_notes(_searchable(spark, folder), " Example.ORG ")
    return found.select("note_id")


def search_note_files(spark, folder):
    """The same search over stored notes, of which only files that may match are read."""
    path = scratch(spark, "notes")
    # Notes of one source stay together, so that rare sources are in few files.
    _searchable(spark, folder).repartitionByRange("source_title", "note_id").write.parquet(f"{path}/rows")
    search.write_signatures(spark, f"{path}/rows", f"{path}/signatures")
    return search.search_files(spark, f"{path}/rows", f"{path}/signatures", " Example.ORG ").select("note_id")


def search_summaries(spark, folder):
    return lib.search_notes(_searchable(spark, folder), "of the", "summaries").select("note_id")


def search_recent(spark, folder):
    return lib.search_notes(_searchable(spark, folder), "", "recent").select("note_id")


def sort_notes(spark, folder):
    rows = b.notes(spark, folder).drop("summary")
    newest = lib.note_positions(rows).select(F.lit("newest").alias("by"), "position", "note_id")
    titles = lib.note_positions(rows, "title").select(F.lit("title").alias("by"), "position", "note_id")
    return newest.unionByName(titles)


def open_jobs(spark, folder):
    return lib.open_jobs(b.jobs(spark, folder)).select("job_id", "status")


def _meta(spark, folder):
    return b.note_meta(spark, folder)


def filter_notes(spark, folder):
    rows = lib.filter_notes(
        _meta(spark, folder), equals={"template": "summary"}, has={"topics": "en", "guest": "Guest 1"},
        over={"duration_minutes": 3}, present=["guest"],
    )
    return rows.select("note_id", "guest")


def filter_custom(spark, folder):
    """Free fields and the last days before a given one."""
    rows = _meta(spark, folder).withColumn(
        "custom_fields",
        F.try_parse_json(F.concat(F.lit('{"source_kind":{"name":"'), "podcast", F.lit('"}}'))),
    )
    found = lib.filter_notes(
        rows, custom={"source_kind.name": "src3"}, absent=["rating"],
        last_days=("created_date", 400, date(2025, 6, 1)),
    )
    return found.select("note_id")


def _files(spark, folder):
    """Three files per document; every ninth document has hidden ones only."""
    rows = table(spark, folder, "documents")
    hidden = F.when(F.col("doc_id") % 9 == 0, "_").otherwise("")
    listed = F.array(
        F.struct(F.lit("_transcript").alias("t"), F.lit("_transcript.md").alias("f"), F.col("text").alias("c")),
        F.struct(F.lit("summary").alias("t"), F.concat(hidden, F.lit("summary.md")).alias("f"),
                 F.concat(F.lit("---\na: 1\n---\n\n"), "text").alias("c")),
        F.struct(F.lit("key-concepts").alias("t"), F.concat(hidden, F.lit("key-concepts.md")).alias("f"),
                 F.when(F.col("doc_id") % 4 == 0, F.lit(" \n")).otherwise(F.col("source")).alias("c")),
    )
    return rows.select(
        F.col("doc_id").alias("episode_id"), F.col("source").alias("title"),
        F.concat(F.lit("https://x.test/"), "doc_id").alias("url"),
        F.posexplode(listed).alias("file_no", "file"),
    ).select(
        "episode_id", "title", "url", "file_no", F.col("file.f").alias("filename"),
        F.col("file.t").alias("template_name"), F.col("file.c").alias("content"),
        F.octet_length("file.c").cast("bigint").alias("size_bytes"),
    )


def assemble_notes(spark, folder):
    notes = lib.assemble_notes(_files(spark, folder))
    return notes.select(
        "episode_id", F.sha2("body_markdown", 256).alias("body_hash"), F.sha2("summary", 256).alias("summary_hash")
    )


def library_stats(spark, folder):
    return lib.library_stats(_files(spark, folder))


def dashboard_counts(spark, folder):
    return lib.dashboard_counts(b.jobs(spark, folder), b.notes(spark, folder))


def podcast_stats(spark, folder):
    return lib.podcast_stats(_meta(spark, folder).where("template = 'summary'"))


def topic_counts(spark, folder):
    return lib.topic_counts(_meta(spark, folder))


def guest_counts(spark, folder):
    return lib.guest_counts(_meta(spark, folder))


def listening_time(spark, folder):
    return lib.listening_time(_meta(spark, folder))


def monthly_timeline(spark, folder):
    return lib.monthly_timeline(_meta(spark, folder))


def cost_word_stats(spark, folder):
    row = lib.cost_word_stats(_meta(spark, folder))
    return row.withColumns({c: F.round(c, 6) for c in ("total_cost_usd", "avg_cost_usd")})


def status_dashboard(spark, folder):
    return lib.status_dashboard(_meta(spark, folder).where("template = 'summary'"))


def note_tables(spark, folder):
    rows = _meta(spark, folder)
    tables = {
        "inbox": lib.note_table(rows.where("status = 'inbox'"), ("priority", True), ("created_date", True), limit=10),
        "top rated": lib.note_table(rows.where("rating >= 4"), ("rating", True), ("created_date", True), limit=10),
        "recent": lib.note_table(rows, ("created_date", True), limit=15),
        "dearest": lib.note_table(rows.where("template = 'summary'"), ("cost_usd", True), limit=20),
    }
    first, *more = [t.select(F.lit(n).alias("shown_as"), "note_id") for n, t in tables.items()]
    return rw.union_rows(first, *more)


def stage_changes(spark, folder):
    return lib.stage_changes(b.progress(spark, folder)).select("job_id", "seq", "stage")


def step_states(spark, folder):
    k = F.col("job_id")
    stage = F.when(k % 9 != 8, F.get(F.array(*[F.lit(s) for s in lib.STEPS]), (k % 6).cast("int")))
    rows = b.jobs(spark, folder).withColumn("stage", stage)
    return lib.step_states(rows).select("job_id", "step", "state")


def upsert_notes(spark, folder):
    return lib.upsert_notes(*_upserts(spark, folder))


def _upserts(spark, folder):
    notes = b.notes(spark, folder).select("note_id", "job_id", "title")
    batch = notes.where(F.col("job_id") % 3 == 0).withColumn("title", F.lit("New"))
    more = batch.withColumns({"job_id": F.col("job_id") + 1, "note_id": -F.col("note_id")})
    return notes, batch.unionByName(more)


def store_notes(spark, folder):
    """The same, written as two versions of a table; with what the first one holds."""
    path = scratch(spark, "notes")
    for batch in _upserts(spark, folder):
        versions.put_notes(batch, path)
    table = versions.Table(spark, path, "job_id")
    return rw.union_rows(*(table.read(v).withColumn("version", F.lit(v)) for v in table.versions()))


def merge_files(spark, folder):
    old = _files(spark, folder).where(F.col("episode_id") % 3 != 0)
    new = _files(spark, folder).where("template_name <> 'key-concepts'").withColumn("content", F.lit("new"))
    merged = lib.merge_files(old, new)
    return merged.select("episode_id", "template_name", (F.col("content") == "new").alias("is_new"))


def merge_meta(spark, folder):
    number = F.col("doc_id")
    old = table(spark, folder, "documents").select(
        number.alias("episode_id"),
        F.array(F.lit("summary"), F.lit("quotes")).alias("templates_applied"),
        F.create_map(F.lit("summary"), F.lit("1.0"), F.lit("quotes"), F.lit("1.0")).alias("templates_versions"),
        F.lit(0.5).alias("transcription_cost_usd"),
        F.lit(0.25).alias("extraction_cost_usd"),
        F.lit(0.75).alias("total_cost_usd"),
    )
    results = b.results(spark, folder).select(
        "episode_id", F.lit(0).alias("result_no"), "template_name",
        F.lit("2.0").alias("template_version"), F.lit(0.125).alias("cost_usd"),
    )
    merged = lib.merge_meta(old, results)
    return merged.select(
        "episode_id",
        F.array_join("templates_applied", ",").alias("applied"),
        *[F.try_element_at("templates_versions", F.lit(t)).alias(t.replace("-", "_"))
          for t in ("summary", "quotes", "key-concepts")],
        "extraction_cost_usd", "total_cost_usd",
    )


def _cache(spark, folder):
    return b.cache_entries(spark, folder).withColumn(
        "cached_at", F.when(F.col("entry_id") % 10 != 7, F.col("cached_at"))
    )


def cache_stats(spark, folder):
    return ca.cache_stats(_cache(spark, folder), AS_OF)


def cache_counts(spark, folder):
    rows = _cache(spark, folder).withColumn("version", F.when(F.col("entry_id") % 3 == 0, F.lit(3)))
    return ca.cache_counts(rows, "ext", "version")


def media_stats(spark, folder):
    name = F.when(F.col("entry_id") % 6 == 0, F.lit("file")).otherwise(
        F.concat(F.lit("a.b"), "entry_id", F.upper("ext"))
    )
    return ca.media_stats(b.cache_entries(spark, folder).withColumn("filename", name))


def drop_expired(spark, folder):
    kept, gone = ca.drop_expired(_cache(spark, folder), AS_OF)
    return rw.union_rows(
        kept.select("entry_id", F.lit("kept").alias("fate")), gone.select("entry_id", F.lit("removed").alias("fate"))
    )


def put_cache(spark, folder):
    rows = b.cache_entries(spark, folder).select(
        (F.col("entry_id") % 300).alias("cache_key"), F.col("entry_id").alias("value"), "cached_at"
    )
    old, new = rows.where(F.col("value") % 2 == 0), rows.where(F.col("value") % 2 == 1)
    return ca.put_cache(old, new).select("cache_key", "value")


def store_cache(spark, folder):
    """Entries put into a table in two batches; the newest of each key stays."""
    rows = b.cache_entries(spark, folder).select(
        (F.col("entry_id") % 300).alias("cache_key"), F.col("entry_id").alias("value"), "cached_at"
    )
    path = scratch(spark, "cache")
    for batch in (rows.where("value % 2 = 0"), rows.where("value % 2 = 1")):
        versions.store_cache(batch, path)
    return versions.Table(spark, path, "cache_key").read().select("cache_key", "value")


def _media(spark, folder):
    return b.cache_entries(spark, folder).select(
        F.col("ext").alias("cache"), F.col("entry_id").alias("file_id"), "size_bytes", "cached_at",
        (F.col("entry_id") % 50 == 3).alias("protected"),
    )


def evict(spark, folder):
    return ca.evict(_media(spark, folder), 200_000, AS_OF, 30, ["cache"]).select("cache", "file_id", "reason")


def evict_all(spark, folder):
    """One cache over the whole table."""
    return ca.evict(_media(spark, folder), 500_000, AS_OF, 30).select("file_id", "reason")


def evict_report(spark, folder):
    return ca.evict_report(ca.evict(_media(spark, folder), 500_000, AS_OF, 30))


def keep_first(spark, folder):
    rows = b.transcripts(spark, folder).select("text", "episode_id", "podcast")
    return rw.keep_first(rows, ["text"], ["episode_id"]).select("episode_id", "podcast")


def new_rows(spark, folder):
    rows = b.transcripts(spark, folder).select("episode_id", F.sha2("text", 256).alias("key"))
    old = rows.where(F.col("episode_id") % 2 == 0)
    return rw.new_rows(rows.where(F.col("episode_id") % 2 == 1), old, "key").select("episode_id")


def union_rows(spark, folder):
    rows = b.usage(spark, folder).select("provider", "operation")
    both = rw.union_rows(rows, rows.where("provider = 'gemini'"))
    return both.groupBy("provider", "operation").agg(F.count(F.lit(1)).alias("records"))


def distinct_union(spark, folder):
    names = b.results(spark, folder).select(F.col("template_name").alias("name"))
    more = b.transcripts(spark, folder).select(F.col("podcast").alias("name"))
    return rw.distinct_union(names, more)


def except_rows(spark, folder):
    asked = b.transcripts(spark, folder).select("episode_id")
    return rw.new_rows(asked, b.results(spark, folder), "episode_id")


def intersect_rows(spark, folder):
    asked = b.transcripts(spark, folder).where("language = 'en'").select("episode_id")
    return rw.shared_rows(asked, b.results(spark, folder), "episode_id")


QUERIES = {
    "notes_with_source": notes_with_source,
    "jobs_with_source": jobs_with_source,
    "job_note": job_note,
    "library_tables": library_tables,
    "library_rows": library_rows,
    "search_notes": search_notes,
    "search_note_files": search_note_files,
    "search_summaries": search_summaries,
    "search_recent": search_recent,
    "sort_notes": sort_notes,
    "open_jobs": open_jobs,
    "filter_notes": filter_notes,
    "filter_custom": filter_custom,
    "assemble_notes": assemble_notes,
    "library_stats": library_stats,
    "dashboard_counts": dashboard_counts,
    "podcast_stats": podcast_stats,
    "topic_counts": topic_counts,
    "guest_counts": guest_counts,
    "listening_time": listening_time,
    "monthly_timeline": monthly_timeline,
    "cost_word_stats": cost_word_stats,
    "status_dashboard": status_dashboard,
    "note_tables": note_tables,
    "stage_changes": stage_changes,
    "step_states": step_states,
    "upsert_notes": upsert_notes,
    "store_notes": store_notes,
    "merge_files": merge_files,
    "merge_meta": merge_meta,
    "cache_stats": cache_stats,
    "cache_counts": cache_counts,
    "media_stats": media_stats,
    "drop_expired": drop_expired,
    "put_cache": put_cache,
    "store_cache": store_cache,
    "evict": evict,
    "evict_all": evict_all,
    "evict_report": evict_report,
    "keep_first": keep_first,
    "new_rows": new_rows,
    "union_rows": union_rows,
    "distinct_union": distinct_union,
    "except_rows": except_rows,
    "intersect_rows": intersect_rows,
}

_EMBEDDED = """SELECT n.*, s.url AS source_url, s.host AS source_title
FROM notes n LEFT JOIN sources s ON s.source_id = n.source_id"""
_CACHE = """SELECT entry_id, ext, size_bytes,
       CASE WHEN entry_id % 10 <> 7 THEN cached_at END AS cached_at FROM cache_entries"""
_OLD = "cached_at < TIMESTAMP '2024-01-21 00:00:00'"
_MEDIA = """SELECT ext AS cache, entry_id AS file_id, size_bytes, cached_at,
       entry_id % 50 = 3 AS protected FROM cache_entries"""


def _evicted(limit: int, part: str) -> str:
    return f"""SELECT cache, file_id, size_bytes, 'expired' AS reason FROM media
WHERE {_OLD} AND NOT protected
UNION ALL SELECT cache, file_id, size_bytes, 'size' FROM (
  SELECT *, sum(size_bytes) OVER ({part}) AS total,
         sum(CASE WHEN protected THEN 0 ELSE size_bytes END) OVER ({part}
           ORDER BY cached_at, file_id ROWS UNBOUNDED PRECEDING) - size_bytes AS before
  FROM media WHERE NOT ({_OLD} AND NOT protected)) WHERE NOT protected AND total - before > {limit}"""


_FILES = """SELECT doc_id AS episode_id, source AS title, 'https://x.test/' || doc_id AS url, t.no,
       CASE WHEN t.no = 0 THEN '_transcript.md' WHEN doc_id % 9 = 0 THEN '_' || t.name || '.md'
            ELSE t.name || '.md' END AS filename, t.name AS template_name,
       CASE t.no WHEN 0 THEN text WHEN 1 THEN E'---\\na: 1\\n---\\n\\n' || text
            ELSE CASE WHEN doc_id % 4 = 0 THEN E' \\n' ELSE source END END AS content, text
FROM documents, (VALUES (0, '_transcript'), (1, 'summary'), (2, 'key-concepts')) AS t(no, name)"""
_STRIPPED = f"regexp_replace(text, '^{_SP}+|{_SP}+$', '', 'g')"

ORACLES = {
    "notes_with_source": oracle(
        "SELECT note_id, source_url AS url FROM embedded", "notes", "sources", embedded=_EMBEDDED
    ),
    "jobs_with_source": oracle(
        """SELECT job_id, status, host AS source_title FROM jobs LEFT JOIN sources
  ON sources.source_id = jobs.source_id""",
        "jobs",
        "sources",
    ),
    "job_note": oracle(
        "SELECT jobs.job_id, note_id FROM jobs LEFT JOIN notes ON notes.job_id = jobs.job_id",
        "jobs",
        "notes",
    ),
    "library_rows": oracle(
        "SELECT job_id, user_id, source_id FROM jobs WHERE status = 'failed'", "jobs"
    ),
    "library_tables": oracle(
        "SELECT job_id, user_id FROM jobs WHERE status = 'failed' ORDER BY created_at DESC, job_id LIMIT 20",
        "jobs",
    ),
    "search_notes": oracle(
        """SELECT note_id FROM embedded WHERE contains(lower(title), 'example.org')
   OR contains(lower(coalesce(summary, '')), 'example.org')
   OR contains(lower(coalesce(source_url, '')), 'example.org')
   OR contains(lower(coalesce(source_title, '')), 'example.org')""",
        "notes",
        "sources",
        embedded=_EMBEDDED,
    ),
    "search_note_files": oracle(
        """SELECT note_id FROM embedded WHERE contains(lower(title), 'example.org')
   OR contains(lower(coalesce(summary, '')), 'example.org')
   OR contains(lower(coalesce(source_url, '')), 'example.org')
   OR contains(lower(coalesce(source_title, '')), 'example.org')""",
        "notes",
        "sources",
        embedded=_EMBEDDED,
    ),
    "search_summaries": oracle(
        "SELECT note_id FROM notes WHERE contains(lower(summary), 'of the')", "notes"
    ),
    "search_recent": oracle(
        "SELECT note_id FROM notes ORDER BY created_at DESC, note_id LIMIT 5", "notes"
    ),
    "sort_notes": oracle(
        """SELECT 'newest' AS by, row_number() OVER (ORDER BY created_at DESC, note_id) AS position, note_id
FROM notes
UNION ALL SELECT 'title', row_number() OVER (ORDER BY lower(strip_accents(title)),
       title <> strip_accents(title), title <> lower(title), note_id), note_id FROM notes""",
        "notes",
    ),
    "open_jobs": oracle("SELECT job_id, status FROM jobs WHERE status <> 'succeeded'", "jobs"),
    "filter_notes": oracle(
        """SELECT note_id, guest FROM note_meta WHERE template = 'summary' AND list_contains(topics, 'en')
  AND contains(guest, 'Guest 1') AND duration_minutes > 3""",
        "note_meta",
    ),
    "filter_custom": oracle(
        """SELECT note_id FROM note_meta WHERE podcast = 'src3' AND rating IS NULL
  AND created_date >= DATE '2025-06-01' - 400""",
        "note_meta",
    ),
    "assemble_notes": oracle(
        f"""SELECT episode_id, sha256('# ' || any_value(title) || E'\\n\\n[Source](' || any_value(url) || ')' ||
       coalesce(string_agg(E'\\n\\n## ' || heading || E'\\n\\n' || body, '' ORDER BY no)
         FILTER (shown AND body <> ''), '') || E'\\n') AS body_hash,
       sha256(CASE WHEN max(s) = '' THEN NULL WHEN length(max(s)) <= 1600 THEN max(s)
         ELSE regexp_replace(left(max(s), 1597), '{_SP}+$', '') || '...' END) AS summary_hash
FROM (SELECT *, no > 0 OR episode_id % 9 = 0 AS shown,
        CASE no WHEN 2 THEN CASE WHEN episode_id % 4 = 0 THEN '' ELSE title END ELSE {_STRIPPED} END
          AS body, {_STRIPPED} AS s,
        CASE WHEN no = 0 OR episode_id % 9 = 0 THEN ' ' ELSE '' END ||
          CASE no WHEN 0 THEN 'Transcript' WHEN 1 THEN 'Summary' ELSE 'Key Concepts' END AS heading
      FROM files) GROUP BY episode_id""",
        files=_FILES,
    ),
    "library_stats": oracle(
        """SELECT count(DISTINCT episode_id) AS total_episodes, count(*) AS total_files,
       CAST(format('{:.2f}', sum(strlen(content)) / 1048576.0::DOUBLE) AS DOUBLE) AS total_size_mb
FROM files""",
        files=_FILES,
    ),
    "dashboard_counts": oracle(
        """SELECT count(*) FILTER (status IN ('queued', 'running')) AS active_jobs,
       count(*) FILTER (status = 'failed') AS failed_jobs,
       (SELECT least(5, count(*)) FROM notes) AS notes
FROM (SELECT * FROM jobs ORDER BY created_at DESC, job_id LIMIT 5)""",
        "jobs",
        "notes",
    ),
    "podcast_stats": oracle(
        """SELECT podcast, count(*) AS episodes, coalesce(round(avg(rating), 1), 0.0) AS avg_rating,
       CAST(round(sum(coalesce(duration_minutes, 0)) / 60.0::DOUBLE) AS BIGINT) AS total_hours
FROM note_meta WHERE template = 'summary' GROUP BY podcast""",
        "note_meta",
    ),
    "topic_counts": oracle(
        """SELECT topic, count(*) AS episodes, CAST(round(count(*) * 100.0::DOUBLE /
       (SELECT count(*) FROM note_meta WHERE topics IS NOT NULL)) AS BIGINT) AS percent
FROM (SELECT unnest(topics) AS topic FROM note_meta) GROUP BY topic
ORDER BY count(*) DESC, topic LIMIT 15""",
        "note_meta",
    ),
    "guest_counts": oracle(
        """SELECT guest, count(*) AS appearances FROM note_meta WHERE guest IS NOT NULL
GROUP BY guest ORDER BY count(*) DESC, guest LIMIT 10""",
        "note_meta",
    ),
    "listening_time": oracle(
        """SELECT podcast, count(*) AS episodes,
       CAST(round(sum(duration_minutes) / 60.0::DOUBLE) AS BIGINT) AS hours,
       round(sum(duration_minutes) / 1440.0::DOUBLE, 1) AS days
FROM note_meta WHERE duration_minutes IS NOT NULL GROUP BY podcast""",
        "note_meta",
    ),
    "monthly_timeline": oracle(
        "SELECT strftime(created_date, '%Y-%m') AS month, count(*) AS episodes FROM note_meta GROUP BY 1",
        "note_meta",
    ),
    "cost_word_stats": oracle(
        """SELECT count(*) AS episodes, round(sum(cost_usd), 6) AS total_cost_usd,
       round(avg(cost_usd), 6) AS avg_cost_usd, CAST(sum(word_count) AS BIGINT) AS total_words,
       CAST(round(avg(word_count)) AS BIGINT) AS avg_words, max(word_count) AS max_words FROM note_meta""",
        "note_meta",
    ),
    "status_dashboard": oracle(
        """SELECT count(*) AS episodes, count(*) FILTER (status = 'inbox') AS inbox,
       count(*) FILTER (status = 'reading') AS reading,
       count(*) FILTER (status = 'completed') AS completed,
       CAST(round(sum(coalesce(duration_minutes, 0)) / 60.0::DOUBLE) AS BIGINT) AS total_hours
FROM note_meta WHERE template = 'summary'""",
        "note_meta",
    ),
    "note_tables": oracle(
        """SELECT 'inbox' AS shown_as, note_id FROM (SELECT * FROM note_meta WHERE status = 'inbox'
  ORDER BY priority DESC, created_date DESC, note_id LIMIT 10)
UNION ALL SELECT 'top rated', note_id FROM (SELECT * FROM note_meta WHERE rating >= 4
  ORDER BY rating DESC, created_date DESC, note_id LIMIT 10)
UNION ALL SELECT 'recent', note_id FROM (SELECT * FROM note_meta
  ORDER BY created_date DESC, note_id LIMIT 15)
UNION ALL SELECT 'dearest', note_id FROM (SELECT * FROM note_meta WHERE template = 'summary'
  ORDER BY cost_usd DESC, note_id LIMIT 20)""",
        "note_meta",
    ),
    "stage_changes": oracle(
        """SELECT job_id, seq, stage FROM (
  SELECT *, lag(stage) OVER (PARTITION BY job_id ORDER BY ts, seq) AS before FROM (
    SELECT job_id, ts, seq, CASE step WHEN 'transcription_start' THEN 'extracting_transcript'
      WHEN 'template_selection_start' THEN 'generating_notes'
      WHEN 'extraction_start' THEN 'generating_notes'
      WHEN 'output_start' THEN 'saving_result' END AS stage FROM progress)
  WHERE stage IS NOT NULL) WHERE stage IS DISTINCT FROM before""",
        "progress",
    ),
    "step_states": oracle(
        """SELECT job_id, s.step, CASE WHEN status = 'failed' AND here THEN 'failed'
       WHEN status = 'succeeded' THEN 'complete'
       WHEN status = 'cancelled' THEN CASE WHEN here THEN 'cancelled' ELSE 'upcoming' END
       WHEN s.no < now THEN 'complete' WHEN s.no = now THEN 'current' ELSE 'upcoming' END AS state
FROM (SELECT job_id, status, s.no, s.step, CASE WHEN job_id % 9 = 8 THEN 0 ELSE job_id % 6 END AS now,
             job_id % 9 <> 8 AND s.no = job_id % 6 AS here
      FROM jobs, (VALUES (0, 'queued'), (1, 'fetching_source'), (2, 'extracting_transcript'),
        (3, 'generating_notes'), (4, 'saving_result'), (5, 'done')) AS s(no, step)) s""",
        "jobs",
    ),
    "upsert_notes": oracle(
        """SELECT note_id, job_id, title FROM notes n WHERE job_id % 3 <> 0 AND NOT EXISTS (
  SELECT 1 FROM notes m WHERE m.job_id % 3 = 0 AND m.job_id + 1 = n.job_id)
UNION ALL SELECT note_id, job_id, 'New' FROM notes WHERE job_id % 3 = 0
UNION ALL SELECT -note_id, job_id + 1, 'New' FROM notes WHERE job_id % 3 = 0""",
        "notes",
    ),
    "merge_files": oracle(
        """SELECT episode_id, template_name, template_name = 'summary' OR
       (template_name = '_transcript' AND episode_id % 3 = 0) AS is_new FROM files
WHERE template_name <> 'key-concepts' OR episode_id % 3 <> 0""",
        files=_FILES,
    ),
    "merge_meta": oracle(
        """SELECT doc_id AS episode_id, CASE WHEN template_name = 'key-concepts'
       THEN 'summary,quotes,key-concepts' ELSE 'summary,quotes' END AS applied,
       CASE WHEN template_name = 'summary' THEN '2.0' ELSE '1.0' END AS summary,
       CASE WHEN template_name = 'quotes' THEN '2.0' ELSE '1.0' END AS quotes,
       CASE WHEN template_name = 'key-concepts' THEN '2.0' END AS key_concepts,
       CASE WHEN template_name IS NULL THEN 0.25 ELSE 0.375 END::DOUBLE AS extraction_cost_usd,
       CASE WHEN template_name IS NULL THEN 0.75 ELSE 0.875 END::DOUBLE AS total_cost_usd
FROM documents LEFT JOIN results ON episode_id = doc_id""",
        "results",
    ),
    "cache_stats": oracle(
        f"""SELECT count(*) AS total, count(*) FILTER ({_OLD}) AS expired,
       count(*) - count(*) FILTER ({_OLD}) AS valid,
       CAST(sum(size_bytes) FILTER (cached_at IS NOT NULL) AS BIGINT) AS size_bytes,
       CAST(format('{{:.2f}}', sum(size_bytes) FILTER (cached_at IS NOT NULL) / 1048576.0::DOUBLE)
         AS DOUBLE) AS size_mb,
       round(epoch(TIMESTAMP '2024-02-20' - min(cached_at)) / 86400.0::DOUBLE, 1) AS oldest_age_days
FROM cache""",
        "cache_entries",
        cache=_CACHE,
    ),
    "cache_counts": oracle(
        """SELECT 'ext' AS field, ext AS value, count(*) AS entries FROM cache
WHERE cached_at IS NOT NULL GROUP BY ext
UNION ALL SELECT 'version', CASE WHEN entry_id % 3 = 0 THEN '3' ELSE 'unknown' END, count(*)
FROM cache WHERE cached_at IS NOT NULL GROUP BY 2""",
        "cache_entries",
        cache=_CACHE,
    ),
    "media_stats": oracle(
        """SELECT CASE WHEN entry_id % 6 = 0 THEN '<none>' ELSE ext END AS extension,
       count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM cache_entries GROUP BY 1""",
        "cache_entries",
    ),
    "drop_expired": oracle(
        f"""SELECT entry_id, CASE WHEN cached_at IS NULL OR {_OLD} THEN 'removed' ELSE 'kept' END AS fate
FROM cache""",
        "cache_entries",
        cache=_CACHE,
    ),
    "store_notes": oracle(
        """SELECT note_id, job_id, title, 0::INT AS version FROM notes
UNION ALL SELECT note_id, job_id, title, 1 FROM notes n WHERE job_id % 3 <> 0 AND NOT EXISTS (
  SELECT 1 FROM notes m WHERE m.job_id % 3 = 0 AND m.job_id + 1 = n.job_id)
UNION ALL SELECT note_id, job_id, 'New', 1 FROM notes WHERE job_id % 3 = 0
UNION ALL SELECT -note_id, job_id + 1, 'New', 1 FROM notes WHERE job_id % 3 = 0""",
        "notes",
    ),
    "put_cache": oracle(
        """SELECT entry_id % 300 AS cache_key, max(entry_id) AS value FROM cache_entries GROUP BY 1""",
        "cache_entries",
    ),
    "store_cache": oracle(
        """SELECT entry_id % 300 AS cache_key, max(entry_id) AS value FROM cache_entries GROUP BY 1""",
        "cache_entries",
    ),
    "evict": oracle(
        "SELECT cache, file_id, reason FROM evicted",
        "cache_entries",
        media=_MEDIA,
        evicted=_evicted(200_000, "PARTITION BY cache"),
    ),
    "evict_all": oracle(
        "SELECT file_id, reason FROM evicted",
        "cache_entries",
        media=_MEDIA,
        evicted=_evicted(500_000, ""),
    ),
    "evict_report": oracle(
        """SELECT count(*) FILTER (reason = 'expired') AS expired_files,
       count(*) FILTER (reason = 'size') AS size_files,
       CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes_deleted FROM evicted""",
        "cache_entries",
        media=_MEDIA,
        evicted=_evicted(500_000, ""),
    ),
    "keep_first": oracle(
        "SELECT min(episode_id) AS episode_id, arg_min(podcast, episode_id) AS podcast FROM transcripts GROUP BY text",
        "transcripts",
    ),
    "new_rows": oracle(
        """SELECT episode_id FROM transcripts a WHERE episode_id % 2 = 1 AND NOT EXISTS (
  SELECT 1 FROM transcripts o WHERE o.episode_id % 2 = 0 AND o.text = a.text)""",
        "transcripts",
    ),
    "union_rows": oracle(
        """SELECT provider, operation, count(*) AS records FROM (SELECT * FROM usage UNION ALL
  SELECT * FROM usage WHERE provider = 'gemini') GROUP BY ALL""",
        "usage",
    ),
    "distinct_union": oracle(
        "SELECT template_name AS name FROM results UNION SELECT podcast FROM transcripts",
        "results",
        "transcripts",
    ),
    "except_rows": oracle(
        "SELECT episode_id FROM transcripts EXCEPT SELECT episode_id FROM results",
        "results",
        "transcripts",
    ),
    "intersect_rows": oracle(
        """SELECT episode_id FROM transcripts WHERE language = 'en'
INTERSECT SELECT episode_id FROM results""",
        "results",
        "transcripts",
    ),
}
