"""The driver's tables seen as the library's tables, in Spark and as SQL text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castloom.operators.ordered import positions
from castloom.session import shared_dir, tune


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def usage_id(number: Column) -> Column:
    """An id as ledgers have them: a UUID, here made from the number of the row."""
    return F.regexp_replace(
        F.md5(number.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )


def usage(spark: SparkSession, folder: str) -> DataFrame:
    kind, number = F.col("event_type"), F.col("event_id") % 4
    return table(spark, folder, "events").select(
        usage_id(F.col("event_id")).alias("usage_id"),
        F.col("event_id").alias("position"),
        F.when(kind == "view", "youtube")
        .when(kind == "error", "codex")
        .when(kind == "purchase", "claude")
        .otherwise("gemini")
        .alias("provider"),
        F.when(number == 0, "transcription")
        .when(number == 1, "extraction")
        .when(number == 2, "tag_generation")
        .otherwise("interview")
        .alias("operation"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("input_tokens"),
        F.floor(F.col("value") * 50).cast("bigint").alias("output_tokens"),
        (kind != "error").alias("cost_known"),
        F.col("ts").cast("timestamp").alias("used_at"),
        F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("Episode "), "user_id")).alias(
            "episode_title"
        ),
    )


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("episode_id"),
        F.col("source").alias("podcast"),
        F.col("lang").alias("language"),
        "text",
    )


def segments(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("episode_id"),
        F.col("turn").alias("seg_no"),
        "text",
        (F.col("turn") * 60).cast("double").alias("start_s"),
        (F.length("text").cast("double") / 10).alias("duration_s"),
    )


def sources(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("source_id"),
        "url",
        F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host"),
    )


def entries(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(
        F.col("page_id").alias("entry_id"),
        F.regexp_extract("url", r"([^./]+\.[a-z]+)/", 1).alias("feed"),
        "url",
    )
    return positions(pages, ["feed"], ["entry_id"])


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    state, even = F.col("o_orderstatus"), F.col("o_orderkey") % 2 == 0
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("user_id"),
        (F.col("o_orderkey") % 400).alias("source_id"),
        F.when(state == "F", "succeeded")
        .when((state == "O") & even, "running")
        .when(state == "O", "queued")
        .when(even, "failed")
        .otherwise("cancelled")
        .alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def notes(spark: SparkSession, folder: str) -> DataFrame:
    return with_summaries(spark, folder, bare_notes(spark, folder))


def bare_notes(spark: SparkSession, folder: str) -> DataFrame:
    """The notes without their summaries, with the number of the text they come from.

    Summaries are many times as large as all else: joins with other tables come before them.
    """
    orders = table(spark, folder, "orders").where("o_orderstatus = 'F'")
    return orders.select(
        F.col("o_orderkey").alias("note_id"),
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("user_id"),
        (F.col("o_orderkey") % 400).alias("source_id"),
        F.concat(
            F.when(F.col("o_orderkey") % 3 == 0, "Note ").when(F.col("o_orderkey") % 3 == 1, "note ").otherwise("Nöte "),
            F.floor(F.col("o_orderkey") / 8),
        ).alias("title"),
        (F.col("o_orderkey") % table(spark, folder, "documents").count()).alias("_text_no"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def with_summaries(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """The rows of ``bare_notes`` that have a text, with it as their summary but for each fifth."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    told = F.when(F.col("note_id") % 5 != 0, F.col("text")).alias("summary")
    joined = rows.join(documents, F.col("doc_id") == F.col("_text_no"))
    kept = [c for c in rows.columns if c != "_text_no"]
    at = kept.index("created_at")
    return joined.select(*kept[:at], told, *kept[at:])


def cache_entries(spark: SparkSession, folder: str) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("entry_id"),
        F.concat(F.lit("."), "lang").alias("ext"),
        F.col("n_chars").alias("size_bytes"),
        F.timestamp_add("HOUR", F.col("doc_id").cast("int"), start).alias("cached_at"),
    )


def progress(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("job_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "view", "transcription_start")
        .when(kind == "click", "template_selection_start")
        .when(kind == "purchase", "extraction_start")
        .when(kind == "signup", "output_start")
        .otherwise("other")
        .alias("step"),
    )


def results(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    documents = table(spark, folder, "documents").select("doc_id", "n_chars", "source")
    number = F.col("doc_id")
    return labels.join(documents, "doc_id").select(
        number.alias("episode_id"),
        F.when(number % 3 == 0, "summary")
        .when(number % 3 == 1, "quotes")
        .otherwise("key-concepts")
        .alias("template_name"),
        F.when(number % 4 == 0, "claude")
        .when(number % 4 == 1, "codex")
        .otherwise("gemini")
        .alias("provider"),
        (F.col("quality") == 1).alias("success"),
        ((F.col("quality") == 1) & (number % 5 == 0)).alias("from_cache"),
        F.col("toxic").alias("n_warnings"),
        F.when(number % 4 != 0, (number % 10).cast("double") / 10).alias("confidence"),
        F.col("n_chars").alias("input_tokens"),
        (F.col("n_chars") % 500).alias("output_tokens"),
        F.col("source").alias("podcast"),
    )


def note_meta(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    documents = table(spark, folder, "documents").drop("text")
    number = F.col("doc_id")
    return documents.join(labels, "doc_id", "left").select(
        number.alias("note_id"),
        F.col("source").alias("podcast"),
        F.when(number % 3 == 0, "summary")
        .when(number % 3 == 1, "quotes")
        .otherwise("key-concepts")
        .alias("template"),
        F.date_add(F.lit("2024-01-01").cast("date"), number.cast("int")).alias("created_date"),
        F.when(number % 7 != 0, F.floor(F.col("n_chars") / 100).cast("bigint")).alias(
            "duration_minutes"
        ),
        (F.col("quality") * 4 + 1 - F.col("toxic")).alias("rating"),
        F.when(number % 3 == 0, "inbox")
        .when(number % 3 == 1, "reading")
        .otherwise("completed")
        .alias("status"),
        F.when(number % 2 == 0, "high").otherwise("low").alias("priority"),
        F.when(number % 11 != 0, F.split(F.concat_ws(",", "lang", "source"), ",")).alias("topics"),
        F.when(number % 5 != 0, F.concat(F.lit("Guest "), number % 13)).alias("guest"),
        (F.col("n_chars").cast("double") / 100000).alias("cost_usd"),
        F.col("n_chars").alias("word_count"),
    )


_SQL = {
    "usage": """
SELECT regexp_replace(md5(CAST(event_id AS VARCHAR)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$',
         '\\1-\\2-\\3-\\4-\\5') AS usage_id, event_id AS position,
       CASE event_type WHEN 'view' THEN 'youtube' WHEN 'error' THEN 'codex'
            WHEN 'purchase' THEN 'claude' ELSE 'gemini' END AS provider,
       CASE event_id % 4 WHEN 0 THEN 'transcription' WHEN 1 THEN 'extraction'
            WHEN 2 THEN 'tag_generation' ELSE 'interview' END AS operation,
       CAST(floor(value * 1000) AS BIGINT) AS input_tokens,
       CAST(floor(value * 50) AS BIGINT) AS output_tokens,
       event_type <> 'error' AS cost_known, ts AS used_at,
       CASE WHEN user_id % 10 = 0 THEN NULL
            ELSE concat('Episode ', CAST(user_id AS VARCHAR)) END AS episode_title
FROM events""",
    "transcripts": """
SELECT doc_id AS episode_id, source AS podcast, lang AS language, text FROM documents""",
    "segments": """
SELECT conv_id AS episode_id, turn AS seg_no, text,
       CAST(turn * 60 AS DOUBLE) AS start_s,
       CAST(length(text) AS DOUBLE) / 10 AS duration_s
FROM conversations""",
    "sources": r"""
SELECT page_id AS source_id, url,
       regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages""",
    "entries": r"""
SELECT page_id AS entry_id, regexp_extract(url, '([^./]+\.[a-z]+)/', 1) AS feed, url,
       row_number() OVER (PARTITION BY regexp_extract(url, '([^./]+\.[a-z]+)/', 1)
                          ORDER BY page_id) AS position
FROM pages""",
    "jobs": """
SELECT o_orderkey AS job_id, o_custkey AS user_id, o_orderkey % 400 AS source_id,
       CASE WHEN o_orderstatus = 'F' THEN 'succeeded'
            WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'running'
            WHEN o_orderstatus = 'O' THEN 'queued'
            WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'cancelled' END AS status,
       o_orderdate AS created_at
FROM orders""",
    "notes": """
SELECT o.o_orderkey AS note_id, o.o_orderkey AS job_id, o.o_custkey AS user_id,
       o.o_orderkey % 400 AS source_id,
       CASE o.o_orderkey % 3 WHEN 0 THEN 'Note ' WHEN 1 THEN 'note ' ELSE 'Nöte ' END
         || o.o_orderkey // 8 AS title,
       CASE WHEN o.o_orderkey % 5 <> 0 THEN d.text END AS summary,
       o.o_orderdate AS created_at
FROM orders o JOIN documents d ON d.doc_id = o.o_orderkey % (SELECT count(*) FROM documents)
WHERE o.o_orderstatus = 'F'""",
    "cache_entries": """
SELECT doc_id AS entry_id, concat('.', lang) AS ext, n_chars AS size_bytes,
       TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' HOUR AS cached_at
FROM documents""",
    "progress": """
SELECT user_id AS job_id, event_id AS seq, ts,
       CASE event_type WHEN 'view' THEN 'transcription_start'
            WHEN 'click' THEN 'template_selection_start'
            WHEN 'purchase' THEN 'extraction_start'
            WHEN 'signup' THEN 'output_start' ELSE 'other' END AS step
FROM events""",
    "results": """
SELECT l.doc_id AS episode_id,
       CASE l.doc_id % 3 WHEN 0 THEN 'summary' WHEN 1 THEN 'quotes'
            ELSE 'key-concepts' END AS template_name,
       CASE l.doc_id % 4 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'gemini' END AS provider,
       l.quality = 1 AS success, l.quality = 1 AND l.doc_id % 5 = 0 AS from_cache,
       l.toxic AS n_warnings,
       CASE WHEN l.doc_id % 4 = 0 THEN NULL
            ELSE CAST(l.doc_id % 10 AS DOUBLE) / 10 END AS confidence,
       d.n_chars AS input_tokens, d.n_chars % 500 AS output_tokens, d.source AS podcast
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "note_meta": """
SELECT d.doc_id AS note_id, d.source AS podcast,
       CASE d.doc_id % 3 WHEN 0 THEN 'summary' WHEN 1 THEN 'quotes'
            ELSE 'key-concepts' END AS template,
       CAST(TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL '1' DAY AS DATE) AS created_date,
       CASE WHEN d.doc_id % 7 = 0 THEN NULL
            ELSE CAST(floor(d.n_chars / 100) AS BIGINT) END AS duration_minutes,
       l.quality * 4 + 1 - l.toxic AS rating,
       CASE d.doc_id % 3 WHEN 0 THEN 'inbox' WHEN 1 THEN 'reading' ELSE 'completed' END AS status,
       CASE WHEN d.doc_id % 2 = 0 THEN 'high' ELSE 'low' END AS priority,
       CASE WHEN d.doc_id % 11 = 0 THEN NULL
            ELSE string_split(concat(d.lang, ',', d.source), ',') END AS topics,
       CASE WHEN d.doc_id % 5 = 0 THEN NULL
            ELSE concat('Guest ', CAST(d.doc_id % 13 AS VARCHAR)) END AS guest,
       CAST(d.n_chars AS DOUBLE) / 100000 AS cost_usd, d.n_chars AS word_count
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
}


def oracle(select: str, *views: str, **extra: str) -> str:
    """``select`` with the named views, then the extra ones, as common table expressions."""
    named = [(v, _SQL[v].strip()) for v in views] + list(extra.items())
    if not named:
        return select.strip()
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in named) + "\n" + select.strip()
