"""Texts, ledgers, audit logs and notes from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castloom.functions.documents import body_of, front_matter_of, front_matter_value
from castloom.functions.text import blank
from castloom.operators.rows import validate
from castloom.sources.folders import read_whole

TEXT_FILES = "*.{txt,TXT,md,MD,markdown,MARKDOWN}"
META_VERSION = 1

USAGE = (
    "usage_id string, provider string, model string, operation string, input_tokens bigint, "
    "output_tokens bigint, total_tokens bigint, cost_usd double, cost_known boolean, "
    "billing_mode string, timestamp string, episode_title string, template_name string"
)
AUDIT = (
    "timestamp timestamp, operation string, details string, user string, hostname string, pid bigint"
)


def read_texts(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """One row per UTF-8 text file, and the files that are empty or not UTF-8."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", TEXT_FILES)
        .option("recursiveFileLookup", "true")
        .load(paths)
        .select("path", F.col("content").cast("string").alias("text"))
    )
    valid = F.is_valid_utf8("text")
    return validate(files, {"not UTF-8": valid, "empty": ~valid | ~blank(F.col("text"))})


def _ledger_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    rows = F.from_json("value", f"array<struct<{_fields(USAGE)}>>").alias("rows")
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_name").alias("_file"), rows, F.col("_metadata.file_path").alias("file")
    )


def unread_usage(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, reason) of ledger files that are no JSON array, of which no row is read."""
    bad = _ledger_files(spark, paths).where("rows IS NULL")
    return bad.select("file", F.lit("not a JSON array").alias("reason"))


def read_usage(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Ledger rows from files that each hold one JSON array; ``unread_usage`` has the others.

    A missing id is made from the row and its place in the file, so reading the file again
    gives the same id. ``position`` sorts rows as they are stored. A naive time is UTC, an
    absent total is the sum of both counts.
    """
    rows = _ledger_files(spark, paths).select("_file", F.posexplode("rows").alias("_no", "r"))
    made = F.sha2(F.concat_ws("|", F.to_json("r"), "_file", "_no"), 256)
    r = F.col("r")
    zero = F.lit(0).cast("bigint")
    both = F.coalesce(r["input_tokens"], zero) + F.coalesce(r["output_tokens"], zero)
    return rows.select(
        F.coalesce(r["usage_id"], made).alias("usage_id"),
        F.concat("_file", F.lit("#"), F.lpad(F.col("_no").cast("string"), 10, "0")).alias("position"),
        r["provider"].alias("provider"),
        r["model"].alias("model"),
        r["operation"].alias("operation"),
        F.coalesce(r["input_tokens"], zero).alias("input_tokens"),
        F.coalesce(r["output_tokens"], zero).alias("output_tokens"),
        F.coalesce(F.nullif(r["total_tokens"], zero), both).alias("total_tokens"),
        F.coalesce(r["cost_usd"], F.lit(0.0)).alias("cost_usd"),
        F.coalesce(r["cost_known"], F.lit(True)).alias("cost_known"),
        F.coalesce(r["billing_mode"], F.lit("known")).alias("billing_mode"),
        r["timestamp"].try_cast("timestamp").alias("used_at"),
        r["episode_title"].alias("episode_title"),
        r["template_name"].alias("template_name"),
    )


def _fields(ddl: str) -> str:
    return ", ".join(": ".join(part.strip().split(" ", 1)) for part in ddl.split(","))


def read_audit(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Audit rows from JSON lines, details as JSON text, and the lines that do not parse."""
    parsed = F.from_json("value", f"{AUDIT}, line string", {"columnNameOfCorruptRecord": "line"})
    rows = spark.read.text(paths).where("value <> ''").select("value", parsed.alias("r"))
    broken = F.col("r.line").isNotNull() | F.col("r").isNull()
    bad = rows.where(broken).select(F.col("value").alias("line"), F.lit("not JSON").alias("reason"))
    return rows.where(~broken).select("r.*").drop("line"), bad


def read_notes(
    spark: SparkSession, folder: str, meta: DataFrame | None = None, pattern: str = "*.md"
) -> DataFrame:
    """Markdown notes under ``folder/podcast/episode/``, one row per file.

    ``meta`` (podcast_dir, episode_dir, templates_versions) names the directories that are
    episodes; others are left out. A template's version comes from there, else from the
    note's front matter, else it is ``unknown``.
    """
    parts = F.split("file_path", "/")
    files = read_whole(spark, folder, pattern).select(
        F.element_at(parts, -3).alias("podcast_dir"),
        F.element_at(parts, -2).alias("episode_dir"),
        F.col("file_name").alias("filename"),
        F.col("file_size").alias("size_bytes"),
        F.col("value"),
    )
    front = front_matter_of(F.col("value"))
    notes = files.select(
        "podcast_dir",
        "episode_dir",
        "filename",
        F.regexp_replace("filename", r"\.md$", "").alias("template_name"),
        body_of(F.col("value")).alias("content"),
        front.alias("front_matter"),
        front_matter_value(front, "template_version").alias("_version"),
        "size_bytes",
    )
    unknown = F.lit("unknown")
    if meta is None:
        return notes.withColumn("version", F.coalesce("_version", unknown)).drop("_version")
    joined = notes.join(
        meta.select("podcast_dir", "episode_dir", "templates_versions"), ["podcast_dir", "episode_dir"]
    )
    stored = F.try_element_at("templates_versions", F.col("template_name"))
    return joined.withColumn("version", F.coalesce(stored, "_version", unknown)).drop(
        "_version", "templates_versions"
    )


def load_meta(rows: DataFrame) -> DataFrame:
    """Metadata rows at the current schema version; a newer one is kept with a warning."""
    stored = F.coalesce("schema_version", F.lit(0))
    newer = F.when(stored > META_VERSION, "newer schema version")
    return rows.withColumn("warning", newer).withColumn(
        "schema_version", F.when(stored == 0, META_VERSION).otherwise(stored)
    )
