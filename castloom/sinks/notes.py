"""Writing notes, ledgers and audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from castloom.functions.documents import front_matter, render
from castloom.functions.text import episode_directory, path_part
from castloom.operators.rows import new_rows
from castloom.session import staged

_EPISODE = ["podcast_slug", "episode_slug"]


def note_rows(results: DataFrame, transcripts: DataFrame, day) -> DataFrame:
    """Rows to write: the transcript first, then one file per result.

    ``results`` carries what ``front_matter`` reads plus content_text, content_json,
    result_no, published and processed; ``transcripts`` has (podcast, episode, text,
    summary, published, processed). The cost of an episode is the sum over its rows.
    """
    files = results.select(
        "podcast", "episode", "published", "processed",
        (F.col("result_no") + 1).cast("bigint").alias("file_no"),
        "template_name", "template_version",
        F.concat(F.col("template_name"), F.lit(".md")).alias("filename"),
        F.concat(front_matter(day), F.lit("\n\n"),
                 render(F.col("template_name"), F.col("content_text"), F.col("content_json"))).alias("content"),
        F.col("cost_usd"),
    )
    told = F.coalesce("summary", F.lit("")) != ""
    body = F.when(
        told,
        F.concat(F.lit("# Transcript\n\n## Summary\n\n"), "summary",
                 F.lit("\n\n---\n\n## Full Transcript\n\n"), "text"),
    ).otherwise(F.concat(F.lit("# Transcript\n\n"), "text"))
    spoken = transcripts.where(F.coalesce("text", F.lit("")) != "").select(
        "podcast", "episode", "published", "processed",
        F.lit(0).cast("bigint").alias("file_no"),
        F.lit("_transcript").alias("template_name"),
        F.lit("unknown").alias("template_version"),
        F.lit("_transcript.md").alias("filename"),
        body.alias("content"),
        F.lit(0.0).alias("cost_usd"),
    )
    rows = spoken.unionByName(files)
    directory = episode_directory(F.col("podcast"), F.col("episode"), F.col("published"), F.col("processed"))
    return rows.select(
        path_part(F.split(directory, "/")[0]).alias("podcast_slug"),
        path_part(F.split(directory, "/")[1]).alias("episode_slug"),
        "file_no", "filename", "template_name", "template_version", "content", "cost_usd",
        F.octet_length("content").cast("bigint").alias("size_bytes"),
    )


def read_note_table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


#: Folders that a podcast's episodes are dealt to; replacing an episode rewrites one of them.
BUCKETS = 16
_PLACE = ["podcast_slug", "bucket"]


def write_notes(notes: DataFrame, path: str, overwrite: bool = False, buckets: int = BUCKETS) -> None:
    """Store note rows by podcast and bucket; an episode already there is an error unless
    overwritten.

    One commit: the folders that get new rows are written anew, with what stays of them, and
    take the place of the old ones together. One file per folder.
    """
    spark = notes.sparkSession
    if notes.where("podcast_slug IS NULL OR episode_slug IS NULL").limit(1).count():
        raise ValueError("an episode directory is empty")
    bucket = F.pmod(F.xxhash64("episode_slug"), F.lit(buckets)).cast("int")
    notes = notes.withColumn("bucket", bucket)
    existing = read_note_table(spark, path)
    if existing is None:
        notes.repartition(*_PLACE).write.partitionBy(*_PLACE).parquet(path)
        return
    clash = existing.join(notes.select(*_EPISODE), _EPISODE, "left_semi").select(*_EPISODE)
    if not overwrite and (first := clash.first()):
        raise FileExistsError(f"episode exists: {first['podcast_slug']}/{first['episode_slug']}")
    touched = existing.join(notes.select(*_PLACE).distinct(), _PLACE, "left_semi")
    kept = new_rows(touched, notes.select(*_EPISODE), _EPISODE)
    with staged(kept.unionByName(notes.select(*kept.columns))) as merged:
        (
            merged.repartition(*_PLACE)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*_PLACE)
            .parquet(path)
        )


def append_audit(changes: DataFrame, path: str, at, user: str = "unknown") -> None:
    """Add change rows to the audit log as JSON lines."""
    told = changes.select(
        F.lit(at).alias("timestamp"),
        "operation",
        F.parse_json("details").alias("details"),
        F.lit(user).alias("user"),
    )
    told.write.mode("append").json(path)

