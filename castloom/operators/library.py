"""Note library: embeds, search, sorting, note assembly, dashboards, timelines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castloom.functions.documents import body_of
from castloom.functions.text import megabytes, strip, title_case, truncate_words
from castloom.operators.ordered import neighbour, positions
from castloom.operators.rows import new_rows

#: Fixed values.
STAGES = {
    "transcription_start": "extracting_transcript",
    "template_selection_start": "generating_notes",
    "extraction_start": "generating_notes",
    "output_start": "saving_result",
}
STEPS = (
    "queued", "fetching_source", "extracting_transcript", "generating_notes",
    "saving_result", "done",
)
RECENT, SUMMARY_CHARACTERS = 5, 1600


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row with its source as a struct, null when it is gone."""
    source = F.struct(*[c for c in sources.columns if c != "source_id"])
    embedded = sources.select("source_id", source.alias("source"))
    return rows.join(embedded, "source_id", "left")


def job_note(jobs: DataFrame, notes: DataFrame) -> DataFrame:
    """Each job with the id of its note, if any."""
    return jobs.join(notes.select("job_id", "note_id"), "job_id", "left")


def search_notes(
    notes: DataFrame, needle: str = "", mode: str = "all", recent: int = RECENT
) -> DataFrame:
    """Notes with the needle in title, summary, source url or source title, in any case.

    ``summaries`` keeps notes with a summary; mode ``recent`` the ``recent`` newest.
    """
    if mode == "summaries":
        notes = notes.where(F.coalesce("summary", F.lit("")) != "")
    wanted = needle.strip().lower()
    if wanted:
        found = F.lit(False)
        for c in ("title", "summary", "source_url", "source_title"):
            if c in notes.columns:
                low = F.lower(F.coalesce(c, F.lit("")))
                found = found | F.contains(low, F.lit(wanted))
        notes = notes.where(found)
    return sort_notes(notes).limit(recent) if mode == "recent" else notes


def _note_order(key: str) -> Column:
    if key == "title":
        return F.collate("title", "UNICODE")
    return -F.unix_micros("updated_at" if key == "updated" else "created_at")


def sort_notes(notes: DataFrame, key: str = "newest") -> DataFrame:
    """Newest or last updated first, or by title in Unicode order."""
    return notes.orderBy(_note_order(key), "note_id")


def note_positions(notes: DataFrame, key: str = "newest") -> DataFrame:
    """The place of each note in that order, from 1 on, without sorting into one task."""
    keyed = notes.withColumn("_order", _note_order(key))
    return positions(keyed, [], ["_order", "note_id"]).drop("_order")


def open_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status") != "succeeded").orderBy(F.col("created_at").desc(), "job_id")


def filter_notes(
    notes: DataFrame,
    *,
    equals: Mapping[str, object] | None = None,
    over: Mapping[str, float] | None = None,
    has: Mapping[str, str] | None = None,
    present: Sequence[str] = (),
    absent: Sequence[str] = (),
    custom: Mapping[str, str] | None = None,
    last_days: tuple[str, int, date] | None = None,
) -> DataFrame:
    """Notes meeting every condition on their front matter.

    ``has`` means element of a list field but part of a text field; ``custom`` looks into
    the free fields; ``last_days`` is (field, days, today).
    """
    for column, value in (equals or {}).items():
        notes = notes.where(F.col(column) == value)
    for column, value in (over or {}).items():
        notes = notes.where(F.col(column) > value)
    types = dict(notes.dtypes)
    for column, value in (has or {}).items():
        if types[column].startswith("array"):
            notes = notes.where(F.array_contains(column, value))
        else:
            notes = notes.where(F.contains(F.col(column), F.lit(value)))
    for column in present:
        notes = notes.where(F.col(column).isNotNull())
    for column in absent:
        notes = notes.where(F.col(column).isNull())
    for path, value in (custom or {}).items():
        notes = notes.where(F.try_variant_get("custom_fields", f"$.{path}", "string") == value)
    if last_days:
        column, days, today = last_days
        notes = notes.where(F.col(column) >= F.date_sub(F.lit(today), days))
    return notes


def _visible(files: Column) -> Column:
    """Files not starting with an underscore, or all when there are no others."""
    shown = F.filter(files, lambda f: ~f["filename"].startswith("_"))
    return F.when(F.size(shown) > 0, shown).otherwise(files)


def assemble_notes(files: DataFrame, summary_characters: int = SUMMARY_CHARACTERS) -> DataFrame:
    """One note and summary per episode from its files, one per template.

    ``files`` has (episode_id, title, url, file_no, filename, template_name, content). An
    episode has as many files as templates, so a note is gathered from a few rows.
    """
    row = F.struct(
        "file_no", "filename", "template_name", strip(body_of(F.col("content"))).alias("body")
    )
    listed = files.groupBy("episode_id", "title", "url").agg(
        F.array_sort(F.collect_list(row)).alias("_all")
    )
    shown = listed.withColumn("_files", _visible(F.col("_all")))
    part = F.transform(
        F.filter("_files", lambda f: f["body"] != ""),
        lambda f: F.concat(F.lit("\n\n## "), title_case(f["filename"]), F.lit("\n\n"), f["body"]),
    )
    head = F.concat(F.lit("# "), "title", F.lit("\n\n[Source]("), "url", F.lit(")"))
    body = F.concat(strip(F.concat(head, F.array_join(part, ""))), F.lit("\n"))
    first = F.get(F.filter("_files", lambda f: f["template_name"] == "summary"), F.lit(0))["body"]
    summary = F.when(first != "", truncate_words(first, summary_characters))
    return shown.select("episode_id", "title", body.alias("body_markdown"), summary.alias("summary"))


def library_stats(files: DataFrame) -> DataFrame:
    """Episodes, files and megabytes."""
    return files.agg(
        F.count_distinct("episode_id").alias("total_episodes"),
        F.count(F.lit(1)).alias("total_files"),
        megabytes(F.coalesce(F.sum("size_bytes"), F.lit(0))).alias("total_size_mb"),
    )


def dashboard_counts(jobs: DataFrame, notes: DataFrame, n: int = RECENT) -> DataFrame:
    """Counts over the page of the ``n`` newest notes and jobs, not over the tables."""
    newest = [F.col("created_at").desc()]
    page = notes.orderBy(*newest, "note_id").limit(n).agg(F.count(F.lit(1)))
    return jobs.orderBy(*newest, "job_id").limit(n).agg(
        F.count_if(F.col("status").isin("queued", "running")).alias("active_jobs"),
        F.count_if(F.col("status") == "failed").alias("failed_jobs"),
    ).withColumn("notes", page.scalar())


def _minutes() -> Column:
    return F.coalesce("duration_minutes", F.lit(0))


def podcast_stats(notes: DataFrame) -> DataFrame:
    """Per podcast notes, mean rating of the rated (0 when none is), hours."""
    return notes.groupBy("podcast").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.coalesce(F.round(F.avg("rating"), 1), F.lit(0.0)).alias("avg_rating"),
        F.round(F.sum(_minutes()) / 60.0).cast("bigint").alias("total_hours"),
    ).orderBy(F.col("episodes").desc(), "podcast")


def topic_counts(notes: DataFrame, n: int = 15) -> DataFrame:
    """The most frequent topics and their share of the notes that have any."""
    tagged = notes.where(F.size(F.coalesce("topics", F.array().cast("array<string>"))) > 0)
    total = tagged.agg(F.count(F.lit(1)))
    top = (
        tagged.select(F.explode("topics").alias("topic"))
        .groupBy("topic")
        .agg(F.count(F.lit(1)).alias("episodes"))
        .orderBy(F.col("episodes").desc(), "topic")
        .limit(n)
    )
    share = F.round(F.col("episodes") * 100.0 / total.scalar()).cast("bigint")
    return top.withColumn("percent", share)


def guest_counts(notes: DataFrame, n: int = 10) -> DataFrame:
    return (
        notes.where("guest IS NOT NULL")
        .groupBy("guest")
        .agg(F.count(F.lit(1)).alias("appearances"))
        .orderBy(F.col("appearances").desc(), "guest")
        .limit(n)
    )


def listening_time(notes: DataFrame) -> DataFrame:
    timed = notes.where("duration_minutes IS NOT NULL")
    minutes = F.sum("duration_minutes")
    return timed.groupBy("podcast").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.round(minutes / 60.0).cast("bigint").alias("hours"),
        F.round(minutes / 1440.0, 1).alias("days"),
    )


def monthly_timeline(notes: DataFrame) -> DataFrame:
    month = F.date_format("created_date", "yyyy-MM")
    dated = notes.where("created_date IS NOT NULL")
    return dated.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("episodes")).orderBy("month")


def cost_word_stats(notes: DataFrame) -> DataFrame:
    """Cost over all notes, words over those that have a count."""
    n = F.count(F.lit(1))
    cost = F.coalesce(F.sum(F.coalesce("cost_usd", F.lit(0.0))), F.lit(0.0))
    return notes.agg(
        n.alias("episodes"),
        cost.alias("total_cost_usd"),
        F.try_divide(cost, n).alias("avg_cost_usd"),
        F.sum("word_count").alias("total_words"),
        F.round(F.avg("word_count")).cast("bigint").alias("avg_words"),
        F.max("word_count").alias("max_words"),
    )


def status_dashboard(notes: DataFrame) -> DataFrame:
    return notes.agg(
        F.count(F.lit(1)).alias("episodes"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("inbox", "reading", "completed")],
        F.round(F.sum(_minutes()) / 60.0).cast("bigint").alias("total_hours"),
    )


def note_table(notes: DataFrame, *order: tuple[str, bool], limit: int) -> DataFrame:
    """Top rows on several keys given as (column, descending); text keys sort as text."""
    keys = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]
    return notes.orderBy(*keys, "note_id").limit(limit)


def stage_changes(progress: DataFrame) -> DataFrame:
    """Stages of each job where they differ from the one before; other steps say nothing."""
    stage = F.lit(None).cast("string")
    for step, name in STAGES.items():
        stage = F.when(F.col("step") == step, name).otherwise(stage)
    known = progress.select("job_id", "ts", "seq", stage.alias("stage")).where("stage IS NOT NULL")
    near = neighbour(known, ["job_id"], ["ts", "seq"], "stage", "_before", following=False)
    return near.where(~F.col("stage").eqNullSafe(F.col("_before"))).drop("_before")


def step_states(jobs: DataFrame) -> DataFrame:
    """State of each timeline step of a job (columns status and stage)."""
    number = F.array_position(F.array(*[F.lit(s) for s in STEPS]), F.coalesce("stage", F.lit("queued")))
    at = (F.col("step_no") + 1).cast("bigint")
    here = F.coalesce(F.col("step") == F.col("stage"), F.lit(False))
    state = (
        F.when((F.col("status") == "failed") & here, "failed")
        .when(F.col("status") == "succeeded", "complete")
        .when(F.col("status") == "cancelled", F.when(here, "cancelled").otherwise("upcoming"))
        .when(at < F.col("_now"), "complete")
        .when(at == F.col("_now"), "current")
        .otherwise("upcoming")
    )
    rows = jobs.withColumn("_now", number)
    steps = rows.select("job_id", "status", "stage", "_now",
                        F.posexplode(F.array(*[F.lit(s) for s in STEPS])).alias("step_no", "step"))
    return steps.select("job_id", "step_no", "step", state.alias("state"))


def upsert_notes(notes: DataFrame, batch: DataFrame, key: str = "job_id") -> DataFrame:
    """One note per job: a job in the batch replaces its note."""
    return new_rows(notes, batch, key).unionByName(batch)


def merge_files(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Files after an incremental write: new ones replace, the rest stay.

    A transcript already there is kept, since transcripts are written only once.
    """
    keys = ["episode_id", "template_name"]
    transcript = F.col("template_name") == "_transcript"
    fresh = new_rows(new.where(transcript), existing, keys).unionByName(new.where(~transcript))
    return new_rows(existing, fresh, keys).unionByName(fresh)


def merge_meta(existing: DataFrame, results: DataFrame) -> DataFrame:
    """Metadata after an incremental write: templates united, versions overwritten, cost added.

    Map merging needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN``. Results of an episode are
    one row per template, so its arrays stay short.
    """
    entries = F.array_sort(
        F.collect_list(F.struct("result_no", "template_name", "template_version"))
    )
    new = results.groupBy("episode_id").agg(
        entries.alias("_new"), F.sum("cost_usd").alias("_cost")
    )
    names = F.transform("_new", lambda s: s["template_name"])
    versions = F.map_from_entries(
        F.transform("_new", lambda s: F.struct(s["template_name"], s["template_version"]))
    )
    joined = existing.join(new, "episode_id", "left")
    has = F.col("_new").isNotNull()
    cost = F.col("extraction_cost_usd") + F.coalesce("_cost", F.lit(0.0))
    return joined.withColumns(
        {
            "templates_applied": F.when(has, F.array_union("templates_applied", names)).otherwise(
                F.col("templates_applied")
            ),
            "templates_versions": F.when(
                has, F.map_concat("templates_versions", versions)
            ).otherwise(F.col("templates_versions")),
            "extraction_cost_usd": cost,
            "total_cost_usd": F.when(has, F.col("transcription_cost_usd") + cost).otherwise(
                F.col("total_cost_usd")
            ),
        }
    ).drop("_new", "_cost")
