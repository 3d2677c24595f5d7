"""Extraction results: parsing, summaries, reports, checks of written notes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from castloom.functions.documents import heading_level, heading_text, is_heading, json_in_text, json_problem
from castloom.functions.text import heading_slug

MIN_CONFIDENCE = 0.7
MIN_NOTE_BYTES = 100


def valid_results(results: DataFrame) -> DataFrame:
    """No warnings, and a confidence of at least 0.7 where there is one."""
    sure = F.col("confidence").isNull() | (F.col("confidence") >= MIN_CONFIDENCE)
    return results.where((F.col("n_warnings") == 0) & sure)


def result_status() -> Column:
    return (
        F.when(F.col("success") & F.col("from_cache"), "cached")
        .when(F.col("success"), "success")
        .otherwise("failed")
    )


def run_summary(results: DataFrame, *by: str) -> DataFrame:
    """Counts per run, success rate, and the templates that failed.

    Cached results are not in ``successful``, so the rate leaves them out; it is 0 for an
    empty run. A run names a template once, so the failed names are a set.
    """
    status = result_status()
    named = results.withColumn("_status", status)
    n = F.count(F.lit(1))
    good = F.count_if(F.col("_status") == "success")
    failed = F.collect_set(F.when(F.col("_status") == "failed", F.col("template_name")))
    grouped = named.groupBy(*by) if by else named.groupBy()
    return grouped.agg(
        n.alias("total"),
        good.alias("successful"),
        F.count_if(F.col("_status") == "failed").alias("failed"),
        F.count_if(F.col("_status") == "cached").alias("cached"),
        F.coalesce(F.try_divide(good * 100.0, n), F.lit(0.0)).alias("success_rate"),
        F.array_sort(failed).alias("failed_templates"),
    )


def run_label(summary: DataFrame) -> DataFrame:
    """Text of a run summary, with a line per failed template when there are any."""
    text = F.format_string(
        "\nExtraction Summary:\n  Total: %d\n  Successful: %d\n  Failed: %d\n  Cached: %d\n"
        "  Success Rate: %.1f%%",
        "total", "successful", "failed", "cached", F.bround("success_rate", 1),
    )
    lines = F.array_join(
        F.transform("failed_templates", lambda t: F.concat(F.lit("\n  - "), t)), ""
    )
    failed = F.when(F.col("failed") > 0, F.concat(F.lit("\n\nFailed Templates:"), lines)).otherwise("")
    return summary.withColumn("label", F.concat(text, failed))


def episode_report(results: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """Per episode: costs, whether they are all known, cache hits, whether any result is good."""
    per = results.groupBy("episode_id").agg(
        F.bool_or("success").alias("succeeded"),
        F.sum("cost_usd").alias("extraction_usd"),
        F.bool_and("cost_known").alias("total_known"),
        F.count_if(~F.col("cost_known")).alias("unknown_operations"),
        F.count_if(F.col("from_cache")).alias("extraction_hits"),
    )
    if transcripts is None:
        return per.withColumns(
            {"transcription_usd": F.lit(0.0), "transcript_hit": F.lit(False)}
        )
    told = transcripts.select(
        "episode_id",
        F.col("cost_usd").alias("transcription_usd"),
        F.col("from_cache").alias("transcript_hit"),
    )
    return per.join(told, "episode_id", "left").fillna(
        {"transcription_usd": 0.0, "transcript_hit": False}
    )


def batch_report(results: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """One row over all episodes of a run."""
    per = episode_report(results, transcripts)
    n = F.count(F.lit(1))
    return per.agg(
        n.alias("requested"),
        F.count_if(F.col("succeeded")).alias("succeeded"),
        F.count_if(~F.coalesce("succeeded", F.lit(False))).alias("failed"),
        F.coalesce(F.sum(F.col("extraction_usd") + F.col("transcription_usd")), F.lit(0.0)).alias("total_cost_usd"),
        F.coalesce(F.bool_and("total_known"), F.lit(True)).alias("total_cost_known"),
        F.coalesce(F.sum("unknown_operations"), F.lit(0)).cast("bigint").alias("unknown_operations"),
        F.count_if(F.col("transcript_hit")).alias("transcript_hits"),
        F.coalesce(F.sum("extraction_hits"), F.lit(0)).cast("bigint").alias("extraction_hits"),
    )


def run_report(results: DataFrame, files: DataFrame, runs: Sequence[str] = ("podcast",)) -> DataFrame:
    """Per episode one JSON document with its files, templates, counts and costs.

    One document per episode, never one for a whole run: totals over episodes come from
    ``batch_report``, so no document grows with the table.
    """
    status = result_status()
    template = F.struct(
        F.col("template_name").alias("name"), "success", "provider", "from_cache", "cost_usd", "cost_known"
    )
    per = results.withColumn("_status", status).groupBy("episode_id", *runs).agg(
        F.array_sort(F.collect_list(template)).alias("templates"),
        F.struct(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("_status") == "success").alias("successful"),
            F.count_if(F.col("_status") == "failed").alias("failed"),
            F.count_if(F.col("_status") == "cached").alias("cached"),
        ).alias("extraction"),
        F.round(F.sum("cost_usd"), 6).alias("total_usd"),
        F.bool_and("cost_known").alias("total_known"),
    )
    written = files.groupBy("episode_id").agg(
        F.array_sort(F.collect_list(F.struct("filename", "template", "size_bytes"))).alias("files")
    )
    body = F.struct(
        F.lit("success").alias("status"), "files", "templates", "extraction",
        F.struct("total_usd", "total_known").alias("costs"),
    )
    return per.join(written, "episode_id", "left").select(
        "episode_id", *runs, F.to_json(body).alias("report")
    )


def split_batch_response(
    responses: DataFrame, requested: DataFrame
) -> DataFrame:
    """A row per requested template from one JSON answer keyed by template name.

    ``responses`` has (request_id, response, cost_usd), ``requested`` (request_id,
    template_name, expected_format). A missing key is a failed result at no cost; the cost
    is shared equally by all requested templates. An answer that is no JSON fails them all.
    """
    found = json_in_text(F.col("response"))
    problem = F.when(found.isNull(), "no JSON object").otherwise(json_problem(found))
    read = responses.select(
        "request_id",
        "cost_usd",
        problem.alias("_problem"),
        F.from_json(F.when(problem.isNull(), found), "map<string,variant>").alias("_answers"),
    )
    counts = requested.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = requested.join(read, "request_id").join(counts, "request_id")
    name = F.col("template_name")
    value = F.try_element_at("_answers", name)
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    good = F.col("_problem").isNull() & (kind != "VOID")
    is_text, is_json = kind == "STRING", F.col("expected_format") == "json"
    plain, text = F.to_json(value), F.try_variant_get(value, "$", "string")

    def wrapped(key: Column) -> Column:
        return F.concat(F.lit("{"), F.to_json(F.array(key)).substr(F.lit(2), F.length(F.to_json(F.array(key))) - 2),
                        F.lit(":"), plain, F.lit("}"))

    as_json = (
        F.when(kind.startswith("OBJECT"), plain)
        .when(kind.startswith("ARRAY"), wrapped(name))
        .otherwise(wrapped(F.lit("data")))
    )
    broken = F.concat(F.lit("Invalid batch response format: "), "_problem")
    missing = F.concat(F.lit("Missing '"), name, F.lit("' in batch response"))
    return rows.select(
        "request_id",
        "template_name",
        good.alias("success"),
        F.when(F.col("_problem").isNotNull(), broken).when(~good, missing).alias("error"),
        F.when(good & is_text, text).when(good & ~is_json, plain).alias("content_text"),
        F.when(good & is_json & ~is_text, as_json).alias("content_json"),
        F.when(good, F.col("cost_usd") / F.col("_n")).otherwise(0.0).alias("cost_usd"),
    )


_YAML = StructType([StructField("json", StringType()), StructField("error", StringType())])


@F.pandas_udf(_YAML)
def _yaml_as_json(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    import json

    import yaml

    def read(text):
        if text is None:
            return None, None
        try:
            return json.dumps(yaml.safe_load(text), default=str), None
        except yaml.YAMLError as error:
            return None, f"Invalid YAML output: {str(error).splitlines()[0]}"

    for batch in texts:
        yield pd.DataFrame([read(t) for t in batch], columns=["json", "error"], dtype="object")


def parse_output(results: DataFrame) -> DataFrame:
    """Set content by the template's format: JSON checked, YAML read, other text as it is.

    Reads ``raw_content`` and ``expected_format``; a text that cannot be read makes its
    result a failed one.
    """
    raw, form = F.col("raw_content"), F.col("expected_format")
    is_json, is_yaml = form == "json", form == "yaml"
    problem = F.when(is_json, json_problem(raw))
    told = results.withColumn("_yaml", _yaml_as_json(F.when(is_yaml, raw))).withColumn("_problem", problem)
    error = F.coalesce(
        F.col("error") if "error" in results.columns else F.lit(None).cast("string"),
        F.concat(F.lit("Invalid JSON output: "), "_problem"),
        F.col("_yaml.error"),
    )
    good = error.isNull()
    return told.select(
        *[c for c in results.columns if c not in ("success", "error")],
        good.alias("success"),
        error.alias("error"),
        F.when(good & ~is_json & ~is_yaml, raw).alias("content_text"),
        F.when(good & is_json, raw).when(good & is_yaml, F.col("_yaml.json")).alias("content_json"),
    ).drop("_yaml", "_problem")


def benchmark_agg(runs: DataFrame) -> DataFrame:
    """Counts, times and costs over all runs, quality means over the successful; 0 if none."""
    zero = F.lit(0.0)
    n, good = F.count(F.lit(1)), F.count_if(F.col("success"))
    told = [n.alias("runs"), good.alias("successes"), (n - good).alias("failures")]
    for column, name in (("duration_seconds", "time"), ("cost_usd", "cost")):
        for kind, fn in (("total", F.sum), ("avg", F.avg), ("min", F.min), ("max", F.max)):
            told.append(F.coalesce(fn(column), zero).alias(f"{kind}_{name}"))
    for column in ("entities", "tags", "links"):
        mean = F.avg(F.when(F.col("success"), F.col(column)))
        told.append(F.coalesce(mean, zero).alias(f"avg_{column}"))
    return runs.agg(*told)


def headings(notes: DataFrame, markdown: Column, *keep: str) -> DataFrame:
    """Headings of level 1 to 3 of each row: keep columns, no (from 0), id, text, level.

    Only the lines that are headings become rows, numbered within their row: nothing is
    shuffled.
    """
    lines = notes.select(*keep, F.filter(F.split(markdown, "\n"), is_heading).alias("_lines"))
    told = lines.withColumn(
        "_told",
        F.transform("_lines", lambda line: F.struct(heading_text(line).alias("text"), heading_level(line).alias("level"))),
    )
    named = told.withColumn(
        "_told",
        F.transform(
            "_told", lambda h: F.struct(heading_slug(h["text"]).alias("id"), h["text"].alias("text"), h["level"].alias("level"))
        ),
    ).withColumn("_told", F.filter("_told", lambda h: h["id"] != ""))
    # The outer form: the inner one would first compute the array to see whether it has any.
    rows = named.select(*keep, F.posexplode_outer("_told").alias("no", "_h")).where("_h is not null")
    return rows.select(*keep, F.col("no").cast("bigint").alias("no"), "_h.id", "_h.text", "_h.level")


def check_notes(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Errors and warnings per episode on what was written.

    ``files`` has (episode_id, filename, content), ``expected`` (episode_id, filename).
    Missing metadata or files are errors; small files, files without front matter, and
    episodes without any link or tag are warnings.
    """
    found = files.withColumn("_found", F.lit(True))
    joined = expected.join(found, ["episode_id", "filename"], "left")
    there = F.col("_found").isNotNull()
    has = F.coalesce("content", F.lit(""))
    meta = files.where("filename = '.metadata.yaml'").select("episode_id", F.lit(True).alias("_meta"))
    per = joined.groupBy("episode_id").agg(
        F.count_if(~there).alias("missing_files"),
        F.count_if(there & (F.octet_length(has) < MIN_NOTE_BYTES)).alias("small_files"),
        F.count_if(there & ~has.startswith("---")).alias("no_front_matter"),
        F.bool_or(F.contains(has, F.lit("[[")) & F.contains(has, F.lit("]]"))).alias("has_links"),
        F.bool_or(F.contains(has, F.lit("#"))).alias("has_tags"),
    )
    judged = per.join(meta, "episode_id", "left").withColumn(
        "missing_metadata", F.col("_meta").isNull()
    )
    return judged.drop("_meta").withColumn(
        "passed", (F.col("missing_files") == 0) & ~F.col("missing_metadata")
    )


def cost_saved(from_cache: Column, stored_cost: Column) -> Column:
    """What a cached run would have cost."""
    return F.when(from_cache, F.coalesce(stored_cost, F.lit(0.0))).otherwise(0.0)


def first_success(attempts: DataFrame) -> DataFrame:
    """Per item the lowest-ranked attempt that worked, and those tried up to it.

    Ranks are unique within an item and few (one per provider), so the list of names tried
    stays short however many items there are.
    """
    good = F.min(F.when(F.col("ok"), F.struct("rank", "provider")))
    winners = attempts.groupBy("item_id").agg(good.alias("_good"))
    tried = attempts.join(winners, "item_id").where(
        F.col("_good").isNull() | (F.col("rank") <= F.col("_good.rank"))
    )
    names = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "provider"))), lambda s: s["provider"]
    )
    return tried.groupBy("item_id").agg(
        F.max("_good.provider").alias("provider"),
        names.alias("attempts"),
        (F.count(F.lit(1)) > 1).alias("had_fallback"),
    )


def plan_attempts(
    items: DataFrame, *, use_cache: bool = True, skip_captions: bool = False
) -> DataFrame:
    """Ways to get each item's transcript, cheapest first.

    Reads the flags is_video and is_local; a local file can only be transcribed.
    """
    def way(rank: int, kind: str, provider: str, when: Column) -> Column:
        s = F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.lit(provider).alias("provider"))
        return F.when(when, s)

    remote = ~F.col("is_local")
    ways = F.array_compact(
        F.array(
            way(0, "gemini_local_media", "gemini", F.col("is_local")),
            way(1, "cache", "cache", remote & F.lit(use_cache)),
            way(2, "youtube_transcript", "youtube", remote & F.lit(not skip_captions)),
            way(3, "gemini_youtube_url", "gemini", remote & F.col("is_video")),
            way(4, "gemini_audio", "gemini", remote),
        )
    )
    return items.select("item_id", F.explode(ways).alias("w")).select("item_id", "w.*")
