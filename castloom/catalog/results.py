"""Queries over extraction results and what is written from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from castloom.catalog import bindings as b
from castloom.catalog.bindings import oracle, table
from castloom.catalog.functions import _SP, _key, _strip
from castloom.functions import documents as d
from castloom.operators import costs
from castloom.operators import results as rs
from castloom.operators.rows import validate


def _hash(column):
    return F.sha2(column, 256)


def _results(spark, folder):
    """Results priced by their tokens; usage of a local runtime has no known price."""
    return costs.with_cost(b.results(spark, folder), costs.prices(spark)).withColumn(
        "cost_known", F.col("provider") != "codex"
    )


def valid_results(spark, folder):
    return rs.valid_results(b.results(spark, folder)).select("episode_id", "confidence")


def run_summary(spark, folder):
    summary = rs.run_summary(b.results(spark, folder), "podcast")
    return summary.select(
        "podcast", "total", "successful", "failed", "cached",
        F.round("success_rate", 6).alias("success_rate"),
        F.array_join("failed_templates", ",").alias("failed_templates"),
    )


def run_label(spark, folder):
    summary = rs.run_label(rs.run_summary(b.results(spark, folder), "podcast"))
    return summary.select("podcast", "label")


def result_label(spark, folder):
    label = d.result_label(
        F.col("success"), F.col("template_name"), F.col("from_cache"),
        F.bround(F.col("input_tokens") / 1024, 1), F.bround(F.col("output_tokens") / 1024, 3),
        F.col("provider") != "codex", F.lit("boom"),
    )
    return b.results(spark, folder).select("episode_id", label.alias("label"))


def batch_report(spark, folder):
    results = _results(spark, folder)
    runs = b.transcripts(spark, folder).select(
        "episode_id",
        F.when(F.col("episode_id") % 3 == 0, 0.0).otherwise(0.01).alias("cost_usd"),
        (F.col("episode_id") % 3 == 0).alias("from_cache"),
    )
    report = rs.batch_report(results, runs)
    return report.withColumn("total_cost_usd", F.round("total_cost_usd", 6))


def run_report(spark, folder):
    results = _results(spark, folder)
    files = results.where("success").select(
        "episode_id",
        F.concat("template_name", F.lit(".md")).alias("filename"),
        F.col("template_name").alias("template"),
        F.col("output_tokens").alias("size_bytes"),
    )
    report = F.col("report")
    return rs.run_report(results, files).select(
        "episode_id",
        "podcast",
        F.get_json_object(report, "$.extraction.successful").cast("bigint").alias("successful"),
        F.coalesce(F.get_json_object(report, "$.files[0].filename"), F.lit("")).alias("file"),
        F.get_json_object(report, "$.templates[0].name").alias("template"),
        (F.get_json_object(report, "$.costs.total_known") == "true").alias("total_known"),
    )


def benchmark_agg(spark, folder):
    runs = b.results(spark, folder).select(
        "success",
        (F.col("input_tokens") / 4).alias("duration_seconds"),
        (F.col("output_tokens") / 8).alias("cost_usd"),
        (F.col("episode_id") % 17).alias("entities"),
        (F.col("episode_id") % 5).alias("tags"),
        F.col("n_warnings").alias("links"),
    )
    row = rs.benchmark_agg(runs)
    return row.select(*[F.round(c, 6).alias(c) if c[3:4] == "_" or c[5:6] == "_" else F.col(c) for c in row.columns])


def _notes(spark, folder):
    """Each document as a note: front matter, headings from its lines, its text."""
    rows = table(spark, folder, "documents")
    head = F.concat(F.lit("---\ntemplate: '"), "source", F.lit("'\ntemplate_version: "), "lang", F.lit("\n---\n\n"))
    body = F.concat(F.lit("# "), F.regexp_replace("text", "\n", " #\n## "))
    return rows.select(
        "doc_id", F.when(F.col("doc_id") % 3 != 0, F.concat(head, body)).otherwise(body).alias("content")
    )


def split_front_matter(spark, folder):
    text = F.col("content")
    front = d.front_matter_of(text)
    return _notes(spark, folder).select(
        "doc_id",
        d.front_matter_value(front, "template").alias("template"),
        d.front_matter_value(front, "template_version").alias("version"),
        _hash(d.body_of(text)).alias("body_hash"),
    )


def headings(spark, folder):
    rows = rs.headings(_notes(spark, folder), d.body_of(F.col("content")), "doc_id")
    return rows.select("doc_id", "no", "id", _hash("text").alias("text_hash"), "level")


def front_matter(spark, folder):
    rows = _results(spark, folder).select(
        "episode_id",
        "template_name",
        F.lit("2.0").alias("template_version"),
        "podcast",
        F.concat(F.lit("Talk: "), "episode_id").alias("episode"),
        "provider",
        F.col("output_tokens").cast("double").alias("cost_usd"),
        "cost_known",
        F.when(F.col("cost_known"), "known").otherwise("runtime_managed").alias("billing_mode"),
        F.lit(None).cast("string").alias("model"),
        (F.col("episode_id") % 7 == 0).alias("bypassed"),
        F.lit("source_tokens=3 <= threshold=500").alias("bypass_reason"),
        F.when(F.col("episode_id") % 2 == 0, F.lit("https://example.com/a")).alias("url"),
        F.lit("").alias("source_kind"),
    )
    return rows.select(
        "episode_id", d.front_matter(F.lit("2024-03-05").cast("date")).alias("front_matter")
    )


def _rendered_inputs(spark, folder):
    """Documents as answers of each kind."""
    rows = table(spark, folder, "documents")
    said = F.regexp_replace("text", r'[\\"\s]+', " ")
    kind = F.col("doc_id") % 6
    name = (
        F.when(kind == 0, "quotes").when(kind == 1, "key-concepts").when(kind == 2, "tools-mentioned")
        .when(kind == 3, "books-mentioned").when(kind == 4, "summary").otherwise("quotes")
    )
    body = (
        F.when(kind == 0, F.concat(F.lit('{"quotes":[{"text":"'), said, F.lit('","timestamp":"01:02"},{"speaker":"'), "source", F.lit('"}]}')))
        .when(kind == 1, F.concat(F.lit('{"concepts":[{"name":"'), "source", F.lit('","explanation":"'), said, F.lit('"},{"context":"c"}]}')))
        .when(kind == 2, F.concat(F.lit('{"tools":[{"name":"'), "source", F.lit('","context":"'), said, F.lit('"}]}')))
        .when(kind == 3, F.concat(F.lit('{"books":[{"title":"'), "source", F.lit('","author":"A","context":"'), said, F.lit('"}]}')))
        .when(kind == 5, F.lit('{"other":1}'))
    )
    return rows.select(
        "doc_id", name.alias("template_name"),
        F.when(kind == 4, F.col("text")).alias("content_text"), body.alias("content_json"),
    )


def render(spark, folder):
    text = d.render(F.col("template_name"), F.col("content_text"), F.col("content_json"))
    return _rendered_inputs(spark, folder).select("doc_id", _hash(text).alias("markdown_hash"))


def _nested(spark, folder):
    """Event properties wrapped in objects to differing depths, some cut short."""
    rows = table(spark, folder, "events")
    depth = (F.col("event_id") % 13).cast("int")
    whole = F.concat(
        F.repeat(F.lit('{"a[":'), depth), "props", F.repeat(F.lit("}"), depth)
    )
    text = F.when(F.col("event_id") % 7 == 6, F.substring(whole, 1, 5)).otherwise(whole)
    return rows.select("event_id", text.alias("text"))


def safe_json(spark, folder):
    return _nested(spark, folder).select(
        "event_id", F.coalesce(d.json_problem(F.col("text")), F.lit("ok")).alias("verdict")
    )


def json_in_text(spark, folder):
    text = F.concat(F.lit("Here { it is: "), "text", F.lit(" done }."))
    found = d.json_in_text(F.when(F.col("event_id") % 5 == 0, F.lit("none")).otherwise(F.concat(F.lit("It: "), "text", F.lit(" ok."))))
    return _nested(spark, folder).select(
        "event_id", found.alias("found"), d.json_in_text(text).alias("outermost")
    )


def split_batch_response(spark, folder):
    rows = table(spark, folder, "events").select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("event_id") % 10 == 9, F.lit("sorry"))
        .otherwise(
            F.concat(
                F.lit('Sure: {"summary": "s'), "event_id", F.lit('", "quotes": ['), "event_id",
                F.lit('], "tools": '), "props", F.lit(', "count": '), "event_id", F.lit("} bye"),
            )
        )
        .alias("response"),
        F.lit(1.0).alias("cost_usd"),
    )
    asked = rows.select(
        "request_id",
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("n"), F.lit(f).alias("f"))
            for n, f in (("summary", "markdown"), ("quotes", "json"), ("tools", "json"), ("count", "json"), ("books", "json"))
        ])).alias("t"),
    ).select("request_id", F.col("t.n").alias("template_name"), F.col("t.f").alias("expected_format"))
    return rs.split_batch_response(rows, asked).withColumn("cost_usd", F.round("cost_usd", 6))


def parse_output(spark, folder):
    kind = F.col("event_id") % 4
    rows = _nested(spark, folder).select(
        "event_id",
        F.when(kind == 0, "json").when(kind == 1, "yaml").when(kind == 2, "markdown").otherwise("text").alias("expected_format"),
        F.when(kind == 1, F.concat(F.lit("n: "), "event_id")).otherwise(F.col("text")).alias("raw_content"),
    )
    done = rs.parse_output(rows)
    return done.select("event_id", "success", "content_text", "content_json")


def context_block(spark, folder):
    rows = table(spark, folder, "documents")
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    block = d.context_block(
        F.col("source"), F.col("lang"), F.col("text"), words,
        F.when(F.col("doc_id") % 2 == 0, F.slice(words, 1, 2)),
    )
    return rows.select("doc_id", _hash(block).alias("context_hash"))


def _written(spark, folder):
    """Notes on disk: some documents miss their metadata or a file."""
    notes = _notes(spark, folder)
    files = notes.where(F.col("doc_id") % 5 != 0).select(
        F.col("doc_id").alias("episode_id"), F.lit("summary.md").alias("filename"), "content"
    )
    more = notes.where(F.col("doc_id") % 4 != 0).select(
        F.col("doc_id").alias("episode_id"), F.lit("quotes.md").alias("filename"),
        F.concat(F.lit("[[x]] "), "doc_id").alias("content"),
    )
    meta = notes.where(F.col("doc_id") % 6 != 0).select(
        F.col("doc_id").alias("episode_id"), F.lit(".metadata.yaml").alias("filename"), F.lit("a: 1").alias("content")
    )
    return files.unionByName(more).unionByName(meta)


def check_notes(spark, folder):
    expected = table(spark, folder, "documents").select(
        F.col("doc_id").alias("episode_id"),
        F.explode(F.array(F.lit("summary.md"), F.lit("quotes.md"))).alias("filename"),
    )
    return rs.check_notes(_written(spark, folder), expected)


def cost_saved(spark, folder):
    saved = rs.cost_saved(F.col("from_cache"), F.when(F.col("provider") != "codex", F.col("cost_usd")))
    return _results(spark, folder).select("episode_id", F.round(saved, 9).alias("saved_usd"))


def _attempts(spark, folder):
    items = b.transcripts(spark, folder).select(
        F.col("episode_id").alias("item_id"),
        (F.col("episode_id") % 3 == 0).alias("is_video"),
        (F.col("episode_id") % 7 == 0).alias("is_local"),
    )
    planned = rs.plan_attempts(items)
    return planned.withColumn("ok", (F.col("item_id") + F.col("rank") * 3) % 4 == 0)


def plan_attempts(spark, folder):
    return _attempts(spark, folder).select("item_id", "rank", "kind", "provider")


def first_success(spark, folder):
    done = rs.first_success(_attempts(spark, folder))
    return done.select("item_id", "provider", F.array_join("attempts", ",").alias("attempts"), "had_fallback")


_RULES = {
    "bad tokens": lambda: F.col("input_tokens") >= 200,
    "bad provider": lambda: F.col("provider").isin("claude", "gemini"),
    "error required": lambda: F.col("success") | (F.col("n_warnings") > 0),
    "confidence out of range": lambda: F.col("confidence").isNull() | F.col("confidence").between(0, 0.8),
}


def validate_rows(spark, folder):
    _, bad = validate(b.results(spark, folder), {n: rule() for n, rule in _RULES.items()})
    return bad.select("episode_id", F.array_join("reasons", ",").alias("reasons"))


QUERIES = {
    "valid_results": valid_results,
    "run_summary": run_summary,
    "run_label": run_label,
    "result_label": result_label,
    "batch_report": batch_report,
    "run_report": run_report,
    "benchmark_agg": benchmark_agg,
    "split_front_matter": split_front_matter,
    "headings": headings,
    "front_matter": front_matter,
    "render": render,
    "safe_json": safe_json,
    "json_in_text": json_in_text,
    "split_batch_response": split_batch_response,
    "parse_output": parse_output,
    "context_block": context_block,
    "check_notes": check_notes,
    "cost_saved": cost_saved,
    "plan_attempts": plan_attempts,
    "first_success": first_success,
    "validate": validate_rows,
}

_STATUS = """SELECT *, CASE WHEN success AND from_cache THEN 'cached' WHEN success THEN 'success'
       ELSE 'failed' END AS status FROM results"""
_SUMMARY = """SELECT podcast, count(*) AS total, count(*) FILTER (status = 'success') AS successful,
       count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'cached') AS cached,
       count(*) FILTER (status = 'success') * 100.0::DOUBLE / count(*) AS success_rate,
       coalesce(list_sort(list(DISTINCT template_name) FILTER (status = 'failed')), []) AS names
FROM statuses GROUP BY podcast"""
_PRICED_RESULTS = """SELECT *, provider <> 'codex' AS cost_known, CASE
         WHEN provider = 'codex' THEN 0.0
         WHEN provider = 'claude' THEN input_tokens / 1e6 * 3 + output_tokens / 1e6 * 15
         WHEN input_tokens >= 128000 THEN input_tokens / 1e6 * 0.15 + output_tokens / 1e6 * 0.3
         ELSE input_tokens / 1e6 * 0.075 + output_tokens / 1e6 * 0.3 END::DOUBLE AS cost_usd
FROM results"""
_NOTES = """SELECT doc_id, has_front, source, lang, body,
       CASE WHEN has_front THEN '---' || chr(10) || 'template: ''' || source || '''' || chr(10) ||
         'template_version: ' || lang || chr(10) || '---' || chr(10) || chr(10) || body
         ELSE body END AS content
FROM (SELECT doc_id, doc_id % 3 <> 0 AS has_front, source, lang,
             '# ' || replace(text, chr(10), ' #' || chr(10) || '## ') AS body FROM documents)"""
_LINE = _strip("line")
_HEAD_TEXT = _strip(f"regexp_replace(regexp_extract(l, '^(#{{1,3}}){_SP}+(.+)$', 2), '{_SP}+#+$', '')")
_UNMARKED = f"regexp_replace({_strip('lower(t)')}, '[`*_~\\[\\]()]', '', 'g')"
_NEST = """SELECT event_id, event_id % 13 AS depth, event_id % 7 = 6 AS cut,
       CASE WHEN event_id % 7 = 6 THEN left(whole, 5) ELSE whole END AS text
FROM (SELECT event_id, repeat('{"a[":', event_id % 13) || props || repeat('}', event_id % 13) AS whole
      FROM events)"""
_SAID = "regexp_replace(text, '[\\\\\"\\s\\x0b]+', ' ', 'g')"

ORACLES = {
    "valid_results": oracle(
        """SELECT episode_id, confidence FROM results
WHERE n_warnings = 0 AND (confidence IS NULL OR confidence >= 0.7)""",
        "results",
    ),
    "run_summary": oracle(
        """SELECT podcast, total, successful, failed, cached, round(success_rate, 6) AS success_rate,
       array_to_string(names, ',') AS failed_templates FROM summary""",
        "results",
        statuses=_STATUS,
        summary=_SUMMARY,
    ),
    "run_label": oracle(
        r"""SELECT podcast, E'\nExtraction Summary:\n  Total: ' || total || E'\n  Successful: ' ||
       successful || E'\n  Failed: ' || failed || E'\n  Cached: ' || cached ||
       format(E'\n  Success Rate: {:.1f}%', success_rate) || CASE WHEN failed > 0 THEN
         E'\n\nFailed Templates:' || array_to_string(list_transform(names,
           lambda n: E'\n  - ' || n), '') ELSE '' END AS label FROM summary""",
        "results",
        statuses=_STATUS,
        summary=_SUMMARY,
    ),
    "result_label": oracle(
        """SELECT episode_id, CASE WHEN success THEN '✓ ' || template_name || ': Success' ||
       CASE WHEN from_cache THEN ' (cached)' ELSE '' END ||
       format(' ({:.1f}s, ', input_tokens / 1024.0::DOUBLE) || CASE WHEN provider = 'codex'
         THEN 'unknown (runtime-managed)' ELSE format('${:.3f}', output_tokens / 1024.0::DOUBLE) END
       || ')' ELSE '✗ ' || template_name || ': Failed - boom' END AS label FROM results""",
        "results",
    ),
    "batch_report": oracle(
        """SELECT count(*) AS requested, count(*) FILTER (success) AS succeeded,
       count(*) FILTER (NOT success) AS failed,
       round(sum(cost_usd + CASE WHEN episode_id % 3 = 0 THEN 0.0 ELSE 0.01 END), 6)
         AS total_cost_usd,
       bool_and(cost_known) AS total_cost_known,
       count(*) FILTER (NOT cost_known) AS unknown_operations,
       count(*) FILTER (episode_id % 3 = 0) AS transcript_hits,
       count(*) FILTER (from_cache) AS extraction_hits FROM priced""",
        "results",
        priced=_PRICED_RESULTS,
    ),
    "run_report": oracle(
        """SELECT episode_id, podcast, (success AND NOT from_cache)::BIGINT AS successful,
       CASE WHEN success THEN template_name || '.md' ELSE '' END AS file, template_name AS template,
       provider <> 'codex' AS total_known FROM results""",
        "results",
    ),
    "benchmark_agg": oracle(
        """SELECT count(*) AS runs, count(*) FILTER (success) AS successes,
       count(*) FILTER (NOT success) AS failures,
       round(sum(t), 6) AS total_time, round(avg(t), 6) AS avg_time, min(t) AS min_time,
       max(t) AS max_time, round(sum(c), 6) AS total_cost, round(avg(c), 6) AS avg_cost,
       min(c) AS min_cost, max(c) AS max_cost,
       round(avg(episode_id % 17) FILTER (success), 6) AS avg_entities,
       round(avg(episode_id % 5) FILTER (success), 6) AS avg_tags,
       round(avg(n_warnings) FILTER (success), 6) AS avg_links
FROM (SELECT *, input_tokens / 4.0::DOUBLE AS t, output_tokens / 8.0::DOUBLE AS c FROM results)""",
        "results",
    ),
    "split_front_matter": oracle(
        """SELECT doc_id, CASE WHEN has_front THEN source END AS template,
       CASE WHEN has_front THEN lang END AS version, sha256(body) AS body_hash FROM notes""",
        notes=_NOTES,
    ),
    "headings": oracle(
        """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS no, id,
       sha256(t) AS text_hash, level FROM slugs WHERE id <> ''""",
        notes=_NOTES,
        lines=f"""SELECT doc_id, i, {_LINE} AS l FROM (SELECT doc_id, unnest(parts) AS line,
       unnest(range(len(parts))) AS i FROM (SELECT doc_id, string_split(body, chr(10)) AS parts FROM notes))""",
        heads=f"""SELECT doc_id, i, {_HEAD_TEXT} AS t, length(regexp_extract(l, '^(#{{1,3}}){_SP}+', 1))
       AS level FROM lines""",
        slugs=f"""SELECT *, trim(regexp_replace({_UNMARKED}, '[^a-z0-9]+', '-', 'g'), '-') AS id
FROM heads""",
    ),
    "front_matter": oracle(
        r"""SELECT episode_id, E'---\ntemplate: ' || template_name || E'\ntemplate_version: ''2.0''\npodcast: '
       || podcast || E'\nepisode: ''Talk: ' || episode_id || E'''\ndate: ''2024-03-05''\nextracted_with: '
       || provider || E'\ncost_usd: ' || output_tokens || E'.0\ncost_known: ' || (provider <> 'codex')
       || E'\nbilling:\n  mode: ' || CASE WHEN provider = 'codex' THEN E'runtime_managed\n  amount_usd: null'
          ELSE E'known\n  amount_usd: ' || output_tokens || '.0' END
       || CASE WHEN episode_id % 7 = 0
          THEN E'\nextraction_bypassed: true\nbypass_reason: source_tokens=3 <= threshold=500' ELSE '' END
       || CASE WHEN episode_id % 2 = 0 THEN E'\nurl: https://example.com/a' ELSE '' END
       || E'\ntags:\n- podcast\n- ' || CASE template_name WHEN 'key-concepts' THEN 'concepts'
          ELSE template_name END || E'\n---' AS front_matter FROM results""",
        "results",
    ),
    "render": oracle(
        r"""SELECT doc_id, sha256(CASE doc_id % 6
  WHEN 0 THEN E'# Quotes\n\n## Quote 1\n\n> ' || said || E'\n\n**Speaker:** Unknown\n**Timestamp:** 01:02\n\n## Quote 2\n\n> \n\n**Speaker:** ' || source || E'\n'
  WHEN 1 THEN E'# Key Concepts\n\n## ' || source || E'\n\n' || said || E'\n\n## Unknown\n\n**Context:** c\n'
  WHEN 2 THEN E'# Tools & Technologies Mentioned\n\n| Tool | Category | Context |\n|------|----------|---------|\n| ' || source || ' | N/A | ' || left(said, 50) || ' |'
  WHEN 3 THEN E'# Books & Publications\n\n## ' || source || E'\n\n**Author:** A\n\n' ||
    CASE WHEN said = '' THEN '' ELSE '**Mentioned:** ' || said || E'\n' END
  WHEN 4 THEN text ELSE 'No quotes found.' END) AS markdown_hash FROM said""",
        said=f"SELECT doc_id, source, text, {_SAID} AS said FROM documents",
    ),
    "safe_json": oracle(
        """SELECT event_id, CASE WHEN cut THEN 'invalid' WHEN depth + 1 > 10 THEN 'too deep'
       ELSE 'ok' END AS verdict FROM nested""",
        nested=_NEST,
    ),
    "json_in_text": oracle(
        """SELECT event_id, CASE WHEN event_id % 5 = 0 OR cut THEN NULL ELSE text END AS found,
       '{ it is: ' || text || ' done }' AS outermost FROM nested""",
        nested=_NEST,
    ),
    "split_batch_response": oracle(
        """SELECT event_id AS request_id, t AS template_name, event_id % 10 <> 9 AND t <> 'books'
       AS success,
       CASE WHEN event_id % 10 = 9 THEN 'Invalid batch response format: no JSON object'
            WHEN t = 'books' THEN 'Missing ''books'' in batch response' END AS error,
       CASE WHEN event_id % 10 <> 9 AND t = 'summary' THEN 's' || event_id END AS content_text,
       CASE WHEN event_id % 10 = 9 THEN NULL WHEN t = 'quotes' THEN '{"quotes":[' || event_id || ']}'
            WHEN t = 'tools' THEN replace(props, ' ', '')
            WHEN t = 'count' THEN '{"data":' || event_id || '}' END AS content_json,
       CASE WHEN event_id % 10 = 9 OR t = 'books' THEN 0.0 ELSE 0.2 END::DOUBLE AS cost_usd
FROM events, (VALUES ('summary'), ('quotes'), ('tools'), ('count'), ('books')) AS x(t)"""
    ),
    "parse_output": oracle(
        """SELECT event_id, event_id % 4 <> 0 OR NOT (cut OR depth > 9) AS success,
       CASE WHEN event_id % 4 >= 2 THEN text END AS content_text,
       CASE WHEN event_id % 4 = 0 AND NOT (cut OR depth > 9) THEN text
            WHEN event_id % 4 = 1 THEN '{"n": ' || event_id || '}' END AS content_json FROM nested""",
        nested=_NEST,
    ),
    "context_block": oracle(
        f"""SELECT doc_id, sha256('Podcast: ' || source || E'\\nEpisode: ' || lang || E'\\n\\nSummary:\\n'
       || text || CASE WHEN len(words) > 0 THEN E'\\n\\nKey Quotes:\\n' || array_to_string(
         list_transform(words[1:5], lambda w: '- ' || w), chr(10)) ELSE '' END
       || CASE WHEN len(words) > 0 AND doc_id % 2 = 0 THEN E'\\n\\nKey Concepts:\\n' || array_to_string(
         list_transform(words[1:2], lambda w: '- ' || w), chr(10)) ELSE '' END) AS context_hash
FROM (SELECT *, list_filter(regexp_split_to_array(text, '{_SP}+'), lambda w: w <> '') AS words
      FROM documents)"""
    ),
    "check_notes": oracle(
        """SELECT doc_id AS episode_id, (NOT s)::BIGINT + (NOT q)::BIGINT AS missing_files,
       (s AND strlen(content) < 100)::BIGINT + q::BIGINT AS small_files,
       (s AND NOT has_front)::BIGINT + q::BIGINT AS no_front_matter,
       q OR (s AND contains(content, '[[') AND contains(content, ']]')) AS has_links, s AS has_tags,
       NOT m AS missing_metadata, s AND q AND m AS passed
FROM (SELECT *, doc_id % 5 <> 0 AS s, doc_id % 4 <> 0 AS q, doc_id % 6 <> 0 AS m FROM notes)""",
        notes=_NOTES,
    ),
    "cost_saved": oracle(
        """SELECT episode_id, CASE WHEN from_cache AND cost_known THEN round(cost_usd, 9) ELSE 0.0 END
       AS saved_usd FROM priced""",
        "results",
        priced=_PRICED_RESULTS,
    ),
    "plan_attempts": oracle(
        (_ways := """SELECT doc_id AS item_id, rank, kind, provider FROM documents, (VALUES
  (0, 'gemini_local_media', 'gemini'), (1, 'cache', 'cache'), (2, 'youtube_transcript', 'youtube'),
  (3, 'gemini_youtube_url', 'gemini'), (4, 'gemini_audio', 'gemini')) AS w(rank, kind, provider)
WHERE CASE rank WHEN 0 THEN doc_id % 7 = 0 WHEN 3 THEN doc_id % 7 <> 0 AND doc_id % 3 = 0
      ELSE doc_id % 7 <> 0 END""")
    ),
    "first_success": oracle(
        """SELECT a.item_id, any_value(g.provider) AS provider,
       string_agg(a.provider, ',' ORDER BY a.rank) AS attempts, count(*) > 1 AS had_fallback
FROM ways a LEFT JOIN (SELECT item_id, min(rank) AS rank, arg_min(provider, rank) AS provider
  FROM ways WHERE (item_id + rank * 3) % 4 = 0 GROUP BY item_id) g ON g.item_id = a.item_id
WHERE g.rank IS NULL OR a.rank <= g.rank GROUP BY a.item_id""",
        ways=_ways,
    ),
    "validate": oracle(
        """SELECT * FROM (SELECT episode_id, concat_ws(',',
       CASE WHEN input_tokens < 200 THEN 'bad tokens' END,
       CASE WHEN provider NOT IN ('claude', 'gemini') THEN 'bad provider' END,
       CASE WHEN NOT success AND n_warnings = 0 THEN 'error required' END,
       CASE WHEN confidence > 0.8 THEN 'confidence out of range' END) AS reasons FROM results)
WHERE reasons <> ''""",
        "results",
    ),
}
