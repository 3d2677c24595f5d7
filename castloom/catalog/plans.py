"""Queries that plan extraction over the document table."""

from __future__ import annotations

from datetime import datetime

import yaml
from pyspark.sql import functions as F

from castloom.catalog import bindings as b
from castloom.catalog.bindings import oracle
from castloom.plans import extraction as ex
from castloom.plans.prompts import prompt as fill_prompt
from castloom.sinks import buckets
from castloom.sources.templates import BUILTIN, read_templates

AS_OF = datetime(2024, 2, 20)
#: Words of the invented languages, since no document holds the usual ones.
TECH = ("the", "of", "and", "ing ")
INTERVIEW = (" la ", " de ", "que", "ou")
LIMITS = (("gemini", "gemini-3-pro-preview", 20_000), ("claude", "claude-sonnet-4-5", 12_000))


def _transcripts(spark, folder):
    return b.transcripts(spark, folder).select(
        "episode_id", "podcast", "text", (F.col("episode_id") % 2 == 0).alias("has_source")
    )


def _templates(spark):
    return read_templates(spark)


def _stored(spark, folder):
    number = F.col("episode_id")
    rows = b.transcripts(spark, folder).select("episode_id")
    kept = rows.where(number % 3 == 0).select(
        "episode_id",
        F.explode(
            F.array(
                F.struct(F.lit("summary").alias("t"), F.lit("2.0").alias("v")),
                F.struct(F.lit("quotes").alias("t"), F.lit("unknown").alias("v")),
                F.struct(F.lit("key-concepts").alias("t"), F.lit("1.0").alias("v")),
            )
        ).alias("s"),
    )
    return kept.select(
        "episode_id", F.col("s.t").alias("template_name"), F.col("s.v").alias("version")
    )


def _cache(spark, folder):
    """Every fourth document's quotes by one provider, stored an hour apart."""
    t = _templates(spark).where("name = 'quotes'")
    prompt_hash = F.sha2(
        F.to_json(F.struct("system_prompt", "user_prompt", "expected_format", "output_schema",
                           "max_tokens", "temperature", "examples")), 256)
    one = t.select(prompt_hash.alias("h"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = b.transcripts(spark, folder).where(F.col("episode_id") % 4 == 1).select(
        F.lit("quotes").alias("template_name"),
        F.lit("2.0").alias("template_version"),
        F.lit("claude").alias("provider"),
        F.lit("claude-sonnet-4-5").alias("model"),
        F.sha2("text", 256).alias("text_hash"),
        F.timestamp_add("HOUR", F.col("episode_id").cast("int"), start).alias("cached_at"),
    )
    keyed = rows.withColumn("_h", one.scalar())
    return keyed.select(
        ex.cache_key(F.col("text_hash"), prompt_hash=F.col("_h")).alias("cache_key"), "cached_at"
    ).groupBy("cache_key").agg(F.max("cached_at").alias("cached_at"))


def plan_extraction(spark, folder):
    plan = ex.plan_extraction(
        _transcripts(spark, folder), _templates(spark), ex.capabilities(spark, LIMITS),
        _stored(spark, folder), _cache(spark, folder), AS_OF, tech=TECH, interview=INTERVIEW,
    )
    return plan.withColumn("est_cost_usd", F.round("est_cost_usd", 9))


def plan_extraction_rows(spark, folder):
    return plan_extraction(spark, folder).drop("model", "podcast")


def plan_summary(spark, folder):
    summary = ex.plan_summary(plan_extraction(spark, folder))
    return summary.withColumn("est_cost_usd", F.round("est_cost_usd", 6))


def category(spark, folder):
    return b.transcripts(spark, folder).select(
        "episode_id", ex.category(F.col("text"), TECH, INTERVIEW).alias("category")
    )


def templates_for(spark, folder):
    """Documents whose category has a template of its own."""
    tools = ex.templates_for(_templates(spark), "tech").select("name")
    facts = ex.transcript_facts(_transcripts(spark, folder), TECH, INTERVIEW)
    found = tools.agg(F.array_join(F.array_sort(F.collect_list("name")), ","))
    return facts.where("category = 'tech'").select("episode_id").withColumn("names", found.scalar())


def plan_templates(spark, folder):
    facts = ex.transcript_facts(_transcripts(spark, folder), TECH, INTERVIEW)
    custom = F.when(
        F.col("episode_id") % 5 == 0, F.array(F.lit("step-by-step-plan"), F.lit("quotes"), F.lit("none"))
    )
    rows = ex.plan_templates(facts.withColumn("custom_templates", custom), _templates(spark))
    return rows.select("episode_id", "template_name", "template_version", "priority", "selection_rank")


def stale_templates(spark, folder):
    facts = ex.transcript_facts(_transcripts(spark, folder), TECH, INTERVIEW)
    work = ex.plan_templates(facts, _templates(spark))
    stale = ex.stale_templates(work, _stored(spark, folder))
    return stale.select("episode_id", "template_name")


def bypass(spark, folder):
    facts = ex.transcript_facts(_transcripts(spark, folder), TECH, INTERVIEW)
    work = ex.plan_templates(facts, _templates(spark))
    passed = ex.bypass(F.col("template_name"), F.col("tokens"), F.col("has_source"))
    return work.where(passed).select("episode_id", "tokens")


def route(spark, folder):
    facts = ex.transcript_facts(_transcripts(spark, folder), TECH, INTERVIEW)
    work = ex.plan_templates(facts, _templates(spark)).withColumn("prompt_tokens", F.col("tokens") + 8000)
    routes = ex.template_routes(_templates(spark), ex.capabilities(spark, LIMITS))
    return ex.route(work, routes).select("episode_id", "template_name", "route_rank", "provider")


def _looked_up(spark, folder):
    """Texts to look up, and a cache of every fourth of them."""
    rows = b.transcripts(spark, folder).select("episode_id", F.sha2("text", 256).alias("cache_key"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    cache = b.transcripts(spark, folder).where(F.col("episode_id") % 4 == 1).groupBy(
        F.sha2("text", 256).alias("cache_key")
    ).agg(F.max(F.timestamp_add("HOUR", F.col("episode_id").cast("int"), start)).alias("cached_at"))
    return rows, cache


def cache_lookup(spark, folder):
    rows, cache = _looked_up(spark, folder)
    return ex.cache_lookup(rows, cache, AS_OF).select("episode_id", "hit")


def _bucketed(spark, rows, name, key):
    path = b.scratch(spark, name)
    buckets.write_buckets(rows, path, key)
    return buckets.read_buckets(spark, path, key, schema=rows.schema)


def bucketed_cache_lookup(spark, folder):
    """The same with the cache in buckets of its key: only the texts' hashes move."""
    rows, cache = _looked_up(spark, folder)
    kept = _bucketed(spark, cache, "cache", "cache_key")
    return ex.cache_lookup(rows, kept, AS_OF).select("episode_id", "hit")


def bucketed_plan(spark, folder):
    """The whole plan with note versions and cache in buckets of their keys."""
    plan = ex.plan_extraction(
        _transcripts(spark, folder), _templates(spark), ex.capabilities(spark, LIMITS),
        _bucketed(spark, _stored(spark, folder), "notes", ["episode_id", "template_name"]),
        _bucketed(spark, _cache(spark, folder), "cache", "cache_key"),
        AS_OF, tech=TECH, interview=INTERVIEW,
    )
    return plan.withColumn("est_cost_usd", F.round("est_cost_usd", 9)).drop("model", "podcast")


def est_cost(spark, folder):
    rows = b.transcripts(spark, folder)
    tokens = F.length("text") * 20
    return rows.select(
        "episode_id",
        F.round(ex.est_cost(F.lit("gemini"), tokens, F.lit(8000)), 9).alias("gemini_usd"),
        F.round(ex.est_cost(F.lit("claude"), tokens, F.lit(8000)), 9).alias("claude_usd"),
    )


def prompt(spark, folder):
    user = "{% if metadata.podcast %}From {{ metadata.podcast }}. {% endif %}Read: {{ transcript }}{{ gone }}!\n"
    text = fill_prompt(
        F.lit(user),
        F.col("text"),
        {"podcast": F.when(F.col("episode_id") % 2 == 0, F.col("podcast"))},
        F.when(F.col("episode_id") % 3 == 0, F.lit("Examples: {{ transcript }}")),
    )
    return b.transcripts(spark, folder).select("episode_id", F.sha2(text, 256).alias("prompt_hash"))


QUERIES = {
    "category": category,
    "templates_for": templates_for,
    "plan_templates": plan_templates,
    "stale_templates": stale_templates,
    "bypass": bypass,
    "route": route,
    "cache_lookup": cache_lookup,
    "bucketed_cache_lookup": bucketed_cache_lookup,
    "bucketed_plan": bucketed_plan,
    "est_cost": est_cost,
    "prompt": prompt,
    "plan_extraction": plan_extraction_rows,
    "plan_summary": plan_summary,
}


def _score(words):
    return " + ".join(f"contains(lower(text), '{w}')::INT" for w in words)


def _builtin_rows():
    rows = []
    for file in sorted(BUILTIN.glob("*.yaml")):
        t = yaml.safe_load(file.read_text(encoding="utf-8"))
        system, user = t["system_prompt"].rstrip("\n"), t["user_prompt_template"]
        filled = user[:-1] if user.endswith("\n") else user
        chars = len(system) + 2 + len(filled) - len("{{ transcript }}")
        tokens = len(system) // 4 + len(user) // 4
        where = t.get("category") or ""
        rows.append(
            f"('{t['name']}', '{t['version']}', {t['priority']}, {t['max_tokens']}, {chars}, "
            f"{tokens}, '{where}')"
        )
    return "VALUES " + ", ".join(rows)


_COST = "CAST(tokens AS DOUBLE)"
_FACTS = f"""SELECT *, greatest(1, chars // 4) AS tokens, CASE WHEN t >= 3 AND t > i THEN 'tech'
       WHEN i >= 3 AND i > t THEN 'interview' END AS category
FROM (SELECT episode_id, podcast, text, length(text) AS chars, episode_id % 2 = 0 AS has_source,
             {_score(TECH)} AS t, {_score(INTERVIEW)} AS i FROM transcripts)"""
_TEMPLATES = (
    "SELECT * FROM (" + _builtin_rows()
    + ") AS x(name, version, priority, max_tokens, base_chars, base_tokens, own_category)"
)
_WORK = """SELECT f.*, p.name AS template_name, p.version AS template_version, p.priority,
       p.max_tokens, p.base_chars, p.base_tokens,
       CAST(CASE p.name WHEN 'summary' THEN 0 WHEN 'quotes' THEN 1 WHEN 'key-concepts' THEN 2
            ELSE 3 END AS INT) AS selection_rank
FROM facts f JOIN templates p ON p.own_category = '' OR p.own_category = f.category"""
_VERSIONS = """SELECT episode_id, t.template_name, t.version FROM transcripts, (VALUES
  ('summary', '2.0'), ('quotes', 'unknown'), ('key-concepts', '1.0')) AS t(template_name, version)
WHERE episode_id % 3 = 0"""
_CACHED = """SELECT sha256(text) AS text_hash, max(TIMESTAMP '2024-01-01' +
       episode_id * INTERVAL 1 HOUR) AS cached_at FROM transcripts WHERE episode_id % 4 = 1 GROUP BY 1
HAVING max(TIMESTAMP '2024-01-01' + episode_id * INTERVAL 1 HOUR) >= TIMESTAMP '2024-01-21'"""
_PLAN = """SELECT episode_id, podcast, template_name, template_version, priority, selection_rank,
       action, prompt_tokens,
       CASE action WHEN 'skip' THEN NULL WHEN 'bypass' THEN 'bypass' WHEN 'cached' THEN 'claude' ELSE first_provider END
         AS provider,
       CASE WHEN action <> 'run' THEN 0.0 WHEN first_provider = 'claude'
         THEN input_tokens / 1e6 * 3.0 + max_tokens / 1e6 * 15.0
         ELSE least(input_tokens, 200000) / 1e6 * 2.0 + greatest(0, input_tokens - 200000) / 1e6 * 4.0
              + max_tokens / 1e6 * 12.0 END::DOUBLE AS est_cost_usd
FROM (SELECT *, CASE WHEN fresh THEN 'skip'
        WHEN template_name = 'summary' AND has_source AND tokens <= 500 THEN 'bypass'
        WHEN template_name = 'quotes' AND claude_fits AND in_cache THEN 'cached'
        WHEN first_provider IS NOT NULL THEN 'run' ELSE 'no_provider' END AS action
  FROM (SELECT *, CASE WHEN template_name = 'quotes' AND claude_fits THEN 'claude'
          WHEN gemini_fits THEN 'gemini' WHEN claude_fits THEN 'claude' END AS first_provider
    FROM (SELECT *, prompt_tokens <= 12000 AS claude_fits, prompt_tokens <= 20000 AS gemini_fits
      FROM (SELECT w.*, greatest(1, (base_chars + chars) // 4) + max_tokens AS prompt_tokens,
                   base_tokens + chars // 4 AS input_tokens, c.text_hash IS NOT NULL AS in_cache,
                   coalesce(v.version <> 'unknown' AND v.version = w.template_version, false) AS fresh
            FROM work w
            LEFT JOIN versions v ON v.episode_id = w.episode_id AND v.template_name = w.template_name
            LEFT JOIN cached c ON c.text_hash = sha256(w.text)))))"""


def _sql(select, **extra):
    return oracle(select, "transcripts", facts=_FACTS, templates=_TEMPLATES, work=_WORK, **extra)


ORACLES = {
    "category": _sql("SELECT episode_id, category FROM facts"),
    "templates_for": _sql("""SELECT episode_id, 'tools-mentioned' AS names FROM facts
WHERE category = 'tech'"""),
    "plan_templates": _sql("""
SELECT episode_id, template_name, template_version, priority, selection_rank FROM work
UNION ALL SELECT f.episode_id, t.name, t.version, t.priority,
  CAST(CASE WHEN category IS NULL THEN 3 ELSE 4 END AS INT)
FROM facts f JOIN templates t ON t.name = 'step-by-step-plan' WHERE f.episode_id % 5 = 0"""),
    "stale_templates": _sql(
        """SELECT w.episode_id, w.template_name FROM work w LEFT JOIN versions v
  ON v.episode_id = w.episode_id AND v.template_name = w.template_name
WHERE v.version IS NULL OR v.version = 'unknown' OR v.version <> w.template_version""",
        versions=_VERSIONS,
    ),
    "bypass": _sql("""SELECT episode_id, tokens FROM work
WHERE template_name = 'summary' AND has_source AND tokens <= 500"""),
    "route": _sql("""
SELECT episode_id, template_name, CAST(route_rank AS INT) AS route_rank, provider FROM (
  SELECT *, CASE WHEN provider = 'claude' AND template_name = 'quotes' THEN 1
            WHEN provider = 'gemini' AND template_name <> 'quotes' THEN 1 ELSE 2 END AS route_rank
  FROM work, (VALUES ('claude', 12000), ('gemini', 20000)) AS p(provider, room)
  WHERE tokens + 8000 <= room)"""),
    "cache_lookup": _sql(
        """SELECT episode_id, c.text_hash IS NOT NULL AS hit FROM transcripts t
LEFT JOIN cached c ON c.text_hash = sha256(t.text)""",
        cached=_CACHED,
    ),
    "est_cost": _sql("""
SELECT episode_id, round(least(n, 200000) / 1e6 * 2 + greatest(0, n - 200000) / 1e6 * 4
       + 8000 / 1e6 * 12, 9)::DOUBLE AS gemini_usd,
       round(n / 1e6 * 3 + 8000 / 1e6 * 15, 9)::DOUBLE AS claude_usd
FROM (SELECT episode_id, length(text) * 20 AS n FROM transcripts)"""),
    "prompt": _sql("""
SELECT episode_id, sha256(
  CASE WHEN episode_id % 3 = 0 THEN 'Examples: {{ transcript }}' || chr(10) || chr(10) ELSE '' END ||
  CASE WHEN episode_id % 2 = 0 THEN 'From ' || podcast || '. ' ELSE '' END ||
  'Read: ' || text || '!') AS prompt_hash FROM transcripts"""),
    "plan_extraction": _sql(
        """SELECT episode_id, template_name, template_version, priority, selection_rank, action,
       provider, prompt_tokens, round(est_cost_usd, 9) AS est_cost_usd FROM plan""",
        versions=_VERSIONS,
        cached=_CACHED,
        plan=_PLAN,
    ),
    "plan_summary": _sql(
        """SELECT podcast, action, count(*) AS templates,
       CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
       round(sum(est_cost_usd), 6) AS est_cost_usd FROM plan GROUP BY podcast, action""",
        versions=_VERSIONS,
        cached=_CACHED,
        plan=_PLAN,
    ),
}
ORACLES |= {"bucketed_cache_lookup": ORACLES["cache_lookup"], "bucketed_plan": ORACLES["plan_extraction"]}
