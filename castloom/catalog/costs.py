"""Queries over the usage ledger."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from castloom.catalog import bindings as b
from castloom.catalog.bindings import oracle, scratch
from castloom.operators import costs
from castloom.operators.rows import union_rows
from castloom.sinks import versions

_PRICED = """
SELECT u.*, CASE
         WHEN provider = 'gemini' AND input_tokens >= 128000
           THEN input_tokens / 1e6 * 0.15 + output_tokens / 1e6 * 0.30
         WHEN provider = 'gemini' THEN input_tokens / 1e6 * 0.075 + output_tokens / 1e6 * 0.30
         WHEN provider = 'claude' THEN input_tokens / 1e6 * 3.00 + output_tokens / 1e6 * 15.00
         ELSE 0.0 END::DOUBLE AS cost_usd
FROM usage u"""


def _ledger(spark, folder):
    return costs.with_cost(b.usage(spark, folder), costs.prices(spark))


def _sql(select, **extra):
    return oracle(select, "usage", ledger=_PRICED, **extra)


def _rounded(df, *names, places=9):
    return df.withColumns({n: F.round(n, places) for n in names})


def _when(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def price(spark, folder):
    priced, _ = costs.price(b.usage(spark, folder), costs.prices(spark))
    return _rounded(priced.select("usage_id", "provider", "input_tokens", "cost_usd"), "cost_usd")


def price_rejects(spark, folder):
    _, rejected = costs.price(b.usage(spark, folder), costs.prices(spark))
    return rejected.groupBy("provider").agg(F.count(F.lit(1)).alias("records"))


def filter_usage(spark, folder):
    rows = costs.filter_usage(
        _ledger(spark, folder),
        provider="gemini",
        operation="extraction",
        since=datetime(2024, 1, 3),
    )
    return _rounded(rows.select("usage_id", "episode_title", "cost_usd"), "cost_usd")


def cost_summary(spark, folder):
    return _rounded(costs.cost_summary(_ledger(spark, folder)), "total_cost_usd")


def cost_breakdown(spark, folder):
    return _rounded(costs.cost_breakdown(_ledger(spark, folder)), "cost_usd")


def top_episodes(spark, folder):
    return _rounded(costs.top_episodes(_ledger(spark, folder), 10), "cost_usd")


def recent_usage(spark, folder):
    rows = costs.recent_usage(_ledger(spark, folder), 10)
    return _rounded(
        rows.select("usage_id", "provider", _when("used_at").alias("used_at"), "cost_usd"),
        "cost_usd",
    )


def recent_totals(spark, folder):
    return _rounded(costs.recent_totals(_ledger(spark, folder), 100), "known_cost_usd")


def session_cost(spark, folder):
    rows = _ledger(spark, folder).withColumn("run", F.coalesce("episode_title", F.lit("none")))
    done = costs.session_cost(rows, datetime(2024, 1, 2), "run")
    return _rounded(done.select("usage_id", "run", "session_cost_usd"), "session_cost_usd")


def append_usage(spark, folder):
    rows = _ledger(spark, folder)
    number = F.col("position")
    return _provider_counts(costs.append_usage(rows.where(number % 3 != 0), rows.where(number % 2 == 0)))


def _provider_counts(rows):
    return rows.groupBy("provider").agg(
        F.count(F.lit(1)).alias("records"), F.sum("input_tokens").alias("input_tokens")
    )


def store_ledger(spark, folder):
    """Each version of a ledger on disk after two writes, the second of them sent twice, with a
    writer between them that is lost before its commit."""
    rows, path = _ledger(spark, folder), scratch(spark, "ledger")
    table = versions.ledger_table(spark, path)
    versions.append_ledger(rows.where("position % 3 <> 0"), path, writer="worker", number=0)
    table.stage(rows)
    for batch in (rows.where("position % 2 = 0"), rows):
        versions.append_ledger(batch, path, writer="worker", number=1)
    found = [_provider_counts(table.read(v)).withColumn("version", F.lit(v)) for v in table.versions()]
    return union_rows(*found)


def _priced_results(spark, folder):
    return b.results(spark, folder).withColumn("cost_known", F.col("provider") != "codex")


def usage_from_results(spark, folder):
    rows = costs.usage_from_results(_priced_results(spark, folder), costs.prices(spark))
    return _rounded(rows.drop("operation"), "cost_usd")


def usage_from_transcripts(spark, folder):
    runs = b.transcripts(spark, folder).withColumn(
        "cost_usd", F.when(F.col("episode_id") % 3 == 0, 0.0).otherwise(0.01)
    )
    rows = costs.usage_from_transcripts(runs, costs.prices(spark))
    return _rounded(rows.select("episode_id", "input_tokens", "output_tokens", "cost_usd"), "cost_usd")


QUERIES = {
    "price": price,
    "price_rejects": price_rejects,
    "filter_usage": filter_usage,
    "cost_summary": cost_summary,
    "cost_breakdown": cost_breakdown,
    "top_episodes": top_episodes,
    "recent_usage": recent_usage,
    "recent_totals": recent_totals,
    "session_cost": session_cost,
    "append_usage": append_usage,
    "store_ledger": store_ledger,
    "usage_from_results": usage_from_results,
    "usage_from_transcripts": usage_from_transcripts,
}

ORACLES = {
    "price": _sql("""
SELECT usage_id, provider, input_tokens, round(cost_usd, 9) AS cost_usd
FROM ledger WHERE provider IN ('gemini', 'claude')"""),
    "price_rejects": _sql("""
SELECT provider, count(*) AS records FROM ledger
WHERE provider NOT IN ('gemini', 'claude') GROUP BY provider"""),
    "filter_usage": _sql("""
SELECT usage_id, episode_title, round(cost_usd, 9) AS cost_usd FROM ledger
WHERE provider = 'gemini' AND operation = 'extraction'
  AND used_at >= TIMESTAMP '2024-01-03 00:00:00'"""),
    "cost_summary": _sql("""
SELECT count(*) AS total_operations, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
       CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens,
       round(sum(cost_usd), 9) AS total_cost_usd, bool_and(cost_known) AS total_cost_known,
       count(*) FILTER (NOT cost_known) AS unknown_cost_operations FROM ledger"""),
    "cost_breakdown": _sql("""
SELECT 'provider' AS breakdown, provider AS name, round(sum(cost_usd), 9) AS cost_usd
FROM ledger GROUP BY provider
UNION ALL SELECT 'operation', operation, round(sum(cost_usd), 9) FROM ledger GROUP BY operation
UNION ALL SELECT 'episode', episode_title, round(sum(cost_usd), 9) FROM ledger
WHERE episode_title IS NOT NULL AND episode_title <> '' GROUP BY episode_title"""),
    "top_episodes": _sql(
        """
SELECT episode_title, round(cost_usd, 9) AS cost_usd,
       (SELECT greatest(0, count(*) - 10) FROM per_episode) AS others
FROM per_episode ORDER BY round(per_episode.cost_usd, 9) DESC, seen, seen_id LIMIT 10""",
        per_episode="""
SELECT episode_title, sum(cost_usd) AS cost_usd, min(used_at) AS seen,
       arg_min(position, (used_at, position)) AS seen_id
FROM ledger WHERE episode_title IS NOT NULL GROUP BY episode_title""",
    ),
    "recent_usage": _sql("""
SELECT usage_id, provider, strftime(used_at, '%Y-%m-%d %H:%M:%S') AS used_at,
       round(cost_usd, 9) AS cost_usd
FROM ledger ORDER BY ledger.used_at DESC, position LIMIT 10"""),
    "recent_totals": _sql(
        """
SELECT round(sum(cost_usd) FILTER (cost_known), 9) AS known_cost_usd,
       count(*) FILTER (NOT cost_known) AS unknown_operations FROM newest""",
        newest="SELECT * FROM ledger ORDER BY used_at DESC, position LIMIT 100",
    ),
    "session_cost": _sql("""
SELECT usage_id, coalesce(episode_title, 'none') AS run,
       round(sum(cost_usd) OVER (PARTITION BY coalesce(episode_title, 'none')
             ORDER BY used_at, position ROWS UNBOUNDED PRECEDING), 9) AS session_cost_usd
FROM ledger WHERE used_at >= TIMESTAMP '2024-01-02 00:00:00'"""),
    "append_usage": _sql(
        """
SELECT provider, count(*) AS records, CAST(sum(input_tokens) AS BIGINT) AS input_tokens
FROM grown GROUP BY provider""",
        old="SELECT * FROM ledger WHERE position % 3 <> 0",
        grown="""
SELECT * FROM old UNION ALL SELECT * FROM ledger l WHERE position % 2 = 0
AND NOT EXISTS (SELECT 1 FROM old o WHERE o.usage_id = l.usage_id)""",
    ),
    "store_ledger": _sql(
        """
SELECT provider, count(*) AS records, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, 0::INT AS version
FROM ledger WHERE position % 3 <> 0 GROUP BY provider
UNION ALL SELECT provider, count(*), CAST(sum(input_tokens) AS BIGINT), 1::INT
FROM ledger WHERE position % 3 <> 0 OR position % 2 = 0 GROUP BY provider""",
    ),
    "usage_from_results": oracle(
        """
SELECT episode_id, template_name, provider, input_tokens, output_tokens,
       round(CASE WHEN provider = 'codex' THEN 0.0
            WHEN provider = 'claude' THEN input_tokens / 1e6 * 3 + output_tokens / 1e6 * 15
            WHEN input_tokens >= 128000 THEN input_tokens / 1e6 * 0.15 + output_tokens / 1e6 * 0.3
            ELSE input_tokens / 1e6 * 0.075 + output_tokens / 1e6 * 0.3 END, 9)::DOUBLE AS cost_usd,
       provider <> 'codex' AS cost_known,
       CASE WHEN provider = 'codex' THEN 'runtime_managed' ELSE 'known' END AS billing_mode
FROM results WHERE success AND NOT from_cache""",
        "results",
    ),
    "usage_from_transcripts": oracle(
        """
SELECT episode_id, length(text) // 4 AS input_tokens, length(text) // 4 AS output_tokens,
       round((length(text) // 4) / 1e6 * CASE WHEN length(text) // 4 >= 128000 THEN 0.15
             ELSE 0.075 END + (length(text) // 4) / 1e6 * 0.3, 9)::DOUBLE AS cost_usd
FROM transcripts WHERE episode_id % 3 <> 0""",
        "transcripts",
    ),
}
