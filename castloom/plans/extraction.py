"""Which templates must run on which transcripts, by which provider and at what cost.

The transcript text is reduced to a few numbers and a hash in the scan; from there on only
narrow rows move. Templates, routes and prices are dimensions joined by broadcast after a
size check; stored versions and the cache are joined on keys that are nearly unique.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castloom.functions.text import content_key, count_tokens, est_tokens
from castloom.plans.prompts import prompt_chars

#: Fixed values.
DEFAULT_TEMPLATES = ("summary", "quotes", "key-concepts")
TECH_WORDS = (
    "software", "programming", "code", "developer", "api", "framework", "library",
    "github", "python", "javascript", "rust", "database", "cloud", "devops",
)
INTERVIEW_WORDS = (
    "guest", "author", "book", "conversation", "interview", "wrote", "published",
    "story", "experience",
)
MIN_WORDS = 3
BYPASS_TOKENS = 500
LOCAL_RUNTIMES = ("claude-code", "codex")
CACHE_FORMAT = 3
CACHE_TTL_DAYS = 30
#: provider, model, max_input_tokens (null: no limit)
CAPABILITIES = (
    ("gemini", "gemini-3-pro-preview", 1_000_000),
    ("claude", "claude-sonnet-4-5", 200_000),
)
#: Dollars per million tokens for estimates; a long input is charged in tiers.
ESTIMATE = {
    "gemini": {"input": 2.00, "long": 4.00, "from": 200_000, "output": 12.00},
    "claude": {"input": 3.00, "output": 15.00},
}


def category(
    text: Column,
    tech: Sequence[str] = TECH_WORDS,
    interview: Sequence[str] = INTERVIEW_WORDS,
) -> Column:
    """``tech`` or ``interview`` when three of its words occur and more than of the other's.

    Words are looked for anywhere in the lower-cased text, each counted once.
    """
    low = F.lower(text)

    def score(words: Sequence[str]) -> Column:
        total = F.lit(0)
        for word in words:
            total = total + F.contains(low, F.lit(word)).cast("int")
        return total

    t, i = score(tech), score(interview)
    return F.when((t >= MIN_WORDS) & (t > i), "tech").when((i >= MIN_WORDS) & (i > t), "interview")


def capabilities(spark: SparkSession, rows=CAPABILITIES) -> DataFrame:
    return spark.createDataFrame(list(rows), "provider string, model string, max_input_tokens bigint")


def templates_for(templates: DataFrame, name: str) -> DataFrame:
    """Templates of a category, or that apply to it, by name."""
    fits = (F.col("category") == name) | F.array_contains("applies_to", name)
    return templates.where(fits).orderBy("name")


def category_choices(templates: DataFrame) -> DataFrame:
    """Names each category adds, in name order."""
    named = templates.select(
        "name", "applies_to",
        F.explode(F.array_distinct(F.array_compact(F.concat(F.array("category"), "applies_to")))).alias("choice"),
    )
    applies = F.array_contains("applies_to", F.col("choice")) | F.array_contains("applies_to", "all")
    return named.where(applies).groupBy("choice").agg(
        F.array_sort(F.collect_set("name")).alias("category_names")
    )


def plan_templates(
    transcripts: DataFrame, templates: DataFrame, defaults: Sequence[str] = DEFAULT_TEMPLATES
) -> DataFrame:
    """One row per transcript and selected template.

    Defaults, the category's templates and ``custom_templates`` (if there is such a
    column), each once. Ordered by (priority, selection_rank) within a transcript.
    Unknown names are left out.
    """
    none = F.array().cast("array<string>")
    custom = F.col("custom_templates") if "custom_templates" in transcripts.columns else none
    choices = category_choices(templates)
    asked = transcripts.join(choices, F.col("category") == F.col("choice"), "left").withColumn(
        "_names",
        F.array_distinct(
            F.concat(
                F.array(*[F.lit(d) for d in defaults]),
                F.coalesce("category_names", none),
                F.coalesce(custom, none),
            )
        ),
    )
    keep = [c for c in transcripts.columns if c != "custom_templates"]
    named = asked.select(*keep, F.posexplode("_names").alias("selection_rank", "template_name"))
    known = templates.select(
        F.col("name").alias("template_name"), F.col("version").alias("template_version"), "priority"
    )
    return named.join(known, "template_name")


def stale_templates(work: DataFrame, stored: DataFrame, keep_fresh: bool = False) -> DataFrame:
    """Work whose stored note is missing, of unknown version, or of another version.

    ``stored`` has (episode_id, template_name, version). With ``keep_fresh`` all rows stay
    and the column ``stale`` tells.
    """
    versions = stored.select("episode_id", "template_name", F.col("version").alias("_stored"))
    old = F.coalesce(
        (F.col("_stored") == "unknown") | (F.col("_stored") != F.col("template_version")),
        F.lit(True),
    )
    judged = work.join(versions, ["episode_id", "template_name"], "left").withColumn("stale", old)
    judged = judged.drop("_stored")
    return judged if keep_fresh else judged.where("stale").drop("stale")


def bypass(
    template_name: Column,
    tokens: Column,
    has_source: Column,
    *,
    enabled: bool = True,
    force: bool = False,
    threshold: int = BYPASS_TOKENS,
) -> Column:
    """Short texts with a known origin are their own summary."""
    if force or not enabled:
        return F.lit(False)
    fits = (template_name == "summary") & has_source & (tokens <= threshold)
    return F.coalesce(fits, F.lit(False))


def template_routes(
    templates: DataFrame, providers: DataFrame, default: str = "gemini", override: str | None = None
) -> DataFrame:
    """Providers to try per template, in order; without an entry in ``providers`` none."""
    if override:
        order = F.array(F.lit(override))
    else:
        accurate = F.array(F.lit("claude"), F.lit(default), F.lit("gemini"))
        usual = F.array(F.lit(default), F.lit("gemini"), F.lit("claude"))
        strict = (F.col("expected_format") == "json") & (F.col("required_fields") > 5)
        quotes = F.contains(F.lower("name"), F.lit("quote"))
        wish = F.when(
            (F.coalesce("model_preference", F.lit("")) != "")
            & ~F.col("model_preference").isin(*LOCAL_RUNTIMES),
            F.col("model_preference"),
        )
        order = F.array_distinct(
            F.concat(F.array_compact(F.array(wish)), F.when(quotes | strict, accurate).otherwise(usual))
        )
    tried = templates.select(F.col("name").alias("template_name"), F.posexplode(order).alias("route_rank", "provider"))
    return tried.join(providers, "provider")


def route(work: DataFrame, routes: DataFrame, keep_unrouted: bool = False) -> DataFrame:
    """One row per provider that can hold the prompt (``prompt_tokens``), best rank first."""
    r = routes.alias("r")
    fits = (F.col("w.template_name") == F.col("r.template_name")) & (
        F.col("r.max_input_tokens").isNull()
        | (F.col("w.prompt_tokens") <= F.col("r.max_input_tokens"))
    )
    joined = work.alias("w").join(r, fits, "left" if keep_unrouted else "inner")
    return joined.select("w.*", "r.route_rank", "r.provider", "r.model")


def cache_key(text_hash: Column, template: str = "template_name", version: str = "template_version",
              prompt_hash: Column | None = None) -> Column:
    """Key of an extraction: text, template, prompt, provider and model all count."""
    return content_key(
        cache_format_version=F.lit(CACHE_FORMAT),
        transcript_hash=text_hash,
        template_name=F.col(template),
        template_version=F.col(version),
        provider=F.col("provider"),
        model=F.col("model"),
        prompt_hash=prompt_hash if prompt_hash is not None else F.lit(None).cast("string"),
    )


def valid_cache(cache: DataFrame, as_of: datetime, ttl_days: int = CACHE_TTL_DAYS) -> DataFrame:
    """Entries no older than the time to live."""
    return cache.where(F.col("cached_at") >= F.lit(as_of - timedelta(days=ttl_days)))


def cache_lookup(
    attempts: DataFrame, cache: DataFrame, as_of: datetime, ttl_days: int = CACHE_TTL_DAYS
) -> DataFrame:
    """Mark each routed attempt (column ``cache_key``) as ``hit`` or not; expired is a miss."""
    keys = valid_cache(cache, as_of, ttl_days).select(
        F.col("cache_key"), F.lit(True).alias("_hit")
    )
    return attempts.join(keys, "cache_key", "left").withColumn(
        "hit", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def est_cost(provider: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Estimated dollars. Unlike billing, a long input is charged in tiers."""
    cost = F.lit(0.0)
    for name, rate in ESTIMATE.items():
        edge = rate.get("from")
        short = F.least(input_tokens, F.lit(edge)) if edge else input_tokens
        total = short / 1e6 * rate["input"] + output_tokens / 1e6 * rate["output"]
        if edge:
            total = total + F.greatest(F.lit(0), input_tokens - edge) / 1e6 * rate["long"]
        cost = F.when(provider == name, total).otherwise(cost)
    return cost


def transcript_facts(
    transcripts: DataFrame,
    tech: Sequence[str] = TECH_WORDS,
    interview: Sequence[str] = INTERVIEW_WORDS,
) -> DataFrame:
    """What planning needs to know of a transcript, without its text."""
    text = F.col("text")
    given = F.col("category") if "category" in transcripts.columns else F.lit(None).cast("string")
    others = [c for c in transcripts.columns if c not in ("text", "category")]
    return transcripts.select(
        *others,
        F.length(text).alias("chars"),
        est_tokens(text).alias("tokens"),
        F.sha2(text, 256).alias("text_hash"),
        F.coalesce(given, category(text, tech, interview)).alias("category"),
    )


def plan_extraction(
    transcripts: DataFrame,
    templates: DataFrame,
    providers: DataFrame,
    stored: DataFrame,
    cache: DataFrame,
    as_of: datetime,
    *,
    tech: Sequence[str] = TECH_WORDS,
    interview: Sequence[str] = INTERVIEW_WORDS,
    default_provider: str = "gemini",
    override: str | None = None,
    use_cache: bool = True,
    force: bool = False,
    ttl_days: int = CACHE_TTL_DAYS,
) -> DataFrame:
    """One row per transcript and template with what to do and what it will cost.

    ``action`` is ``skip`` (note up to date), ``bypass`` (short text passed through),
    ``cached``, ``run`` or ``no_provider``. ``transcripts`` has (episode_id, podcast, text,
    has_source) and may bring ``category`` and ``custom_templates``.
    """
    facts = transcript_facts(transcripts, tech, interview)
    chosen = stale_templates(plan_templates(facts, templates), stored, keep_fresh=True)
    sizes = templates.select(
        F.col("name").alias("template_name"),
        "max_tokens",
        (F.length("system_prompt") + 2).alias("_system"),
        F.col("user_prompt").alias("_user"),
        (count_tokens(F.col("system_prompt")) + count_tokens(F.col("user_prompt"))
         + count_tokens(F.coalesce("examples", F.lit("")))).alias("_base_tokens"),
        F.sha2(F.to_json(F.struct("system_prompt", "user_prompt", "expected_format",
                                  "output_schema", "max_tokens", "temperature", "examples")), 256).alias("_prompt_hash"),
    )
    sized = chosen.join(sizes, "template_name")
    estimate = F.greatest(
        F.lit(1), F.floor((F.col("_system") + prompt_chars(F.col("_user"), F.col("chars"))) / 4)
    ) + F.col("max_tokens")
    state = F.when(~F.col("stale"), "skip").when(
        bypass(F.col("template_name"), F.col("tokens"), F.col("has_source"), force=force), "bypass"
    )
    work = sized.select(
        "episode_id", "podcast", "template_name", "template_version", "priority", "selection_rank",
        "text_hash", "max_tokens", "_prompt_hash",
        estimate.cast("bigint").alias("prompt_tokens"),
        (F.col("_base_tokens") + F.floor(F.col("chars") / 4)).cast("bigint").alias("input_tokens"),
        state.alias("_state"),
    )
    attempts = route(
        work, template_routes(templates, providers, default_provider, override), keep_unrouted=True
    ).withColumn("cache_key", cache_key(F.col("text_hash"), prompt_hash=F.col("_prompt_hash")))
    looked = (
        cache_lookup(attempts, cache, as_of, ttl_days)
        if use_cache
        else attempts.withColumn("hit", F.lit(False))
    )
    first = F.struct("route_rank", "provider", "model")
    usable = F.col("_state").isNull() & F.col("provider").isNotNull()
    grouped = looked.groupBy("episode_id", "template_name").agg(
        *[F.first(c).alias(c) for c in (
            "podcast", "template_version", "priority", "selection_rank", "prompt_tokens",
            "input_tokens", "max_tokens", "_state")],
        F.min(F.when(usable & F.col("hit"), first)).alias("_cached"),
        F.min(F.when(usable, first)).alias("_route"),
    )
    action = (
        F.when(F.col("_state").isNotNull(), F.col("_state"))
        .when(F.col("_cached").isNotNull(), "cached")
        .when(F.col("_route").isNotNull(), "run")
        .otherwise("no_provider")
    )
    used = F.coalesce("_cached", "_route")
    cost = est_cost(used["provider"], F.col("input_tokens"), F.col("max_tokens"))
    return grouped.withColumn("action", action).select(
        "episode_id", "podcast", "template_name", "template_version", "priority", "selection_rank",
        "action",
        F.when(F.col("action") == "bypass", "bypass").otherwise(used["provider"]).alias("provider"),
        used["model"].alias("model"),
        "prompt_tokens",
        F.when(F.col("action") == "run", cost).otherwise(0.0).alias("est_cost_usd"),
    )


def plan_summary(plan: DataFrame) -> DataFrame:
    """Work and estimated cost by podcast and action."""
    return plan.groupBy("podcast", "action").agg(
        F.count(F.lit(1)).alias("templates"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("est_cost_usd").alias("est_cost_usd"),
    )
