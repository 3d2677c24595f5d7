"""Usage and cost ledger: pricing, filters, totals, breakdowns, recent usage."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castloom.operators.ordered import running_sums
from castloom.operators.rows import new_rows

#: Dollars per million tokens by provider and size of the input.
PRICES = (
    # provider, model, min_tokens, max_tokens (exclusive), input, output
    ("gemini", "gemini-2.5-flash", 0, 128_000, 0.075, 0.30),
    ("gemini", "gemini-2.5-flash", 128_000, None, 0.15, 0.30),
    ("claude", "claude-3-5-sonnet-20241022", 0, None, 3.00, 15.00),
)
LOCAL_RUNTIMES = ("claude-code", "codex")
_PRICE_SCHEMA = (
    "provider string, price_model string, min_tokens bigint, max_tokens bigint, "
    "input_price double, output_price double"
)


def prices(spark: SparkSession, rows=PRICES) -> DataFrame:
    return spark.createDataFrame(list(rows), _PRICE_SCHEMA)


#: Providers whose use costs nothing: captions, and what a local runtime manages itself.
FREE = ("youtube", *LOCAL_RUNTIMES)


def price(
    usage: DataFrame, price_list: DataFrame, free: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Cost of each record by its provider's price row, and the records without one.

    The row is chosen by the whole input size: a long input is priced at the long rate
    from its first token. Providers in ``free`` cost 0; any other one that the list does
    not cover is a reject, never a free record.
    """
    p = price_list.select(*(F.col(c).alias(f"_{c}") for c in price_list.columns))
    match = (
        (F.col("provider") == F.col("_provider"))
        & (F.col("input_tokens") >= F.col("_min_tokens"))
        & (F.col("_max_tokens").isNull() | (F.col("input_tokens") < F.col("_max_tokens")))
    )
    cost = F.col("input_tokens") / 1e6 * F.col("_input_price") + F.col(
        "output_tokens"
    ) / 1e6 * F.col("_output_price")
    nothing = F.when(F.col("provider").isin(*free), 0.0) if free else F.lit(None).cast("double")
    told = usage.drop("cost_usd").join(p, match, "left").withColumn("cost_usd", F.coalesce(cost, nothing))
    told = told.drop(*p.columns)
    return told.where("cost_usd IS NOT NULL"), told.where("cost_usd IS NULL").drop("cost_usd")


def with_cost(usage: DataFrame, price_list: DataFrame) -> DataFrame:
    """Ledger rows with a cost; ``price`` tells which rows are left out."""
    return price(usage, price_list, FREE)[0]


def filter_usage(
    usage: DataFrame,
    provider: str | None = None,
    operation: str | None = None,
    episode_title: str | None = None,
    since: datetime | None = None,
) -> DataFrame:
    """Rows meeting every given condition; ``since`` includes its own instant."""
    for column, value in (
        ("provider", provider),
        ("operation", operation),
        ("episode_title", episode_title),
    ):
        if value:
            usage = usage.where(F.col(column) == value)
    return usage.where(F.col("used_at") >= F.lit(since)) if since else usage


def _total_tokens(usage: DataFrame):
    both = F.col("input_tokens") + F.col("output_tokens")
    if "total_tokens" not in usage.columns:
        return both
    return F.coalesce(F.nullif("total_tokens", F.lit(0)), both)


def cost_summary(usage: DataFrame) -> DataFrame:
    """One row of totals; an empty ledger gives zeros and a known total."""
    zero = F.lit(0).cast("bigint")
    return usage.agg(
        F.count(F.lit(1)).alias("total_operations"),
        F.coalesce(F.sum("input_tokens"), zero).alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), zero).alias("total_output_tokens"),
        F.coalesce(F.sum(_total_tokens(usage)), zero).alias("total_tokens"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
        F.coalesce(F.bool_and("cost_known"), F.lit(True)).alias("total_cost_known"),
        F.count_if(~F.col("cost_known")).alias("unknown_cost_operations"),
    )


def cost_breakdown(usage: DataFrame) -> DataFrame:
    """Cost by provider, by operation and by episode in one pass.

    Rows without an episode count in the first two breakdowns only. The grouping id, not
    a null name, tells which breakdown a row belongs to.
    """
    names = ["provider", "operation", "episode_title"]
    sets = [[F.col(n)] for n in names]
    grouped = usage.groupingSets(sets, *[F.col(n) for n in names]).agg(
        F.sum("cost_usd").alias("cost_usd"), F.grouping_id().alias("_set")
    )
    by = F.when(F.col("_set") == 3, "provider").when(F.col("_set") == 5, "operation")
    named = grouped.select(
        by.otherwise("episode").alias("breakdown"),
        F.when(F.col("_set") == 3, F.col("provider"))
        .when(F.col("_set") == 5, F.col("operation"))
        .otherwise(F.col("episode_title"))
        .alias("name"),
        "cost_usd",
    )
    return named.where((F.col("breakdown") != "episode") | (F.coalesce("name", F.lit("")) != ""))


def top_episodes(usage: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` dearest episodes, the first seen first among equals, and how many more exist."""
    costs = (
        usage.where(F.coalesce("episode_title", F.lit("")) != "")
        .groupBy("episode_title")
        .agg(
            F.sum("cost_usd").alias("cost_usd"),
            F.min(F.struct("used_at", "position")).alias("_seen"),
        )
    )
    others = F.greatest(F.lit(0), F.count(F.lit(1)) - n).cast("bigint").alias("others")
    top = costs.orderBy(F.round("cost_usd", 9).desc(), "_seen").limit(n).drop("_seen")
    return top.withColumn("others", costs.agg(others).scalar())


def recent_usage(usage: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` newest rows, equal times in stored order (``position``)."""
    return usage.orderBy(F.col("used_at").desc(), "position").limit(n)


def recent_totals(usage: DataFrame, n: int = 10) -> DataFrame:
    """Known cost and number of unknown costs among the ``n`` newest rows."""
    return recent_usage(usage, n).agg(
        F.coalesce(F.sum(F.when(F.col("cost_known"), F.col("cost_usd"))), F.lit(0.0)).alias(
            "known_cost_usd"
        ),
        F.count_if(~F.col("cost_known")).alias("unknown_operations"),
    )


def session_cost(usage: DataFrame, run_start: datetime | None = None, run: str | None = None):
    """Cost of a run after each of its records, from ``run_start`` on."""
    rows = usage.where(F.col("used_at") >= F.lit(run_start)) if run_start else usage
    rows = rows.select(*([run] if run else []), "usage_id", "used_at", "position", "cost_usd")
    return running_sums(
        rows, [run] if run else [], ["used_at", "position"], {"session_cost_usd": F.col("cost_usd")}
    )


def append_usage(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """Ledger rows, then those of the batch whose id is not there yet."""
    return ledger.unionByName(new_rows(batch, ledger, "usage_id"), allowMissingColumns=True)


def usage_from_results(results: DataFrame, price_list: DataFrame) -> DataFrame:
    """Ledger rows of fresh successful results.

    Known costs are priced again from the tokens, whatever the result itself claims;
    usage a local runtime manages is recorded at cost 0 and as unknown.
    """
    flag = F.lit(False)
    bypassed = F.col("bypassed") if "bypassed" in results.columns else flag
    fresh = results.where(F.col("success") & ~F.col("from_cache") & ~F.coalesce(bypassed, flag))
    known = with_cost_rows(fresh.where("cost_known"), price_list)
    managed = fresh.where(~F.col("cost_known") & F.col("provider").isin(*LOCAL_RUNTIMES))
    columns = ["episode_id", "template_name", "provider", "input_tokens", "output_tokens"]
    return known.select(
        *columns, "cost_usd", F.lit(True).alias("cost_known"), F.lit("known").alias("billing_mode")
    ).unionByName(
        managed.select(
            *columns,
            F.lit(0.0).alias("cost_usd"),
            F.lit(False).alias("cost_known"),
            F.lit("runtime_managed").alias("billing_mode"),
        )
    ).withColumn("operation", F.lit("extraction"))


def with_cost_rows(rows: DataFrame, price_list: DataFrame) -> DataFrame:
    """Only the rows the price list covers."""
    return price(rows, price_list)[0]


def usage_from_transcripts(runs: DataFrame, price_list: DataFrame) -> DataFrame:
    """Ledger rows of paid transcripts: a quarter of the characters, in and out."""
    tokens = F.floor(F.length("text") / 4).cast("bigint")
    paid = runs.where(F.col("cost_usd") > 0).select(
        "episode_id",
        F.lit("gemini").alias("provider"),
        F.lit("gemini-2.5-flash").alias("model"),
        F.lit("transcription").alias("operation"),
        tokens.alias("input_tokens"),
        tokens.alias("output_tokens"),
        F.lit(True).alias("cost_known"),
    )
    return with_cost_rows(paid, price_list)
