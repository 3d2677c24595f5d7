"""Mix sources to target weights: hash-random order, distributed prefix sums, exact cuts.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castloom.llm.base import parked, pick

#: Rows that one range of a source's random order holds on average.
RANGE_ROWS = 2000


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text."""
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(plain, " "), "")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.when(text.isNull(), 0).otherwise(F.size(words_of(text))).cast("long")


def _weights(rank: Column, weights: Sequence[float]) -> Column:
    turns = F.array(*(F.lit(float(w)) for w in weights))
    return F.element_at(turns, ((rank - 1) % len(weights) + 1).cast("int"))


def targets(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: int = 2
) -> DataFrame:
    """One row per source: source_size, n_rows, target.

    Sources in code point order, null last, take `weights` in turn. Together they get `share`
    times all sizes, no source more than `epochs` times its own: with sources sorted by the
    level at which each fills up, two running sums give the one level that spends it all. The
    windows here run over one small row per source, never over documents.
    """
    sources = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_rows")
    )
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("weight", _weights(F.row_number().over(order), weights))
    sources = sources.withColumn("cap", epochs * F.col("source_size").cast("double"))
    filling = Window.orderBy(
        F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    sources = sources.select(
        "*",
        (
            share * F.sum(F.col("source_size").cast("double")).over(whole)
            - F.coalesce(F.sum("cap").over(filling), F.lit(0.0))
        ).alias("left"),
        (
            F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filling), F.lit(0.0))
        ).alias("sharing"),
    )
    level = F.col("left") / F.col("sharing")
    full = level * F.col("weight") >= F.col("cap")
    rest = F.min(F.when(~full, F.struct(F.col("cap") / F.col("weight"), level.alias("level"))))
    sources = sources.withColumn("level", rest.over(whole)["level"])
    return sources.select(
        "source",
        "source_size",
        "n_rows",
        F.when(full, F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"),
    )


def _random(seed: int) -> Column:
    """60 random bits from the id and the text."""
    told = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest")
    return F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long")


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _sizes(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    rows = pick(docs, doc_id=doc_id, text=text, source=source)
    rows = rows.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), _digest(F.col("text")).alias("digest")
    )
    return rows.withColumn("key", _random(seed))


def _taken(sizes: DataFrame, quotas: DataFrame) -> DataFrame:
    """Rows with source_size, target, `whole` epochs and `part` words of one more.

    The key is uniformly random, so equal ranges of it hold about equally many rows and a hot
    source is spread over as many ranges as it needs. Sums of ranges run along each source,
    sums of rows inside each range, and the budget falls into one row of one range.
    """
    quotas = quotas.withColumnRenamed("source", "of").withColumn(
        "ranges", F.ceil(F.col("n_rows") / RANGE_ROWS)
    )
    place = F.shiftright("key", 29) * F.col("ranges")
    rows = sizes.join(quotas, F.col("source").eqNullSafe(F.col("of"))).withColumn(
        "range", F.shiftright(place, 31)
    )
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("at"),
        F.col("range").alias("r"),
        F.coalesce(F.sum("in_range").over(along), F.lit(0)).alias("start"),
    )
    inside = (
        Window.partitionBy("source", "range")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(
        starts, F.col("source").eqNullSafe(F.col("at")) & (F.col("range") == F.col("r"))
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    budget = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    rows = rows.withColumn("whole", F.coalesce(whole, F.lit(0)))
    left = budget - F.col("start") - F.col("before")
    return rows.withColumn("part", F.greatest(F.lit(0), F.least("size", left)))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    epochs: int = 2,
    seed: int = 7,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    taken is the number of words the mix takes, repeated epochs counted; the document at which
    a source's budget ends is taken in part, so each source gives its target to the word. Null
    and empty texts have size 0 and give nothing; null is a source of its own. Repeated rows
    stay and are taken like any other, which of them first makes no difference. An empty table
    gives an empty result. Other columns are not used.
    """
    sizes = parked(_sizes(docs, doc_id, text, source, seed), "sizes")
    quotas = parked(targets(sizes, weights, share, epochs), "quotas")
    taken = (F.col("whole") * F.col("size") + F.col("part")).alias("taken")
    return _taken(sizes, quotas).select("doc_id", "source", "size", "source_size", "target", taken)


def mixed(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    epochs: int = 2,
    seed: int = 7,
) -> DataFrame:
    """The mix itself: each document as often as `mix` takes it, all columns.

    Documents stay whole: the one at which a budget ends is there once more if at least half
    of it fits.
    """
    sizes = parked(_sizes(docs, doc_id, text, source, seed), "sizes")
    plan = _taken(sizes, parked(targets(sizes, weights, share, epochs), "quotas"))
    more = ((F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))).cast("long")
    plan = plan.where("size > 0").groupBy("doc_id", "digest").agg(
        F.sum(F.col("whole") + more).alias("__copies"), F.count("*").alias("__rows")
    )
    plan = parked(plan.where("__copies > 0"), "plan").withColumnsRenamed(
        {"doc_id": "__id", "digest": "__digest"}
    )
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (
        _digest(F.col(f"`{text}`")) == F.col("__digest")
    )
    found = docs.join(plan, same)
    # Rows equal in id and text share their copies evenly.
    nth = F.row_number().over(Window.partitionBy("__id", "__digest").orderBy("__id", "__digest"))
    found = found.withColumn("__nth", F.when(F.col("__rows") > 1, nth).otherwise(1))
    copies = F.expr("(__copies + __rows - __nth) div __rows")
    found = found.withColumn("__copies", copies).where("__copies > 0")
    found = found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns))


#: Twin of `mix` for DuckDB.
MIX_SQL = r"""
WITH sizes AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        CAST('0x' || md5(concat_ws('|', 7, coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, ''))))[1:15]
            AS BIGINT) AS key
    FROM documents
), sources AS (
    SELECT source, sum(size) AS s, 2.0 * sum(size) AS cap,
        [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
    FROM sizes GROUP BY source
), levels AS (
    SELECT a.source, (SELECT 1.5 * sum(s) FROM sources) AS total,
        sum(CASE WHEN b.cap / b.w < a.cap / a.w THEN b.cap ELSE 0 END) AS filled,
        sum(CASE WHEN b.cap / b.w < a.cap / a.w THEN 0 ELSE b.w END) AS sharing
    FROM sources a, sources b GROUP BY a.source
), level AS (
    SELECT (total - filled) / sharing AS level FROM levels JOIN sources x
        ON x.source IS NOT DISTINCT FROM levels.source
    WHERE (total - filled) / sharing * w < cap ORDER BY cap / w LIMIT 1
), quotas AS (
    SELECT source, CAST(s AS BIGINT) AS source_size,
        CASE WHEN level * w >= cap THEN cap ELSE level * w END AS target FROM sources, level
), placed AS (
    SELECT z.*, source_size, target, floor(target / source_size) AS whole,
        coalesce(sum(size) OVER (PARTITION BY z.source ORDER BY key, doc_id, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM sizes z JOIN quotas q ON q.source IS NOT DISTINCT FROM z.source
)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target,
    CAST(whole * size + greatest(0, least(size, round(target - whole * source_size) - before))
        AS BIGINT) AS taken
FROM placed
"""
