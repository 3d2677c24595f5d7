"""Quality rules whose thresholds come from quantile sketches per language and source."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castloom.llm.base import BLANKS, parked, pick

SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper")
_CAPITALS = bytes(range(65, 91))

#: Each metric in thousandths per word, with its anchor: the percentile from whose distance to
#: the median the limits follow. The rarer a metric is above zero in good texts, the further out
#: its anchor; nothing else sets a limit.
METRICS = {
    "word_length": ("word_chars", 90),
    "symbols": ("n_symbols", 90),
    "dup_lines": ("n_dup_lines", 99),
    "repeats": ("n_repeat_words", 97),
    "capitals": ("n_upper", 95),
}
#: Metrics that can be too low as well, from the mirrored percentile.
TWO_SIDED = ("word_length",)
#: Limits lie this many times the distance between anchor and median beyond the anchor.
WIDTHS = 4
#: A sketch of fewer documents is replaced by that of its language, then by that of all.
LEAST_DOCUMENTS = 100


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of `size` words that occur twice or more, the first included."""
    count = len(words) - size + 1
    if count < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == len(ids):
        return 0
    ranks = ids[:count]
    for offset in range(1, size):
        nxt = ids[offset : offset + count]
        ranks = np.unique(ranks * len(known) + nxt, return_inverse=True)[1]
    twice = np.bincount(ranks)[ranks] > 1
    covered = np.zeros(len(ids), bool)
    for offset in range(size):
        covered[offset : offset + count] |= twice
    return int(covered.sum())


def features_of(text: str | None) -> tuple[int, ...]:
    """The features of one text in the order of FEATURES; all zero for null."""
    if not text:
        return (0,) * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen, repeats = set(), 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            repeats += line in seen
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        repeats,
        repeated_words(words),
        len(raw) - len(raw.translate(None, _CAPITALS)),
    )


def features(text: Column) -> Column:
    """The features of a text as a struct of longs."""
    fields = pa.struct([(name, pa.int64()) for name in FEATURES])

    @F.arrow_udf(", ".join(f"{name} bigint" for name in FEATURES))
    def measure(texts: pa.Array) -> pa.Array:
        rows = np.array([features_of(t.as_py()) for t in texts], np.int64).reshape(-1, len(FEATURES))
        return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], fields=list(fields))

    return measure(text)


def base_failed(f: Column) -> Column:
    """Fewer than 10 words, or over a fifth of them repeated."""
    return (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])


def _metric(f: Column, name: str) -> Column:
    words = F.when(f["n_words"] > 0, f["n_words"])
    return F.call_function("div", f[METRICS[name][0]] * 1000, words)


def sketch(rows: DataFrame) -> DataFrame:
    """Counts by language, source, metric and bucket: (lang, source, metric, edge, n).

    Takes lang, source and f. A bucket is named by its lower edge; values up to 63 have one
    each, larger ones share 32 for each power of two, so an edge is within 1/32 of the value.
    Sketches merge by adding counts, in any order and with the same result; the number of
    rows is bounded by groups and buckets, and Spark adds up before the shuffle.
    """
    values = F.explode(
        F.array(
            *(
                F.struct(F.lit(name).alias("metric"), _metric(F.col("f"), name).alias("v"))
                for name in METRICS
            )
        )
    )
    passing = rows.where(~base_failed(F.col("f"))).select("lang", "source", values.alias("m"))
    shift = F.greatest(F.lit(0), F.length(F.bin("m.v")) - 6)
    edge = F.expr("shiftleft(shiftright(v, shift), shift)")
    named = passing.select("lang", "source", "m.metric", "m.v", shift.cast("int").alias("shift"))
    return named.groupBy("lang", "source", "metric", edge.alias("edge")).agg(
        F.count("*").alias("n")
    )


def _anchor() -> Column:
    pairs = (F.lit(x) for name, (_, percent) in METRICS.items() for x in (name, percent))
    return F.element_at(F.create_map(*pairs), F.col("metric"))


def _percentiles(sketches: DataFrame) -> DataFrame:
    """Median, anchor and mirrored anchor of each metric, by group, by language and over all.

    level says which: 0 a source of a language, 1 a language, 3 all.
    """
    merged = sketches.groupingSets(
        [
            ["metric", "edge", "lang", "source"],
            ["metric", "edge", "lang"],
            ["metric", "edge"],
        ],
        "metric",
        "edge",
        "lang",
        "source",
    ).agg(F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n"))
    group = Window.partitionBy("level", "lang", "source", "metric")
    sums = merged.select(
        "*",
        F.sum("n").over(group.orderBy("edge")).alias("upto"),
        F.sum("n").over(group).alias("total"),
    )
    at = lambda percent: F.min(F.when(100 * F.col("upto") >= percent * F.col("total"), F.col("edge")))
    return sums.groupBy("level", "lang", "source", "metric").agg(
        at(100 - _anchor()).alias("mirror"),
        at(F.lit(50)).alias("median"),
        at(_anchor()).alias("anchor"),
        F.max("total").alias("total"),
    )


def thresholds(
    sketches: DataFrame, widths: int = WIDTHS, least: int = LEAST_DOCUMENTS
) -> DataFrame:
    """One row per language and source: a `<metric>_low` and `<metric>_high` for each metric."""
    found = _percentiles(sketches)
    low = F.col("mirror") - widths * (F.col("median") - F.col("mirror"))
    high = F.col("anchor") + widths * (F.col("anchor") - F.col("median"))
    limits = (
        found.withColumns({"low": low, "high": high})
        .groupBy("level", F.col("lang").alias("of_lang"), F.col("source").alias("of_source"))
        .agg(
            *(
                F.max(F.when(F.col("metric") == name, F.col(side))).alias(f"{name}_{side}")
                for name in METRICS
                for side in ("low", "high")
            )
        )
    )
    sizes = found.where("level = 0").groupBy("lang", "source").agg(F.max("total").alias("n"))
    in_lang = F.sum("n").over(Window.partitionBy("lang"))
    level = F.when(F.col("n") >= least, 0).when(in_lang >= least, 1).otherwise(3)
    groups = sizes.withColumn("pool", level)
    same = (
        (F.col("pool") == F.col("level"))
        & F.when(F.col("pool") < 3, F.col("lang")).eqNullSafe(F.col("of_lang"))
        & F.when(F.col("pool") < 1, F.col("source")).eqNullSafe(F.col("of_source"))
    )
    return groups.join(limits, same).drop("n", "pool", "level", "of_lang", "of_source")


def _kept(f: Column) -> Column:
    """Not base_failed and inside all limits of its group; a group without any has none."""
    inside = ~base_failed(f)
    for name in METRICS:
        value = _metric(f, name)
        inside &= F.coalesce(value <= F.col(f"__{name}_high"), F.lit(True))
        if name in TWO_SIDED:
            inside &= F.coalesce(value >= F.col(f"__{name}_low"), F.lit(True))
    return inside


def _judged(rows: DataFrame, limits: DataFrame, lang: str, source: str) -> DataFrame:
    """Rows with `__f` get `__kept`. Limits are broadcast only if Spark finds them small."""
    renamed = limits.select(*(F.col(c).alias(f"__{c}") for c in limits.columns))
    same = F.col(f"`{lang}`").eqNullSafe(F.col("__lang")) & F.col(f"`{source}`").eqNullSafe(
        F.col("__source")
    )
    return rows.join(renamed, same, "left").withColumn("__kept", _kept(F.col("__f")))


def judge(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """One row per document: doc_id, the features, base_failed, kept.

    Texts are measured once; sketches and verdicts use the parked numbers. Null and empty
    texts have no words and fail. Null languages and sources are groups like any other.
    Repeated rows stay. An empty table gives an empty result. Other columns are not used.
    """
    rows = pick(docs, doc_id=doc_id, text=text, lang=lang, source=source)
    rows = parked(rows.select("doc_id", "lang", "source", features(F.col("text")).alias("f")), "words")
    limits = parked(thresholds(sketch(rows)), "limits")
    judged = _judged(rows.withColumnRenamed("f", "__f"), limits, "lang", "source")
    return judged.select(
        "doc_id",
        *(F.col("__f")[name].alias(name) for name in FEATURES),
        base_failed(F.col("__f")).alias("base_failed"),
        F.col("__kept").alias("kept"),
    )


def keep(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that `judge` keeps, all columns; texts are read twice and never moved
    unless there are more limits than Spark broadcasts."""
    rows = pick(docs, text=text, lang=lang, source=source)
    rows = rows.select("lang", "source", features(F.col("text")).alias("f"))
    limits = parked(thresholds(parked(sketch(rows), "sketch")), "limits")
    measured = docs.withColumn("__f", features(F.col(f"`{text}`")))
    kept = _judged(measured, limits, lang, source).where("__kept")
    return kept.select(*(docs[f"`{c}`"] for c in docs.columns))


#: Twin of `judge` with the columns of query op2, for DuckDB.
JUDGE_SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), listed AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts
), placed AS (
    SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM listed
), windows AS (
    SELECT r, i, list(word) OVER five AS five, count(*) OVER five AS n FROM placed
    WINDOW five AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
), twice AS (
    SELECT r, i FROM windows WHERE n = 5
    QUALIFY count(*) OVER (PARTITION BY r, five) > 1
), covered AS (
    SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS steps(k) GROUP BY r
), lines AS (
    SELECT r, unnest(string_split(t, chr(10))) AS line FROM texts
), again AS (
    SELECT r, sum(n - 1) AS n FROM (
        SELECT r, line, count(*) AS n FROM lines
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line
    ) GROUP BY r
), f AS (
    SELECT l.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(again.n, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
    FROM listed l LEFT JOIN again ON again.r = l.r LEFT JOIN covered ON covered.r = l.r
), b AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f
), long AS (
    SELECT r, lang, source, metric, v FROM (
        SELECT r, lang, source,
            1000 * word_chars // n_words AS word_length, 1000 * n_symbols // n_words AS symbols,
            1000 * n_dup_lines // n_words AS dup_lines, 1000 * n_repeat_words // n_words AS repeats,
            1000 * n_upper // n_words AS capitals
        FROM b WHERE NOT base_failed
    ) UNPIVOT (v FOR metric IN (word_length, symbols, dup_lines, repeats, capitals))
), sketch AS (
    SELECT lang, source, metric, (v >> s) << s AS edge, count(*) AS n FROM (
        SELECT *, greatest(0, length(bin(v)) - 6)::BIGINT AS s FROM long
    ) GROUP BY ALL
), merged AS (
    SELECT grouping(lang, source) AS level, lang, source, metric, edge, sum(n) AS n FROM sketch
    GROUP BY GROUPING SETS ((metric, edge, lang, source), (metric, edge, lang), (metric, edge))
), sums AS (
    SELECT *, sum(n) OVER (g ORDER BY edge) AS upto, sum(n) OVER (g) AS total FROM merged
    WINDOW g AS (PARTITION BY level, lang, source, metric)
), limits AS (
    SELECT level, lang, source, metric, total, mirror - 4 * (median - mirror) AS low,
        anchor + 4 * (anchor - median) AS high
    FROM (
        SELECT level, lang, source, metric, max(total) AS total,
            min(edge) FILTER (100 * upto >= (100 - percent) * total) AS mirror,
            min(edge) FILTER (100 * upto >= 50 * total) AS median,
            min(edge) FILTER (100 * upto >= percent * total) AS anchor
        FROM sums JOIN (VALUES ('word_length', 90), ('symbols', 90), ('dup_lines', 99),
            ('repeats', 97), ('capitals', 95)) AS anchors(metric, percent) USING (metric)
        GROUP BY ALL
    )
), groups AS (
    SELECT lang, source, CASE WHEN n >= 100 THEN 0
        WHEN sum(n) OVER (PARTITION BY lang) >= 100 THEN 1 ELSE 3 END AS pool
    FROM (SELECT lang, source, max(total) AS n FROM limits WHERE level = 0 GROUP BY ALL)
), bad AS (
    SELECT DISTINCT long.r FROM long
    JOIN groups g ON g.lang IS NOT DISTINCT FROM long.lang
        AND g.source IS NOT DISTINCT FROM long.source
    JOIN limits l ON l.level = g.pool AND l.metric = long.metric
        AND l.lang IS NOT DISTINCT FROM CASE WHEN pool < 3 THEN g.lang END
        AND l.source IS NOT DISTINCT FROM CASE WHEN pool < 1 THEN g.source END
    WHERE v > high OR (v < low AND long.metric = 'word_length')
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, base_failed,
    NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept
FROM b
"""
