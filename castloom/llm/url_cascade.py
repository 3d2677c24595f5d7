"""URL filters: allow and block rules, then a cascade of Bloom filters for listed hosts.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castloom.llm.base import parked, pick

#: (verdict, rule): a rule is a host, which includes its subdomains, and the start of a path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Words in a host name that put it on the list.
LISTED_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")

BITS_PER_KEY, HASHES = 12, 4
#: A level never has more bits; more keys raise its share of false positives, which the next
#: level takes up. This bounds what is sent to the executors: 4 MiB a level.
MOST_BITS = 1 << 25
#: Levels after which the filters count as too small for the keys.
MOST_LEVELS = 64


def url_host(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?`, `#` or the end; A-Z lower-cased."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """From the end of the host to the next `?`, `#` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, or null."""
    fits = []
    for rule in sorted({r for _, r in rules}, key=lambda r: (-len(r), r)):
        name, _, rest = rule.partition("/")
        of_host = (host == name) | host.endswith(f".{name}")
        fits.append(F.when(of_host & path.startswith(f"/{rest}"), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def rule_verdict(rule: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    said = F.lit(None).cast("string")
    for verdict, name in rules:
        said = F.when(rule == name, verdict).otherwise(said)
    return said


@dataclass
class Level:
    """One Bloom filter: a one-row table `bits` of 64-bit words, and how keys map to it."""

    table: DataFrame
    number: int
    n_bits: int

    def positions(self, key: Column) -> list[Column]:
        first = F.shiftright(F.xxhash64(F.lit(self.number), key), 8)  # sums stay within 64 bits
        step = F.shiftright(F.xxhash64(key, F.lit(self.number)), 8)
        return [F.pmod(first + i * step, F.lit(self.n_bits)).cast("long") for i in range(HASHES)]

    def holds(self, key: Column) -> Column:
        """Whether the filter says yes; the words come as one scalar, not by a join."""
        words = self.table.scalar()
        said = F.lit(True)
        for at in self.positions(key):
            word = words[F.shiftright(at, 6).cast("int")]
            said &= F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1
        return said


def bloom(keys: DataFrame, count: int, number: int = 1) -> Level:
    """A Bloom filter of the `count` rows of `keys` (key), at most MOST_BITS large."""
    words = min(-(-max(count, 1) * BITS_PER_KEY // 64), MOST_BITS // 64)
    level = Level(keys, number, words * 64)
    spark = keys.sparkSession
    at = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("at"))
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    put = at.select(F.shiftright("at", 6).alias("word"), one.alias("bits"))
    empty = spark.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    filled = put.groupBy("word").agg(F.bit_or("bits").alias("bits")).unionByName(empty)
    filled = filled.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    row = F.sort_array(F.collect_list(F.struct("word", "bits")))
    level.table = parked(filled.agg(F.transform(row, lambda x: x["bits"]).alias("bits")), "level")
    return level


def cascade(keys: DataFrame) -> list[Level]:
    """Filters that together tell listed keys from all others of `keys` (key, listed).

    Odd levels encode listed keys, even levels the other keys that passed the level before,
    until none is left: for every key of the universe the answer is exact, whatever the size
    of the filters. Each key takes part in few levels, so the rounds soon run on next to
    nothing. A level is one array of at most MOST_BITS bits.
    """
    keys = keys.where("key is not null").select("key", "listed").distinct()
    inside, outside = keys.where("listed").select("key"), keys.where("not listed").select("key")
    levels: list[Level] = []
    inside = parked(inside, "keys")
    count = inside.count()
    while count:
        if len(levels) == MOST_LEVELS:
            raise ValueError(f"{count} keys left after {MOST_LEVELS} levels: raise MOST_BITS")
        level = bloom(inside, count, len(levels) + 1)
        levels.append(level)
        passed = parked(outside.where(level.holds(F.col("key"))), "keys")
        inside, outside, count = passed, inside, passed.count()
    return levels


def listed(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: the first level that denies it decides."""
    said = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        said = F.when(level.holds(key), said).otherwise(level.number % 2 == 0)
    return said


def listed_hosts(hosts: DataFrame, words: Sequence[str] = LISTED_WORDS) -> DataFrame:
    """(key, listed) for every different host: listed if a word of its name is."""
    found = F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, words)))
    return hosts.select("host").distinct().select(F.col("host").alias("key"), found.alias("listed"))


def judge(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    words: Sequence[str] = LISTED_WORDS,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    The longest rule that fits decides; else a listed host is blocked and the rest allowed,
    told by the cascade without a join. Null urls and urls without `://` have an empty host
    and path, fit no rule and are allowed. Repeated rows stay. An empty table gives an empty
    result. Other columns are not used or read.
    """
    rows = pick(pages, page_id=page_id, url=url)
    rows = rows.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rows = rows.fillna("", ["host", "path"])
    levels = cascade(parked(listed_hosts(rows, words), "hosts"))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), listed(levels, F.col("host")).alias("listed"))
    own = F.when(F.col("listed"), "block").otherwise("allow")
    verdict = F.coalesce(rule_verdict(F.col("rule"), rules), own)
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def exact_keys(spark: SparkSession, levels: list[Level], keys: DataFrame) -> DataFrame:
    """Keys for which the cascade and the list disagree: none, for keys of the universe."""
    return keys.where(listed(levels, F.col("key")) != F.col("listed"))


#: Twin of `judge` for DuckDB.
JUDGE_SQL = r"""
WITH rests AS (
    SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0
        THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rests
), rules AS (
    SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
        ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
    ) AS t(said, name, start)
), fits AS (
    SELECT p.*, r.name || r.start AS rule, said FROM (SELECT DISTINCT host, path FROM parts) p
    JOIN rules r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
    QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(name || start) DESC) = 1
)
SELECT page_id, p.host, p.path, rule, coalesce(said, CASE WHEN len(list_intersect(
        regexp_split_to_array(p.host, '[.-]'), ['ads', 'adult', 'bets', 'casino', 'pills', 'spam']
    )) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits USING (host, path)
"""
