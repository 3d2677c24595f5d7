"""Spelling variants: PartEnum signatures of letter multisets, equi-join, exact check."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castloom.llm.base import parked, pick

#: Runs of letters that are words.
LETTERS = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts that the letters are dealt to. Words within distance two differ in at most two parts.
PARTS, DISTANCE = 4, 2
#: Letters that are told apart; those less frequent count as one.
MOST_LETTERS = 200


def vocabulary(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shortest: int = 5,
    least: int = 3,
    noise: int | None = None,
) -> DataFrame:
    """(word, n): the words of all texts with at least `shortest` code points and `least`
    occurrences.

    Words are maximal runs of letters, A-Z lower-cased. With `noise`, a run loses one code
    point if noise divides the crc32 of `<doc_id>:<run>`; a null doc_id is written as nothing.
    Counts are reduced in each task before they are shuffled, so a frequent word costs no more
    than a rare one.
    """
    rows = pick(docs, doc_id=doc_id, text=text)
    runs = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(LETTERS), F.lit(0))
    told = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    words = rows.select(told.alias("told"), F.explode(runs).alias("word"))
    if noise:
        words = words.withColumn("h", F.crc32(F.concat("told", F.lit(":"), "word")))
        at = (F.col("h") % F.length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.withColumn("word", F.when(F.col("h") % noise == 0, less).otherwise(F.col("word")))
    counted = words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


def _parts(words: DataFrame) -> list[list[str]]:
    """Letters dealt to PARTS, the most frequent first, each to the lightest part.

    Frequencies are over all words; at most MOST_LETTERS rows come to the driver (the letters
    of `LETTERS` are 90).
    """
    letters = words.select(F.explode(F.split("word", "")).alias("letter"))
    counts = letters.groupBy("letter").agg(F.count("*").alias("n"))
    parts, loads = [[] for _ in range(PARTS)], [0] * PARTS
    for row in counts.orderBy(F.desc("n"), "letter").limit(MOST_LETTERS).collect():
        lightest = loads.index(min(loads))
        parts[lightest].append(row["letter"])
        loads[lightest] += row["n"]
    return parts


def _signatures(word: Column, parts: list[list[str]]) -> list[Column]:
    """The sorted letters of all parts but DISTANCE, for each choice of these.

    Letters that were not dealt count as the first letter of the first part: merged letters
    never bring multisets further apart.
    """
    stand_in = parts[0][0] if parts[0] else ""
    dealt = [letter for part in parts for letter in part]
    sorted_letters = F.array_join(
        F.array_sort(
            F.transform(
                F.split(word, ""),
                lambda c: F.when(c.isin(dealt), c).otherwise(F.lit(stand_in)) if dealt else c,
            )
        ),
        "",
    )
    return [
        F.translate(sorted_letters, "".join(x for part in left_out for x in part), "")
        for left_out in combinations(parts, DISTANCE)
    ]


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct `word`s that differ by one inserted, deleted or
    replaced code point. Each pair is there once, none is missed.

    As multisets of letters, that is as vectors with one bit for each letter and repeat, near
    words are at Hamming distance two at most. The letters are dealt to four parts; two parts
    at least are then equal, so near words share the signature of one choice of two parts
    (PartEnum with one partition on the first level). Anagrams share all; so the key has, next
    to the signature, a half of the word that the edit leaves alone: with m code points in the
    shorter word, the first m div 2 or the last m - m div 2. Each word is there as the shorter
    and as the longer one, in six signatures and two halves. The edit distance decides.
    """
    words = words.select("word").where("word is not null").distinct()
    parts = _parts(words)
    # Each row becomes many: spread them before, however small they are together.
    spread = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = words.repartition(spread, F.xxhash64("word"))
    size = F.length("word")
    cells = []
    for longer in (0, 1):
        m = size - longer
        half = F.call_function("div", m, F.lit(2)).cast("int")
        rest = m - half
        halves = (
            F.substring("word", F.lit(1), half),
            F.substring("word", (size - rest + 1).cast("int"), rest.cast("int")),
        )
        for choice in range(len(list(combinations(range(PARTS), DISTANCE)))):
            for side, piece in enumerate(halves):
                key = F.xxhash64(F.lit(choice), F.lit(side), m, piece, F.get("signatures", F.lit(choice)))
                cells.append(F.struct(key.alias("key"), F.lit(longer).alias("longer")))
    signed = words.withColumn("signatures", F.array(*_signatures(F.col("word"), parts)))
    grid = signed.select("word", F.explode(F.array(*cells)).alias("at")).select("word", "at.key", "at.longer")
    near = (
        (F.col("l.key") == F.col("r.key"))
        & (F.col("l.longer") <= F.col("r.longer"))
        & (
            (F.col("l.longer") < F.col("r.longer"))
            | ((F.col("l.longer") + F.col("r.longer") == 0) & (F.col("l.word") < F.col("r.word")))
        )
        & (F.levenshtein("l.word", "r.word", 1) == 1)
    )
    # Both sides are the same rows, dealt out once; Spark would take them for small.
    pairs = grid.alias("l").join(grid.alias("r").hint("merge"), near)
    return pairs.select(
        F.least("l.word", "r.word").alias("a"), F.greatest("l.word", "r.word").alias("b")
    ).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each row (word, form): the last form that forms lead to.

    Each form is at least twice as frequent as its word, so there are no circles. Chains are
    halved in every round: as many rounds as the logarithm of the longest.
    """
    known = parked(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        beyond = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = known.join(beyond, "root", "left")
        known = parked(longer.select("word", F.coalesce("further", "root").alias("root"), "further"), "roots")
        if known.where("further is not null").isEmpty():
            return known.select("word", "root")
        known = known.select("word", "root")


def group(words: DataFrame, times: int = 2) -> DataFrame:
    """One row per row (word, n): word, form, root, n, n_near, form_n.

    n_near is the number of near words (`near_words`). form is the most frequent of them (on
    ties the smallest in code point order) if it is at least `times` (over 1) as frequent as
    the word, else null; form_n its count. root is where forms lead to from the word, the word
    itself without one. Words must be distinct; null words stay alone. An empty table gives an
    empty result.
    """
    words = parked(words.select("word", "n"), "words")
    pairs = parked(near_words(words), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("b").alias("form"))).alias("best")
    found = both.join(words.withColumnRenamed("word", "b"), "b").groupBy("a").agg(F.count("*").alias("n_near"), best)
    rows = words.join(found.withColumnRenamed("a", "word"), "word", "left")
    often = -F.col("best.less")
    takes = often >= times * F.col("n")
    rows = parked(
        rows.select(
            "word",
            F.when(takes, F.col("best.form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(takes, often).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
