"""Small tables with every odd case: nulls, empty and long texts, ties, repeats, clashes."""

import random

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    # names that operators use for their own columns
    "fp bigint, kept boolean, size bigint, k1 bigint, f string, key string, told string, n int"
)


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


def texts() -> list[str | None]:
    long = words(1, 20_000)
    return [
        None,
        "",
        " \t\n\x0b\x0c\r ",
        "x",
        "One two",
        "one\ttwo",
        "ONE  TWO",
        words(2, 60),
        words(2, 60) + " end",
        words(2, 59) + " other",
        words(3, 400),
        words(3, 400),
        words(4, 30) + "\n" + words(3, 400) + "\n" + words(5, 30),
        long,
        long[:60_000] + " cut " + long[60_000:],
        "a" * 5000,
        "ab " * 2000,
        "Ä ö ß ç x " + words(6, 20) + " ñ日本語 😀",
        "line one here\nline one here\n\nline one here\n" + words(7, 20),
        "### $$$ | | | %%% &&& " + words(8, 12),
        "mail a.b@c.example.com, @no.local@x.example.org or +1 (212) 555-0147 at 10.0.0.255 4111 1111 1111 1111",
        "0 " * 300,
    ]


def rows() -> list[tuple]:
    rest = (None, 1, True, 2, 3, "f", "key", "told", 4)
    out = []
    for i, text in enumerate(texts()):
        lang, source = (None, "en", "de")[i % 3], (None, "s1", "s2", "s1")[i % 4]
        out.append((i, text, lang, source, *rest))
    out.append((10, words(3, 400), "de", "s2", *rest))  # a repeated row
    out.append((7, "same id, other text " + words(9, 30), "en", "s1", *rest))
    out.append((None, words(10, 40), None, None, *rest))
    out.append((None, words(2, 60), "en", "s1", *rest))
    return out


def documents(spark, only=None):
    return spark.createDataFrame(rows() if only is None else only, SCHEMA).repartition(4)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
