"""Quality features and thresholds against plain Python."""

import re
from collections import Counter

from castloom.llm import quality
from castloom.llm.quality import METRICS, TWO_SIDED
from tests.llm.cases import documents, empty, rows, words


def features(text):
    t = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", t)
    five = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    many = Counter(five)
    covered = {i + k for i, w in enumerate(five) if many[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (
        len(found),
        sum(map(len, found)),
        len(re.findall(r"[#*$%&|<>]", t)),
        dup,
        len(covered),
        len(re.findall("[A-Z]", t)),
    )


def verdicts(table, widths=quality.WIDTHS, least=quality.LEAST_DOCUMENTS):
    """(base_failed, kept) of each row."""
    made, values = [features(r[1]) for r in table], []
    failed = [f[0] < 10 or 100 * f[4] > 20 * f[0] for f in made]
    for f in made:
        named = dict(zip(quality.FEATURES, f, strict=True))
        values.append({m: 1000 * named[c] // max(f[0], 1) for m, (c, _) in METRICS.items()})
    groups = Counter((r[2], r[3]) for r, bad in zip(table, failed, strict=True) if not bad)
    langs = Counter(r[2] for r, bad in zip(table, failed, strict=True) if not bad)
    kept = []
    for r, bad, own in zip(table, failed, values, strict=True):
        if groups[r[2], r[3]] >= least:
            pool = lambda x: x[2:4] == r[2:4]
        elif langs[r[2]] >= least:
            pool = lambda x: x[2] == r[2]
        else:
            pool = lambda x: True
        good = not bad
        for m, (_, percent) in METRICS.items() if good else ():
            edges = sorted(
                (v[m] >> s) << s
                for x, b, v in zip(table, failed, values, strict=True)
                if not b and pool(x)
                for s in [max(0, v[m].bit_length() - 6)]
            )
            low, mid, high = (
                next(e for i, e in enumerate(edges, 1) if 100 * i >= p * len(edges))
                for p in (100 - percent, 50, percent)
            )
            good &= own[m] <= high + widths * (high - mid)
            good &= m not in TWO_SIDED or own[m] >= low - widths * (mid - low)
        kept.append(good)
    return made, failed, kept


def test_cases(spark):
    found = sorted(map(repr, (tuple(r) for r in quality.judge(documents(spark)).collect())))
    made, failed, kept = verdicts(rows())
    want = [(r[0], *f, b, k) for r, f, b, k in zip(rows(), made, failed, kept, strict=True)]
    assert found == sorted(map(repr, want))


def test_pools_by_size(spark):
    table = rows() * 4
    base = documents(spark, table)
    f = base.select("doc_id", "lang", "source", quality.features(base["text"]).alias("f"))
    limits = quality.thresholds(quality.sketch(f), least=6)
    judged = quality._judged(f.withColumnRenamed("f", "__f"), limits, "lang", "source")
    found = Counter((r["doc_id"], r["__kept"]) for r in judged.collect())
    _, _, kept = verdicts(table, least=6)
    assert found == Counter(zip((r[0] for r in table), kept, strict=True))


def test_keep_agrees_with_judge(spark):
    docs = documents(spark)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    want = Counter(r["doc_id"] for r in quality.judge(docs).where("kept").collect())
    assert Counter(r["doc_id"] for r in kept.collect()) == want


def test_empty(spark):
    assert quality.judge(empty(spark)).collect() == []
    assert quality.keep(empty(spark)).collect() == []


def _outliers():
    """Texts that pass the base rules, and the metric that one of each alone is far out in."""
    plain = words(900, 120).replace("\n", " ").lower().split()
    lines = [" ".join(plain[i : i + 4]) for i in range(0, 60, 4)]
    return {
        "long words": " ".join(w * 6 for w in plain),
        "short words": " ".join(w[0] + str(i % 7) for i, w in enumerate(plain)),
        "symbols": " ".join(f"{w} ## $" for w in plain),
        "dup lines": "\n".join(x for i, line in enumerate(lines) for x in (line, f"the {plain[0]}")[: 1 + (i > 4)]),
        "repeats": " ".join([*plain, *plain[10:20]]),
        "capitals": " ".join(plain).upper(),
    }


def test_an_outlier_of_each_metric_goes(spark):
    usual = [(i, words(1000 + i, 120), "en", f"src{i % 2}") for i in range(240)]
    odd = [(1000 + i, t, "en", "src0") for i, t in enumerate(_outliers().values())]
    df = spark.createDataFrame([*usual, *odd], "doc_id bigint, text string, lang string, source string")
    found = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judge(df).collect()}
    assert [found[r[0]] for r in odd] == [(False, False)] * len(odd)
    assert sum(found[r[0]][1] for r in usual) >= 238
    # The same texts stay where they are usual: no constant decides.
    many = [(i, words(2000 + i, 120).upper(), "en", "loud") for i in range(120)]
    loud = spark.createDataFrame([*usual, *many], df.schema)
    assert all(r["kept"] for r in quality.judge(loud).where("source = 'loud'").collect())
