"""Fixed patterns against the plain expressions; the field on lines it has not seen."""

import random
import re
import time

import numpy as np

from castloom.llm import pii
from tests.llm.cases import documents, empty, rows

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and check(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PLAIN).index(s[0]), s[2]))


def check(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def test_patterns():
    rng = random.Random(4)
    parts = ["a", "Z9", "@", "@@", ".", "..", "-", "+", "+1", " ", "  ", "(", ")", "0", "25", "255", "256", "4111111111111111", "4111 1111", "x@y.z", "%", "é", "\n", "1.2.3.4", "00001"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert pii.base_spans(text) == plain(text), text
    for row in rows():
        if row[1] and len(row[1]) < 3000:
            assert pii.base_spans(row[1]) == plain(row[1])


def test_long_runs_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "@" * 200_000, "+" * 200_000, "1." * 100_000, "+1" + " " * 200_000):
        pii.find([text], pii.Field())


def test_many_number_words_are_linear(spark):
    model = pii.fit(documents(spark))
    took = []
    for n in (8_000, 32_000):
        text = "call 212-555-0147 or a@b.example.org " * (n // 4)
        start = time.process_time()
        found = pii.find([text, " ".join(["212-555-0147"] * n)], model)
        took.append(time.process_time() - start)
        assert len(found[0][1]) == n // 2
    assert took[1] < 10 * took[0]


def test_covered_is_the_first_span_that_meets():
    rng = random.Random(3)
    for _ in range(2000):
        spans = [(rng.choice(pii.KINDS), a, a + rng.randint(1, 6)) for a in rng.choices(range(30), k=rng.randint(0, 6))]
        covered, start = pii.Covered(spans), rng.randrange(34)
        end = start + rng.randint(1, 5)
        meets = [s for s in covered.spans if s[1] < end and s[2] > start]
        assert covered.first(start, end) == (meets[0] if meets else None)


def test_words_around_a_run_and_a_labelled_table(spark):
    run, second = pii.runs_of("Please Call: 555 123 now (or) 7")
    assert (run.before, run.words, run.after) == ("Call:", ["555", "123"], "now")
    assert (second.before, second.after) == ("(or)", "")
    assert "cue call" in run.features()[1] and "then now" in run.features()[0]
    # Only the word before tells these apart: the field of the caller's own table knows it.
    lines = [f"{cue} {n} today" for n in ("5550147", "9081726", "4417263") for cue in ("order", "room")]
    lines += [f"dial [phone 55{n} 01{n}7] today" for n in (12, 37, 88, 45)] + [f"order 55{n} 01{n}7 today" for n in (12, 37, 88, 45)]
    table = spark.createDataFrame([(x, "k") for x in [*lines, None]], "line string, key string")
    model = pii.fit(empty(spark), lines=table)
    (_, dialled), (_, ordered) = pii.find(["dial 5561 01777 today", "order 5561 01777 today"], model)
    assert dialled == [("phone", 5, 15)] and ordered == []


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    field = pii.Field({"x": 0}, rng.normal(size=(2, 9)), rng.normal(size=(9, 9)), rng.normal(size=9), rng.normal(size=9))
    runs = [pii.Run(["1"] * n, [(0, 1)] * n) for n in (1, 2, 3, 4, 2)]
    field.index = {f: i % 2 for r in runs for w in r.features() for i, f in enumerate(w)}
    field.weights = rng.normal(size=(3, 9))
    field.index = {f: min(i, 1) for i, f in enumerate(sorted(field.index))}
    from itertools import product

    for run, got in zip(runs, field.decode(runs, cells=4), strict=True):
        scores = np.zeros((len(run.words), 9))
        for i, word in enumerate(run.features()):
            scores[i] = sum(field.weights[field.index.get(f, len(field.index))] for f in word)

        def value(path, scores=scores):
            own = sum(scores[i, x] for i, x in enumerate(path)) + field.first[path[0]] + field.last[path[-1]]
            return own + sum(field.steps[a, b] for a, b in zip(path, path[1:], strict=False))

        best = max(product(range(9), repeat=len(run.words)), key=value)
        assert np.isclose(value(best), value(got))


def test_training_raises_the_likelihood_and_generalises(spark):
    model = pii.fit(documents(spark))
    rng, right = random.Random(8), 0
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    unseen = [("phone", f"({d(3)}) 555-{d(4)}") for _ in range(40)] + [("phone", f"{rng.randint(200, 999)}-555-{d(4)}") for _ in range(40)]
    for kind, value in unseen:
        text = f"please reach us {value} any day"
        found = pii.find([text], model)[0][1]
        right += any(k == kind and text[a:b] == value for k, a, b in found)
    assert right >= 0.9 * len(unseen)
    clean = [f"in {rng.randint(1900, 2030)} we sold {d(3)} of {d(2)}.{d(2)} on page {d(2)}" for _ in range(80)]
    wrong = sum(bool(a) for _, a in pii.find(clean, model))
    assert wrong <= 4


def test_detect_and_redact(spark):
    docs = documents(spark)
    out = {repr(r["doc_id"]) + r["spans"]: r for r in pii.detect(docs).collect()}
    assert pii.detect(docs).count() == len(rows())
    row = next(r for r in out.values() if r["n_email"])
    assert (row["n_email"], row["n_ip"], row["n_phone"]) == (2, 1, 1)
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows())
    text = next(r["text"] for r in clean.collect() if (r["text"] or "").startswith("mail"))
    assert "a.b@c.example.com" not in text and "555-0147" not in text and "[EMAIL]" in text
    assert sum(r["text"] is None for r in clean.collect()) == 1
    assert pii.redacted("ab cd ef", [("ip", 0, 2), ("card", 3, 7), ("phone", 4, 8)]) == "[IP] [CARD]"


def test_empty(spark):
    assert pii.detect(empty(spark)).collect() == []
    assert pii.redact(empty(spark)).collect() == []
