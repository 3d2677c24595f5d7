"""Runs against a search over all periods, and planted ones."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

from castloom.llm import periodic_runs
from tests.llm.cases import documents, empty, rows, words


def slow_runs(w, least=6, times=4):
    """Maximal stretches of each period, if it is their smallest."""
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            piece = w[start:j]
            if length >= max(least, times * q) and not any(piece[p:] == piece[:-p] for p in range(1, q)):
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_sequences():
    rng = random.Random(3)
    for _ in range(3000):
        n, letters = rng.randint(0, 40), rng.randint(1, 4)
        w = [rng.randrange(letters) for _ in range(n)]
        if rng.random() < 0.5:
            at, q = rng.randint(0, n), rng.randint(1, 6)
            w[at:] = (w[at : at + q] or [0]) * rng.randint(2, 6)
        for least, times in ((6, 4), (2, 2), (4, 3)):
            found = sorted(periodic_runs.runs_of(w, least, times), key=lambda r: (r[0], r[2]))
            assert found == slow_runs(w, least, times)
        text = [b"%d" % x for x in w]
        assert periodic_runs.find(text) == slow_runs(w)


def test_fibonacci_word():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    found = sorted(periodic_runs.runs_of(b, 2, 2), key=lambda r: (r[0], r[2]))
    assert found == slow_runs(b, 2, 2)


def expected(doc_id, text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(found)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        found = [found[i] if i < a else found[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(found) if n < 3000 else periodic_runs.find([w.encode() for w in found])
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = (None,) * 4
    if runs:
        s, length, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (s, length, q, 1000 * length // q)
    told = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(found) if i not in gone)
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (told, kept)]
    return (doc_id, n, len(runs), *best, *digests)


def more_rows():
    rest = ("en", "s", 1, 1, True, 2, 3, "f", "key", "told", 4)
    table = [(i, words(i, 1 + 7 * i % 90), *rest) for i in range(100, 260)]
    return [*table, (300, "a b c " * 4 + "x " * 9 + "y x y x y x y", *rest), (None, "z " * 30, *rest)]


def test_cases(spark):
    table = rows() + more_rows()
    found = sorted(map(repr, map(tuple, periodic_runs.run_digests(documents(spark, table)).collect())))
    want = [expected(r[0], r[1]) for r in table]
    assert found == sorted(map(repr, want))
    assert sum(w[2] > 0 for w in want) > 8


def test_operator_gives_runs_and_texts(spark):
    table = [r for r in more_rows() if r[0] in (300, None)]
    found = {r["doc_id"]: r for r in periodic_runs.periodic_runs(documents(spark, table)).collect()}
    assert [tuple(r) for r in found[None]["runs"]] == [(0, 30, 1)] and found[None]["collapsed"] == "z"
    assert [tuple(r) for r in found[300]["runs"]] == [(0, 12, 3), (12, 9, 1), (20, 8, 2)]
    assert found[300]["collapsed"] == "a b c x y"


def test_long_repetitive_text_is_quick():
    assert periodic_runs.find([b"a"] * 100_000) == [(0, 100_000, 1)]


def test_empty(spark):
    assert periodic_runs.run_digests(empty(spark)).collect() == []
