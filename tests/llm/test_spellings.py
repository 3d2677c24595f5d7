"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from castloom.llm import spellings
from tests.llm.cases import documents, empty, rows, words


def counted(table, noise):
    found = Counter()
    for r in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{word}".encode())
            if noise and h % noise == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if is_near(v, w)]
        best = min(near, key=lambda v: (-counts[v], v.encode()), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = (form, n, len(near), counts.get(form))
    final = set()
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        final.add((w, form, root, n, n_near, form_n))
    return final


def check(spark, table, noise):
    found = spellings.group(spellings.vocabulary(documents(spark, table), noise=noise))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in found.collect()]
    want = grouped(counted(table, noise))
    assert len(got) == len(want) and set(got) == want
    return want


REST = ("en", "s", 1, 1, True, 2, 3, "f", "key", "told", 4)


def typos(seed, count):
    """Texts of few words, many of them misspelt once or twice, some letters outside a-z."""
    rng = random.Random(seed)
    known = [rng.choice(["", "é"]) + words(s, 1) + words(s + 99, 1) for s in range(40)]
    table = []
    for i in range(count):
        text = []
        for _ in range(60):
            w = list(rng.choice(known))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                kind = rng.randrange(3)
                if kind == 0:
                    w.insert(at, rng.choice("abcÿ"))
                elif kind == 1 and at < len(w):
                    w[at] = rng.choice("abcÿ")
                else:
                    del w[at : at + 1]
            text.append("".join(w))
        table.append((i, " ".join(text), *REST))
    return table


@pytest.mark.parametrize("noise", [None, 97, 3])
def test_cases(spark, noise):
    check(spark, rows(), noise)


def test_typos(spark):
    want = check(spark, typos(1, 120), 7)
    assert any(form and root != form for _, form, root, *_ in want)
    assert any(n_near > 3 for *_, n_near, _ in want)


def test_rare_letters_are_merged(spark, monkeypatch):
    monkeypatch.setattr(spellings, "MOST_LETTERS", 5)
    check(spark, typos(2, 60), 7)


def test_every_edit_is_found(spark):
    """All words at one edit from some, of lengths one to seven, repeated letters included."""
    made = {"a", "ab", "aa", "aba", "abcab", "aaaaa", "abcdefg", "ñandú", "日本語"}
    for w in list(made):
        for i in range(len(w) + 1):
            made |= {w[:i] + c + w[i:] for c in "abz語"} | {w[:i] + c + w[i + 1 :] for c in "abz語"}
    want = {(a, b) for a in made for b in made if a.encode() < b.encode() and is_near(a, b)}
    df = spark.createDataFrame([(w,) for w in made], "word string")
    got = [tuple(r) for r in spellings.near_words(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_empty(spark):
    assert spellings.group(spellings.vocabulary(empty(spark))).collect() == []
