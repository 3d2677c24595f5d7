"""Near copies against a direct reading of the contract."""

import re
from collections import defaultdict

import pytest
import xxhash

from castloom.llm import simhash
from castloom.llm.components import components
from tests.llm.cases import documents, empty, rows, words


def fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(found[i : i + 4]) for i in range(len(found) - 3)] or ([" ".join(found)] if found else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def expected(table):
    """component and number of links of each row, by all pairs."""
    prints = [fingerprint(r[1]) for r in table]
    distinct = sorted(set(prints))
    near = {a: [b for b in distinct if (a ^ b).bit_count() <= 4] for a in distinct}
    ids = defaultdict(list)
    for r, p in zip(table, prints, strict=True):
        ids[p].append(r[0])
    out, named = [], {}
    for p in distinct:
        seen, todo = {p}, [p]
        while todo:
            for q in near[todo.pop()]:
                if q not in seen:
                    seen.add(q)
                    todo.append(q)
        known = [i for q in seen for i in ids[q] if i is not None]
        named[p] = min(known) if known else None
    for r, p in zip(table, prints, strict=True):
        out.append((r[0], f"{p:016x}", named[p], len(near[p]) - 1))
    return out


def test_cases(spark):
    found = [tuple(r) for r in simhash.near_duplicates(documents(spark)).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected(rows())))


def test_blocks_of_long_texts(monkeypatch):
    text = words(11, 900)
    whole = simhash.fingerprint_of(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint_of(text) == whole
    assert whole % (1 << 64) == fingerprint(text)


@pytest.mark.parametrize(("distance", "blocks"), [(4, 8), (4, 7), (3, None), (0, None)])
def test_pairs_are_exact(spark, distance, blocks):
    import random

    rng = random.Random(5)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(6):
            for _ in range(rng.randint(1, 6)):
                base ^= 1 << rng.randrange(64)
            prints.add(base)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    found = [tuple(r) for r in simhash.close_pairs(df, distance=distance, blocks=blocks).collect()]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= distance}
    assert len(found) == len(set(found))
    assert set(found) == want


def test_components_of_a_long_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (None, 3)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(links, "a int, b int")).collect())
    assert found == {i: 100 for i in range(100, 161)} | {1000 + i: 1000 for i in range(50)}


def test_keep_one(spark):
    table = [r for r in rows() if not (r[1] or "").startswith("same id")]
    docs = documents(spark, table)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = {}
    for r, (_, told, component, _) in zip(table, expected(table), strict=True):
        p = int(told, 16)
        group = (component, component is None and p)
        own = (r[0] is None, r[0] or 0, p - (1 << 64) if p >> 63 else p)
        want[group] = min(want.get(group, own), own)
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, simhash.fingerprint_of(r["text"])) for r in kept.collect())
    assert found == sorted(want.values())


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []
    assert simhash.keep_one(empty(spark)).collect() == []
