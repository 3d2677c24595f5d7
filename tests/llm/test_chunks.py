"""Chunks: whole, stable under insertions, and the repeats they find."""

import hashlib
import os.path
from collections import Counter

from castloom.llm import chunks
from tests.llm.cases import documents, empty, rows, words


def slow_boundaries(raw):
    """The gear hash byte by byte."""
    ends, start, h = [], 0, 0
    starts = lambda at: at >= len(raw) or raw[at] & 0xC0 != 0x80
    for i, byte in enumerate(raw):
        h = (2 * h + int(chunks.GEAR[byte])) % (1 << 32)
        at = i + 1
        due = h < (1 << 32) // chunks.EVERY and at - start >= chunks.LEAST
        if at < len(raw) and starts(at) and (due or at - start >= chunks.MOST):
            ends.append(at)
            start = at
    return [*ends, len(raw)] if raw else []


def test_boundaries():
    for row in rows():
        raw = (row[1] or "").encode()[:30_000].decode(errors="ignore").encode()
        ends = chunks.boundaries(raw)
        assert ends == slow_boundaries(raw)
        pieces = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        assert b"".join(pieces) == raw
        for p in pieces:
            p.decode()


def test_insertions_shift_few_chunks():
    text = words(20, 2000).encode()
    before = Counter(chunks.chunk_digests(text)[1])
    after = Counter(chunks.chunk_digests(text[:3000] + b"inserted words" + text[3000:])[1])
    assert sum((before - after).values()) <= 4


def expected(table):
    """By a table of all chunks."""
    texts = {(r[0], r[1] or "") for r in table}
    holders = {}
    for doc, text in texts:
        for d in set(chunks.chunk_digests(text.encode())[1]):
            holders.setdefault(d, []).append((doc is None, doc or 0, text))
    out = []
    for r in table:
        raw, own = (r[1] or "").encode(), (r[0] is None, r[0] or 0, r[1] or "")
        ends, digests = chunks.chunk_digests(raw)
        many, seen, shared, again = Counter(digests), set(), [], []
        for d in digests:
            shared.append(len(holders[d]) > 1 or many[d] > 1)
            again.append(d in seen or min(holders[d])[:2] != own[:2])
            seen.add(d)
        spans = chunks.long_runs(ends, again)
        common = sum(a < e <= b for a, b in chunks.long_runs(ends, shared) for e in ends)
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + raw[at:a], b
        kept += raw[at:]
        out.append((r[0], len(raw), len(ends), common, len(raw) - len(kept), len(spans), kept.decode(), hashlib.sha256(kept).hexdigest()))
    return out


def test_cases(spark):
    found = [tuple(r) for r in chunks.dedupe(documents(spark)).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected(rows())))


def test_planted_passages_go_once(spark):
    passage = words(30, 60)
    table = [(i, f"{words(100 + i, 80)} {passage} {words(200 + i, 80)}") for i in range(30)]
    table += [(i, words(300 + i, 200)) for i in range(30, 60)]
    df = spark.createDataFrame(table, "doc_id bigint, text string")
    for r in chunks.dedupe(df).collect():
        assert (r["n_dup_chunks"] > 0) == (r["doc_id"] < 30)
        assert (r["n_removed"] > 0) == (0 < r["doc_id"] < 30)


def test_passages_of_51_words_at_any_place(spark):
    """Nothing here but the texts decides what must go: each pair shares one passage."""
    passages = [words(100_000 + i, 51) for i in range(1200)]
    table = []
    for i, p in enumerate(passages):
        table.append((2 * i, f"{words(200_000 + i, 5 + i % 61)} {p} {words(300_000 + i, 20)}"))
        table.append((2 * i + 1, f"{words(400_000 + i, 7 + i % 53)} {p} {words(500_000 + i, 25)}"))
    table += [(10_000 + i, words(600_000 + i, 150)) for i in range(200)]
    df = spark.createDataFrame(table, "doc_id bigint, text string")
    gone = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in chunks.dedupe(df).collect()}
    caught = sum(gone[2 * i + 1][0] > 0 for i in range(1200))
    assert caught >= 0.99 * 1200
    assert all(gone[2 * i][0] == 0 for i in range(1200)) and all(gone[10_000 + i][0] == 0 for i in range(200))
    for i, p in enumerate(passages):
        removed, kept = gone[2 * i + 1]
        before, text = (table[2 * i + side][1].split(f" {p} ") for side in (0, 1))
        # What goes lies inside the passage and the letters beside it that agree by chance.
        left = len(os.path.commonprefix([before[0][::-1], text[0][::-1]]))
        right = len(os.path.commonprefix([before[1], text[1]]))
        assert removed <= left + len(p) + 2 + right
        assert kept.startswith(text[0][: len(text[0]) - left])
        assert kept.endswith(text[1][right:])


def test_copies_of_short_texts_go(spark):
    short = ["x", "two words", "Ein Satz."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(short * 3)], "doc_id bigint, text string")
    for r in chunks.dedupe(df).collect():
        assert r["kept_text"] == (short[r["doc_id"]] if r["doc_id"] < 3 else "")


def test_empty(spark):
    assert chunks.dedupe(empty(spark)).collect() == []
