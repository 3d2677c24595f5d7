"""Periodic runs of words: suffix automaton, link-cut access, squares extended to runs."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from castloom.llm.base import pick

#: Texts that are turned into rows at a time.
BATCH = 100


def repeated(text: str | None, doc_id: int | None) -> list[bytes]:
    """The words of a text; of a tenth of the documents, by a hash of the id, the words from
    some place on are repeats of those there."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of words outside of which no run can lie.

    A run is at least four periods and six words long, so each three words in a row that it
    holds are there twice in it. A stretch is a maximal piece of at least six words in which
    all three in a row are somewhere else in the text too (by a hash: some may be kept in vain).
    """
    if len(ids) < 6:
        return []
    x = ids.astype(np.uint64)
    mixed = (x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return []
    again = np.zeros(len(mixed) + 2, bool)
    again[order[1:][same] + 1] = True
    again[order[:-1][same] + 1] = True
    edges = np.flatnonzero(again[1:] != again[:-1]).tolist()
    return [(a, b + 2) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= 4]


class Automaton:
    """Suffix automaton of a sequence of numbers; states are numbered, 0 is the root."""

    def __init__(self, word: list[int]) -> None:
        """`ends[i]` is the state of the prefix that ends at place i."""
        self.longest, self.link, self.ends = [0], [-1], []
        moves: list[dict[int, int]] = [{}]
        last = 0
        for place, letter in enumerate(word):
            state = self._new(place + 1, 0)
            moves.append({})
            at = last
            while at >= 0 and letter not in moves[at]:
                moves[at][letter] = state
                at = self.link[at]
            if at >= 0:
                to = moves[at][letter]
                if self.longest[to] > self.longest[at] + 1:
                    copy = self._new(self.longest[at] + 1, self.link[to])
                    moves.append(dict(moves[to]))
                    while at >= 0 and moves[at].get(letter) == to:
                        moves[at][letter] = copy
                        at = self.link[at]
                    self.link[to] = copy
                    to = copy
                self.link[state] = to
            self.ends.append(state)
            last = state

    def _new(self, longest: int, link: int) -> int:
        self.longest.append(longest)
        self.link.append(link)
        return len(self.link) - 1


class LastEnds:
    """The tree of suffix links, each node coloured with the place where it last ended.

    Nodes of one colour form paths. A path is a splay tree ordered by depth; its root knows the
    colour, and the node above the path. `access` makes the path from a node to the root of
    the tree one path of a new colour and tells which paths it was made of: O(log n) amortized.
    """

    def __init__(self, link: list[int]) -> None:
        self.up = list(link)
        self.left, self.right = [-1] * len(link), [-1] * len(link)
        self.colour = [-1] * len(link)

    def _turn(self, x: int) -> None:
        """Rotate x above the node over it, inside its path."""
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner >= 0:
            up[inner] = p
        up[p], up[x] = x, g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def _splay(self, x: int) -> None:
        """Make x the root of its path."""
        up, left, right = self.up, self.left, self.right
        first = x
        while (p := up[x]) >= 0 and (left[p] == x or right[p] == x):
            g = up[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                first = g
                self._turn(p if (left[g] == p) == (left[p] == x) else x)
            else:
                first = p
            self._turn(x)
        if x != first:
            self.colour[x] = self.colour[first]

    def access(self, node: int, colour: int) -> list[tuple[int, int, int]]:
        """(lowest node on the way, the node above the path or -1, colour) of each path met."""
        up, right, colours = self.up, self.right, self.colour
        met, below, x = [], -1, node
        while x >= 0:
            self._splay(x)
            if right[x] >= 0:
                colours[right[x]] = colours[x]
            right[x] = below
            met.append((x, up[x], colours[x]))
            below, x = x, up[x]
        colours[below] = colour
        return met


def runs_of(word: list[int], least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of at least `least` numbers and `times` (2 or more) periods.

    When a number is appended, the suffix of each length has a place where it ended before.
    Suffixes of one last end are a path from `low` to `high` in length; if the distance d to
    that end lies in between, the last 2d numbers are a square of a piece that is no power
    itself. Each run shows itself so at the end of its first square, and is extended from it.
    """
    automaton = Automaton(word)
    longest, ends = automaton.longest, LastEnds(automaton.link)
    found, known, n = [], {}, len(word)
    for place, state in enumerate(automaton.ends):
        for node, above, before in ends.access(state, place):
            period = place - before
            if before < 0 or period > longest[node] or period <= (longest[above] if above >= 0 else 0):
                continue
            if known.get(period, -1) >= place:
                continue
            start, end = place - 2 * period + 1, place
            while start and word[start - 1] == word[start - 1 + period]:
                start -= 1
            while end + 1 < n and word[end + 1] == word[end + 1 - period]:
                end += 1
            known[period] = end
            if end + 1 - start >= max(least, times * period):
                found.append((start, end + 1 - start, period))
    return found


def find(words: list[bytes]) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a text's words, by start, then period: at least six
    words and four periods long."""
    index: dict[bytes, int] = {}
    ids = [index.setdefault(w, len(index)) for w in words]
    if len(index) == len(ids):
        return []
    found = []
    for a, b in stretches(np.array(ids, np.int64)):
        found += [(start + a, length, period) for start, length, period in runs_of(ids[a:b])]
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what a run repeats after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop[:-1]).tolist(), strict=True) if not d]


def periodic_runs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repeat: bool = False
) -> DataFrame:
    """One row per document: doc_id, n_words, runs (array of start, length, period, in the order
    of start and period) and `collapsed`, the words without repeats, one space between them.

    A run is a stretch of words with smallest period q, at least six words and 4*q long, that
    can't be longer; words are numbered from 0. A word goes if a run holds it behind its first
    period. With `repeat`, a tenth of the texts is made periodic first (`repeated`); a null
    doc_id never is. Null and empty texts have no words, no runs and an empty `collapsed`.
    Repeated rows stay. Each document is judged on its own in one pass, without a shuffle;
    memory grows with the longest repetitive stretch of one text, about 1 KB a word. An empty
    table gives an empty result. Other columns are not used.
    """
    rows = pick(docs, doc_id=doc_id, text=text)
    kind = dict(rows.dtypes)["doc_id"]
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                counts, runs, kept = [], [], []
                for d, t in zip(part["doc_id"], part["text"], strict=True):
                    words = repeated(t.as_py(), d.as_py() if repeat else None)
                    found = find(words)
                    counts.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    kept.append(b" ".join(collapse(words, found)).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        pa.array(counts, pa.int64()),
                        pa.array(runs, pa.list_(run)),
                        pa.array(kept, pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    made = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return rows.mapInArrow(judge, f"doc_id {kind}, {made}")


def run_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_runs, the run of the greatest exponent (start,
    length, period, exponent_milli; four nulls without runs), runs_sha256, collapsed_sha256.

    The texts are those of `periodic_runs` with `repeat`.
    """
    rows = periodic_runs(docs, doc_id, text, repeat=True)
    kind = dict(rows.dtypes)["doc_id"]
    names = ("start", "length", "period", "exponent_milli")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, told = [], []
            for runs in batch["runs"].to_pylist():
                told.append("".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs))
                if not runs:
                    best.append((None,) * 4)
                    continue
                r = max(runs, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]))
                best.append((r["start"], r["length"], r["period"], 1000 * r["length"] // r["period"]))
            sha = [hashlib.sha256(t.encode()).hexdigest() for t in told]
            own = [
                hashlib.sha256(t.as_py().encode("utf-8", "surrogatepass")).hexdigest()
                for t in batch["collapsed"]
            ]
            columns = list(zip(*best, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["n_words"],
                    pa.array([t.count("\n") for t in told], pa.int64()),
                    *(pa.array(c, pa.int64()) for c in columns),
                    pa.array(sha, pa.string()),
                    pa.array(own, pa.string()),
                ],
                ["doc_id", "n_words", "n_runs", *names, "runs_sha256", "collapsed_sha256"],
            )

    return rows.mapInArrow(
        digest,
        f"doc_id {kind}, n_words bigint, n_runs bigint, {', '.join(f'{n} bigint' for n in names)}, "
        "runs_sha256 string, collapsed_sha256 string",
    )
