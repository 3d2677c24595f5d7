"""Repeated byte strings over all documents, by bucket-pointer refinement.

A suffix belongs to the bucket of its first bytes. Buckets of short strings are built first;
a bucket is refined by the buckets that its suffixes have at later offsets, and what one
round has told apart is reused by the next, until strings of the wanted length are told apart.
Here a bucket's name is a hash of its string, so the bucket at a later offset is known where
the text is, and only buckets with more than one member ever meet in a shuffle.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castloom.llm.base import parked, pick
from castloom.llm.url_cascade import bloom

#: Bytes of a repeated string, and of the strings of the first buckets.
LENGTH, GRAM = 400, 64
#: Starts that a later round tells apart together.
STEP = 16
#: Starts of one text that are worked on at a time: bounds memory for very long texts.
BLOCK = 1 << 20

_random = np.random.default_rng(20)
_BYTES = _random.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _random.integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def buckets(codes: np.ndarray, gram: int) -> np.ndarray:
    """The bucket of the `gram` bytes at each place (a power of two), by doubling: the bucket
    of twice the length follows from those at a place and at the offset behind it."""
    h, width = _BYTES[codes], 1
    while width < gram:
        h = h[:-width] * _STEPS[width.bit_length()] + h[width:]
        width *= 2
    return (h ^ (h >> np.uint64(32))) * _STEPS[0]


def _runs(h: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(place, first, last): the place of the lowest of `width` values, the first of equals,
    for the windows that start from first to last.

    Low values are enough to look at, unless some window holds none of them.
    """
    windows = len(h) - width + 1
    low = np.flatnonzero(h < np.uint64(1 << 60))
    edges = np.concatenate([[-1], low, [len(h)]])
    if (np.diff(edges) > width).any():
        low = np.arange(len(h))
    values = h[low].tolist()
    # Between the last value not above it and the next one below, a value is the lowest.
    after, before, stack = [len(low)] * len(low), [-1] * len(low), []
    for i, value in enumerate(values):
        while stack and values[stack[-1]] > value:
            after[stack.pop()] = i
        if stack:
            before[i] = stack[-1]
        stack.append(i)
    places = np.concatenate([low, [len(h)], [-1]])  # behind the last one, before the first one
    first = np.maximum(places[before] + 1, low - width + 1)
    last = np.minimum(np.minimum(places[after] - width, low), windows - 1)
    first = np.maximum(first, 0)
    some = first <= last
    return low[some], first[some], last[some]


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(bucket, anchor, first, last) for runs of starts that share an anchor.

    The anchor of a string of `length` bytes is its gram with the lowest bucket, the first of
    equals. It depends on the string alone, so equal strings have equal anchors at equal
    offsets, and only strings whose anchors share a bucket need to be compared.
    """
    codes, found = np.frombuffer(raw, np.uint8), []
    for start in range(0, len(codes) - length + 1, BLOCK):
        h = buckets(codes[start : start + BLOCK + length - 1], gram)
        at, first, last = _runs(h, length - gram + 1)
        found.append([h[at], at + start, first + start, last + start])
    if not found:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    bucket, anchor, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
    new = np.ones(len(anchor), bool)  # a run that a block border has cut is one again
    new[1:] = anchor[1:] != anchor[:-1]
    heads = np.flatnonzero(new)
    ends = np.concatenate([heads[1:], [len(anchor)]]) - 1
    return bucket[heads], anchor[heads], first[heads], last[ends]


def entries(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int, int]]:
    """(bucket, offsets, name, first) of each run. offsets packs how far before the anchor the
    run's strings start; name is the hash of all bytes that they cover."""
    bucket, anchor, first, last = anchors(raw, length, gram)
    digest, view = xxhash.xxh3_64_intdigest, memoryview(raw)
    names = [digest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    offsets = ((anchor - last) << 16) | (anchor - first)
    names = np.array(names, np.uint64).view(np.int64).tolist()
    return list(zip(bucket.view(np.int64).tolist(), offsets.tolist(), names, first.tolist(), strict=True))


def _bytes(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = np.array(rows, np.int64).reshape(-1, len(names)).T
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], list(names))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _keyed(rows: DataFrame, text: Column) -> DataFrame:
    """Two independent hashes name a text."""
    return rows.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(7), text)})


def _entry_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Each different entry of a text once; many = 1 if the text has it more often."""
    names = ("bucket", "offsets", "name", "first", "many", "k1", "k2")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            rows = []
            for text, k1, k2 in zip(part["text"], part["k1"].to_pylist(), part["k2"].to_pylist(), strict=True):
                own = entries(_bytes(text), length, gram)
                count = Counter(e[:3] for e in own)
                for e in own:
                    if n := count.pop(e[:3], 0):
                        rows.append((*e, int(n > 1), k1, k2))
            yield _table(rows, names)

    return texts.mapInArrow(read, ", ".join(f"{n} bigint" for n in names))


def _span_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes of the entries that `wanted` lists for a text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            rows, spans = [], []
            for text, wanted, k1, k2 in zip(
                part["text"], part["wanted"].to_pylist(), part["k1"].to_pylist(), part["k2"].to_pylist(), strict=True
            ):
                raw, missing = _bytes(text), {(w["bucket"], w["offsets"], w["name"]) for w in wanted}
                for bucket, offsets, name, first in entries(raw, length, gram):
                    if (bucket, offsets, name) in missing:
                        missing.discard((bucket, offsets, name))
                        size = (offsets & 0xFFFF) - (offsets >> 16)
                        rows.append((bucket, offsets, name, first, k1, k2))
                        spans.append(raw[first : first + size + length])
            batch = _table(rows, ("bucket", "offsets", "name", "first", "k1", "k2"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(spans, pa.binary())], [*batch.schema.names, "span"]
            )

    return texts.mapInArrow(
        read,
        "bucket bigint, offsets bigint, name bigint, first bigint, k1 bigint, k2 bigint, span binary",
    )


def _steps(spans: DataFrame, length: int) -> DataFrame:
    """Starts of an entry in steps of STEP: core is the hash of the bytes that all strings of
    the step share, part that of all bytes they cover, lo and hi the step's offsets."""
    names = ("bucket", "step", "core", "part", "lo", "hi", "at", "k1", "k2")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in _slices(batches, 1000):
            rows = []
            columns = (batch[c].to_pylist() for c in ("bucket", "offsets", "first", "k1", "k2", "span"))
            for bucket, offsets, first, k1, k2, span in zip(*columns, strict=True):
                least, most = offsets >> 16, offsets & 0xFFFF
                for step in range(least // STEP, most // STEP + 1):
                    low = step * STEP
                    lo, hi = max(least, low), min(most, low + STEP - 1)
                    core = signed(digest(span[most - low : most - low - STEP + 1 + length]))
                    part = signed(digest(span[most - hi : most - lo + length]))
                    rows.append((bucket, step, core, part, lo, hi, first + most - hi, k1, k2))
            yield _table(rows, names)

    return spans.mapInArrow(read, ", ".join(f"{n} bigint" for n in names))


def _windows(steps: DataFrame, length: int) -> DataFrame:
    """Every string of the steps in `wanted`: (bucket, offset, string, at, k1, k2)."""
    names = ("bucket", "offset", "string", "at", "k1", "k2")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in _slices(batches):
            rows = []
            columns = (batch[c].to_pylist() for c in ("bucket", "offsets", "first", "k1", "k2", "span", "wanted"))
            for bucket, offsets, first, k1, k2, span, wanted in zip(*columns, strict=True):
                most = offsets & 0xFFFF
                for w in wanted:
                    for offset in range(w["lo"], w["hi"] + 1):
                        name = digest(span[most - offset : most - offset + length])
                        name -= (1 << 64) if name >> 63 else 0
                        rows.append((bucket, offset, name, first + most - offset, k1, k2))
            yield _table(rows, names)

    return steps.mapInArrow(read, ", ".join(f"{n} bigint" for n in names))


def _maybe(keys: DataFrame, key: str) -> Column:
    """Whether `keys` may hold a text's k1: texts that it surely lacks need not be moved. A
    filter of bounded size; the join behind it decides."""
    return bloom(keys.select(F.col(key).alias("key")), keys.count()).holds(F.col("k1"))


def _repeats(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(k1, k2, kind, a, b): what in a text is repeated elsewhere.

    kind 1: the entry that starts at a; kind 2: the strings that start from a to b.
    """
    rows = parked(_entry_rows(texts, length, gram), "rows")
    entry = ["bucket", "offsets", "name"]
    found = rows.groupBy(*entry).agg(
        F.min("k1").alias("lo"), F.max("k1").alias("hi"), F.max("many").alias("many")
    )
    found = found.withColumn("again", (F.col("lo") != F.col("hi")) | (F.col("many") == 1))
    # A bucket with one entry is settled: all alike, or alone. Others go on to the next round,
    # each different entry once, whatever the number of its copies.
    mixed = found.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    found = parked(found.where("again").select(*entry, "lo", "again").unionByName(
        found.where("not again").join(mixed, "bucket").select(*entry, "lo", "again")
    ), "entries")
    alike = rows.join(found.where("again").select(*entry), entry).select(
        "k1", "k2", F.lit(1).alias("kind"), F.col("first").alias("a"), F.col("first").alias("b")
    )
    alone = found.where("not again").select("bucket").distinct()
    open_ = found.join(alone, "bucket").select(F.col("lo").alias("of"), *entry)
    wanted = parked(open_.groupBy("of").agg(F.collect_list(F.struct(*entry)).alias("wanted")), "wanted")
    spans = _span_rows(
        texts.where(_maybe(wanted, "of"))
        .join(wanted, F.col("k1") == F.col("of"))
        .select("text", "k1", "k2", "wanted"),
        length,
        gram,
    )
    spans = parked(spans.dropDuplicates(entry), "spans")

    steps = parked(_steps(spans, length), "steps")
    step, part = ["bucket", "step", "core"], ["bucket", "step", "core", "part", "lo", "hi"]
    parts = steps.groupBy(*part).agg(
        F.count("*").alias("n"), F.min("k1").alias("k1"), F.min("k2").alias("k2"), F.min("at").alias("at")
    )
    same = steps.join(parts.where("n > 1").select(*part), part).select(
        "k1", "k2", F.lit(2).alias("kind"), F.col("at").alias("a"), (F.col("at") + F.col("hi") - F.col("lo")).alias("b")
    )
    unlike = parts.groupBy(*step).agg(F.count("*").alias("m")).where("m > 1").select(*step)
    # One member of each part is enough; of a part with one member that is the member itself.
    member = F.min(F.struct("k1", "k2", "at")).alias("member")
    members = steps.join(unlike, step).groupBy(*part).agg(member).select(*part, "member.*")
    start = F.col("at") + F.col("hi")
    members = members.withColumn("anchor", start).groupBy("k1", "k2", "bucket", "anchor").agg(
        F.collect_list(F.struct("lo", "hi")).alias("wanted")
    )
    of_span = spans.withColumn("anchor", F.col("first") + F.col("offsets").bitwiseAND(F.lit(0xFFFF)))
    windows = _windows(
        of_span.join(members, ["k1", "k2", "bucket", "anchor"]).select(
            "bucket", "offsets", "first", "k1", "k2", "span", "wanted"
        ),
        length,
    )
    windows = parked(windows, "windows")
    string = ["bucket", "offset", "string"]
    twice = windows.groupBy(*string).agg(F.count("*").alias("n")).where("n > 1").select(*string)
    last = windows.join(twice, string).select(
        "k1", "k2", F.lit(2).alias("kind"), F.col("at").alias("a"), F.col("at").alias("b")
    )
    return alike.unionByName(same).unionByName(last)


def _spans_of(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings whose starts are given."""
    spans: list[tuple[int, int]] = []
    for a, b in sorted(starts):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], b + length))
        else:
            spans.append((a, b + length))
    return spans


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    Removed is each byte covered by a string of `length` bytes that also starts anywhere else
    in any document, the same included; overlaps count, and all is judged on the input. kept
    is what is left, as bytes, for a cut may fall into a character. Null texts count as empty,
    shorter texts than `length` lose nothing, documents with equal texts of at least `length`
    bytes lose all. Repeated rows and rows with equal or null ids are documents of their own.
    An empty table gives an empty result. Other columns are not used. `gram` is a power of two
    and at most half of `length`.

    1. Grams are the first buckets. Of the grams of each string one is its anchor.
    2. Runs of strings around an anchor are told apart by all their bytes.
    3. Where a bucket holds different runs, steps of STEP strings are told apart, among those
       whose common bytes agree.
    4. Where such a step holds different parts, single strings are.
    Each round takes one member of every class of equals and only buckets that differ inside,
    so large groups of copies shrink to one member before they are compared. No text is sent
    to another one; texts move by their own hash, to meet what was found in them.
    """
    rows = pick(docs, doc_id=doc_id, text=text)
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    texts = _keyed(rows, F.col("text"))
    copied = texts.groupBy("k1", "k2").count().where("count > 1")
    whole = copied.select("k1", "k2", F.lit(0).alias("kind"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    # A copied text goes as a whole: nothing else needs to be told to its many rows.
    repeats = _repeats(texts.select("text", "k1", "k2"), length, gram)
    told = whole.unionByName(repeats.join(copied.select("k1", "k2"), ["k1", "k2"], "left_anti"))
    told = told.groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "a", "b")).alias("told"))
    told = parked(told, "told")
    found = _maybe(told, "k1")
    moved = texts.where(found).join(told, ["k1", "k2"], "left").select("doc_id", "text", "told")
    others = texts.where(~found).select("doc_id", "text", F.lit(None).cast(told.schema["told"].dataType).alias("told"))
    kind = dict(rows.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            numbers, kept = [], []
            for text, told in zip(part["text"], part["told"].to_pylist(), strict=True):
                raw, spans = _bytes(text), []
                told = told or ()
                if len(raw) >= length and any(t["kind"] == 0 for t in told):
                    spans = [(0, len(raw))]
                elif told:
                    starts = [(t["a"], t["b"]) for t in told if t["kind"] == 2]
                    known = {t["a"] for t in told if t["kind"] == 1}
                    if known:
                        own = entries(raw, length, gram)
                        alike = {e[:3] for e in own if e[3] in known}
                        for e in own:
                            if e[:3] in alike:
                                size = (e[1] & 0xFFFF) - (e[1] >> 16)
                                starts.append((e[3], e[3] + size))
                    spans = _spans_of(starts, length)
                pieces, at = [], 0
                for a, b in spans:
                    pieces.append(raw[at:a])
                    at = b
                left = b"".join([*pieces, raw[at:]])
                kept.append(left)
                numbers.append((len(raw), len(raw) - len(left), len(spans)))
            batch = _table(numbers, ("n_bytes", "n_removed", "n_spans"))
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"],
                    *batch.columns,
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    pa.array(kept, pa.binary()),
                ],
                ["doc_id", *batch.schema.names, "kept_sha256", "kept"],
            )

    return moved.unionByName(others).mapInArrow(
        cut,
        f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, "
        "kept_sha256 string, kept binary",
    )


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same by a table of all strings, for tests."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])) == 1)
        left = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((len(r), int(gone.sum()), len(edges), hashlib.sha256(left).hexdigest()))
    return out
