"""SentencePiece models on the tokenizers library: encode, decode, verify parity."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from castloom.llm.base import pick

#: The marker that stands for a blank.
SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
#: Different segments that a task remembers before it starts anew.
MOST_KNOWN = 400_000
#: New segments encoded at a time.
AT_ONCE = 10_000
#: Documents encoded at a time, and threads that encode in each task.
ROWS, THREADS = 500, 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message; fixed ones as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, raw[at : at + size]
        at += size


def _wire(number: int, value: int | bytes) -> bytes:
    """One protobuf field."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    return varint(number << 3) + varint(value)


@dataclass
class Model:
    """What a model file says, and the tokenizer rebuilt from it."""

    raw: bytes

    def __post_init__(self):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.suffix = UNIGRAM, False, False
        self.charsmap, self.dummy_prefix, self.squeeze, self.escape = b"", True, True, True
        for number, value in _fields(self.raw):
            if number == 1:
                own = dict(_fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                self.pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
            elif number == 2:
                own = dict(_fields(value))
                self.kind = own.get(3, UNIGRAM)
                self.byte_fallback = bool(own.get(35, 0))
                self.suffix = bool(own.get(24, 0))
            elif number == 3:
                own = dict(_fields(value))
                self.charsmap = own.get(2, b"")
                self.dummy_prefix = bool(own.get(3, 1))
                self.squeeze = bool(own.get(4, 1))
                self.escape = bool(own.get(5, 1))
        if self.kind not in (UNIGRAM, BPE) or self.suffix or not self.escape:
            raise ValueError("only unigram and BPE models with a leading space marker are known")
        if any(t == USER_DEFINED for *_, t in self.pieces):
            raise ValueError("models with user-defined pieces are not known")

    @property
    def unknown(self) -> int:
        return next(i for i, (*_, t) in enumerate(self.pieces) if t == UNKNOWN)

    @cached_property
    def splits(self) -> bool:
        """Whether no piece goes on after a word: then words are encoded independently."""
        return not any(SPACE in p.lstrip(SPACE) for p, _, t in self.pieces if t == NORMAL)

    @cached_property
    def segments(self) -> str:
        """An expression for the parts of a normalized text that are encoded independently:
        no piece reaches from one into the next."""
        pieces = [p for p, _, t in self.pieces if t == NORMAL]
        word = re.compile(r"[^\W\d_]").match
        # Numbers such as ² count as letters for expressions, but stand with punctuation.
        odd = "".join(sorted({c for p in pieces for c in p if word(c) and not c.isalpha()}))
        letter, other = rf"[^\W\d_{odd}]", rf"[^\w{SPACE}]|[\d_{odd}]"
        is_letter = re.compile(letter).match
        mixed = any(
            a != SPACE and bool(is_letter(a)) != bool(is_letter(b)) for p in pieces for a, b in zip(p, p[1:], strict=False)
        )
        if not self.splits:
            return r"(?s:.+)"
        if mixed or not self.byte_fallback:  # neighbouring unknown characters are one piece
            return f"{SPACE}*[^{SPACE}]+|{SPACE}+$"
        return f"{SPACE}*(?:{letter}+|(?:{other})+)|{SPACE}+$"

    def tokenizer(self):
        """Normalizer, model and decoder; the pre-tokenizer keeps space markers with the word
        that follows, where that changes nothing."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        # Only normal and byte pieces can come out of a text; others get names that no text has.
        names = [p if t in (NORMAL, BYTE) else f"\0{p}" for p, _, t in self.pieces]
        if self.kind == UNIGRAM:
            least = min((s for _, s, t in self.pieces if t == NORMAL), default=0.0)
            scores = [s if t == NORMAL else least for _, s, t in self.pieces]
            # A byte piece is not to be found as text, whatever else a text costs.
            scores = [s - 1000 * (t == BYTE) for s, (*_, t) in zip(scores, self.pieces, strict=True)]
            model = models.Unigram(list(zip(names, scores, strict=True)), self.unknown, self.byte_fallback)
        else:
            ids = {name: i for i, name in enumerate(names)}
            usable = {p for p, _, t in self.pieces if t == NORMAL}
            # SentencePiece joins the pair whose joined piece scores best: the pairs of a piece
            # rank as the piece does.
            ranked = sorted(
                ((p, s) for p, s, t in self.pieces if t == NORMAL and len(p) > 1),
                key=lambda x: (-x[1], ids[x[0]]),
            )
            merges = [
                (p[:i], p[i:])
                for p, _ in ranked
                for i in range(1, len(p))
                if p[:i] in usable and p[i:] in usable
            ]
            model = models.BPE(
                ids,
                merges,
                unk_token=names[self.unknown],
                fuse_unk=True,
                byte_fallback=self.byte_fallback,
            )
        made = Tokenizer(model)
        made.encode_special_tokens = True
        steps = []
        if self.charsmap:
            steps.append(normalizers.Precompiled(self.charsmap))
        if self.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(SPACE))
        steps.append(normalizers.Replace(" ", SPACE))
        made.normalizer = normalizers.Sequence(steps)
        if self.splits:
            made.pre_tokenizer = pre_tokenizers.Split(Regex(self.segments), "isolated")
        made.decoder = decoders.Sequence(
            [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
        )
        return made

    def plain(self) -> bytes:
        """The same model for text that is normalized already."""
        same = b"".join(_wire(n, v) for n, v in _fields(self.raw) if n != 3)
        return same + _wire(3, _wire(1, b"identity") + b"".join(_wire(i, 0) for i in (3, 4)) + _wire(5, 1))


class Codec:
    """Encodes and decodes texts by their different segments, each only once.

    A segment is a word or its punctuation with the markers before it, or a whole text if
    pieces of the model cross words. Each new one is encoded by the tokenizer, multithreaded, decoded again, and
    encoded by SentencePiece itself for comparison; where both differ, SentencePiece's pieces
    are taken and the text is marked.
    """

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = Model(raw)
        self.tokenizer = self.model.tokenizer()
        self.own = sentencepiece.SentencePieceProcessor(model_proto=self.model.plain())
        self.original = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.find = re.compile(self.model.segments).findall
        self.texts = [p for p, *_ in self.model.pieces]
        self.silent = frozenset(i for i, (*_, t) in enumerate(self.model.pieces) if t == CONTROL)
        self.plain = frozenset(i for i, (*_, t) in enumerate(self.model.pieces) if t == NORMAL)
        #: The ids of a segment as bytes: many small lists would keep Python's collector busy.
        self.known: dict[str, bytes] = {}
        #: Segments that decode to something else than themselves, or that the tokenizer
        #: encodes otherwise than SentencePiece.
        self.odd: dict[str, str] = {}
        self.unlike: set[str] = set()

    def _learn(self, segments: list[str]) -> None:
        encode, decode = self.tokenizer.encode_batch_fast, self.tokenizer.decode_batch
        outer = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.tokenizer.normalizer = self.tokenizer.pre_tokenizer = None
        texts, plain = self.texts, self.plain
        for i in range(0, len(segments), AT_ONCE):
            part = segments[i : i + AT_ONCE]
            encoded = encode(part, add_special_tokens=False)
            strange = []
            for segment, made, own in zip(part, encoded, self.own.encode(part), strict=True):
                self.known[segment] = array("i", own).tobytes()
                if made.ids != own:
                    self.unlike.add(segment)
                # Pieces of characters decode to what they say; others are decoded.
                if not plain.issuperset(own) or "".join([texts[i] for i in own]) != segment:
                    strange.append((segment, own))
            decoded = decode([own for _, own in strange], skip_special_tokens=False)
            for (segment, _), text in zip(strange, decoded, strict=True):
                if text != segment.replace(SPACE, " "):
                    self.odd[segment] = text
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = outer

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str, bool]]:
        """(ids, decoded, parity) of each text."""
        normals, found, parity = [], [], []
        for text in texts:
            normal = self.tokenizer.normalizer.normalize_str(text)
            normals.append(normal)
            parity.append(normal == self.original.normalize(text))
            found.append(self.find(normal))
        if len(self.known) > MOST_KNOWN:
            self.known.clear()
            self.odd.clear()
            self.unlike.clear()
        new = set().union(*found).difference(self.known)
        if new:
            self._learn(list(new))
        out, known, odd = [], self.known, self.odd
        for normal, segments, same in zip(normals, found, parity, strict=True):
            if odd and not odd.keys().isdisjoint(segments):
                text = "".join([odd[s] if s in odd else s.replace(SPACE, " ") for s in segments])
            else:
                text = normal.replace(SPACE, " ")
            if self.model.dummy_prefix:
                text = text.removeprefix(" ")
            ids = np.frombuffer(b"".join([known[s] for s in segments]), np.int32)
            out.append((ids, text, same and self.unlike.isdisjoint(segments)))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of lists of ids; control pieces say nothing."""
        ids = [[i for i in own if i not in self.silent] for own in ids]
        texts = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return [t.removeprefix(" ") for t in texts] if self.model.dummy_prefix else texts


def _codec(raw: bytes) -> Codec:
    """One codec for all tasks of a Python worker: what it has learned serves the next task."""
    registry = vars(sys.modules.setdefault("castloom_codecs", ModuleType("castloom_codecs")))
    key = hashlib.sha256(raw).hexdigest()
    if key not in registry:
        registry[key] = Codec(raw)
    return registry[key]


def read_model(path: str) -> bytes:
    """The model file, read by the driver; it travels to the executors with the task."""
    with open(path, "rb") as file:
        return file.read()


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


#: What encoding adds to a row.
_MADE = {
    "ids": "array<int>",
    "n_tokens": "bigint",
    "n_byte_pieces": "bigint",
    "ids_sha256": "string",
    "parity": "boolean",
    "round_trip": "boolean",
}


def encode(
    docs: DataFrame, model: bytes, text: str = "text", made: tuple[str, ...] = tuple(_MADE)
) -> DataFrame:
    """All columns of `docs` but the text, then those of `made`: ids, n_tokens, n_byte_pieces,
    ids_sha256 (of 32-bit little-endian ids), parity, round_trip.

    parity: SentencePiece normalizes and encodes the text to the same ids (checked on every
    text and every different segment). round_trip: decoding gives the text again, byte for
    byte. Null texts count as empty and have no ids. Columns of `docs` with these names are
    replaced. Rows stay as they are, repeated ones too; an empty table gives an empty result.
    """
    others = [c for c in docs.columns if c != text and c not in made]
    schema = docs.select(*(f"`{c}`" for c in others)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        codec = _codec(model)
        is_byte = np.array([t == BYTE for *_, t in codec.model.pieces])
        for batch in _batches(batches):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            rows = codec.encode(texts)
            ids = [r[0] for r in rows]
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            columns = {
                "ids": lambda: pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
                ),
                "n_tokens": lambda: pa.array(np.diff(offsets).astype(np.int64)),
                "n_byte_pieces": lambda: pa.array([int(is_byte[i].sum()) for i in ids], pa.int64()),
                "ids_sha256": lambda: pa.array(
                    [hashlib.sha256(i.astype("<i4").tobytes()).hexdigest() for i in ids], pa.string()
                ),
                "parity": lambda: pa.array([r[2] for r in rows], pa.bool_()),
                "round_trip": lambda: pa.array([r[1] == t for r, t in zip(rows, texts, strict=True)], pa.bool_()),
            }
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), *(columns[c]() for c in made)], [*others, *made]
            )

    for name in made:
        schema = schema.add(name, _type(_MADE[name]))
    return docs.select(*(f"`{c}`" for c in (*others, text))).mapInArrow(run, schema)


def _type(kind: str):
    from pyspark.sql import types as T

    kinds = {"bigint": T.LongType(), "boolean": T.BooleanType(), "string": T.StringType()}
    return kinds.get(kind) or T.ArrayType(T.IntegerType())


def decode(rows: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """All columns and `text`, decoded from ids; null ids give a null text."""
    others = [c for c in rows.columns if c != "text"]
    schema = rows.select(*(f"`{c}`" for c in others)).schema.add("text", _type("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in _batches(batches):
            lists = batch.column(ids).to_pylist()
            texts = codec.decode([x or [] for x in lists])
            texts = [t if x is not None else None for t, x in zip(texts, lists, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(texts, pa.string())], [*others, "text"]
            )

    return rows.select(*(f"`{c}`" for c in others)).mapInArrow(run, schema)


def token_digests(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and what `encode` tells of its ids, without the ids."""
    made = tuple(c for c in _MADE if c != "ids")
    return encode(pick(docs, doc_id=doc_id, text=text), model, made=made)
