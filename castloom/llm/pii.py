"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castloom.llm.base import WORD, pick
from castloom.operators.rows import hash_sample

KINDS = ("email", "ip", "card", "phone")
#: What a word can be: nothing, or the first or a later word of a kind.
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

Span = tuple[str, int, int]

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can't begin inside a run of digits: whatever fails at its start fails there as well.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SIGN = re.compile(r"[0-9@]")
_WORDS = re.compile(WORD)


def luhn(digits: str) -> bool:
    """Whether the check digit of a number is right."""
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    free = 0
    for found in _AT.finditer(text):
        start = found.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < found.start():
            free = found.end()
            yield "email", start, free


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and kind; each kind is searched on its own."""
    if not _SIGN.search(text):
        return []
    spans = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p[-3:]) < 256 for p in m.group().split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                spans.append(("phone", *m.span()))
    return _sorted(spans)


def _sorted(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- words and their shapes ---------------------------------------------------------------


def _outline(word: str) -> str:
    """Letters as a and A, digits as 0, runs of each as one."""
    out = []
    for c in word[:WORD_CHARACTERS]:
        c = "0" if c in "0123456789" else "A" if c.isupper() else "a" if c.isalpha() else c
        if not (out and out[-1] == c and c in "0aA"):
            out.append(c)
    return "".join(out)


def _bucket(n: int) -> str:
    return str(n) if n < 5 else "5-8" if n < 9 else "9-11" if n < 12 else "12-19" if n < 20 else "20-"


def _shape(word: str) -> str:
    """The outline with the lengths of digit runs."""
    return re.sub(r"[0-9]+", lambda m: f"<{_bucket(len(m.group()))}>", re.sub(r"[^\W\d_]+", "a", word[:WORD_CHARACTERS]))


def features_of(word: str) -> tuple[str, ...]:
    """What a word itself tells."""
    outline = _outline(word)
    return (
        f"shape {_shape(word)}",
        f"outline {outline}",
        f"digits {_bucket(len(_DIGIT.findall(word[:WORD_CHARACTERS])))}",
        f"ends {outline[0]}{outline[-1]}",
        f"dots {word.count('.')} at {word.count('@')}",
    )


#: Features of a word: its own, the outlines of both neighbours, the words around its run.
WIDTH = 9
#: Characters of a word that its features look at: a longer one is no personal data.
WORD_CHARACTERS = 64


@dataclass
class Run:
    """Neighbouring words that hold a digit or an @, with the words around them.

    Only such words can be labelled: every other word is O, so runs are decoded one by one
    with the same result as the whole text.
    """

    words: list[str]
    spans: list[tuple[int, int]]
    before: str = ""
    after: str = ""

    def features(self) -> list[tuple[str, ...]]:
        outlines = ["", *map(_outline, self.words), ""]
        around = f"cue {_cue(self.before)}", f"then {_cue(self.after)}"
        return [
            (*features_of(w), f"before {outlines[i]}", f"after {outlines[i + 2]}", *around)
            for i, w in enumerate(self.words)
        ]


def _cue(word: str) -> str:
    """A word beside a run as a feature: its lower-cased letters."""
    return "".join(c for c in word[:WORD_CHARACTERS].lower() if c.isalpha())


def runs_of(text: str) -> list[Run]:
    if not _SIGN.search(text):
        return []
    runs, before, inside = [], "", False
    for m in _WORDS.finditer(text):
        word = m.group()
        if _SIGN.search(word):
            if not inside:
                runs.append(Run([], [], before))
            runs[-1].words.append(word)
            runs[-1].spans.append(m.span())
        elif inside:
            runs[-1].after = word
        inside, before = bool(_SIGN.search(word)), word
    return runs


# --- the field ----------------------------------------------------------------------------


@dataclass
class Field:
    """A linear-chain conditional random field: weights of features, of neighbouring labels,
    and of labels at the ends of a run."""

    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, len(LABELS))))
    steps: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS), len(LABELS))))
    first: np.ndarray = field(default_factory=lambda: np.zeros(len(LABELS)))
    last: np.ndarray = field(default_factory=lambda: np.zeros(len(LABELS)))

    def rows(self, run: Run) -> np.ndarray:
        """Feature numbers of each word; unknown features are the last one, of weight zero."""
        unknown = len(self.index)
        return np.array([[self.index.get(f, unknown) for f in word] for word in run.features()])

    def decode(self, runs: list[Run], cells: int = 1 << 18) -> list[list[int]]:
        """The best labels of each run, by Viterbi over batches of runs of similar length."""
        out: list[list[int]] = [[] for _ in runs]
        order = sorted(range(len(runs)), key=lambda i: len(runs[i].words))
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and (end + 1 - start) * len(runs[order[end]].words) <= cells:
                end += 1
            picked = order[start:end]
            for i, labels in zip(picked, self._viterbi([self.rows(runs[i]) for i in picked]), strict=True):
                out[i] = labels
            start = end
        return out

    def _viterbi(self, rows: list[np.ndarray]) -> list[list[int]]:
        lengths = np.array([len(r) for r in rows])
        longest = int(lengths.max())
        scores = np.zeros((len(rows), longest, len(LABELS)))
        for i, r in enumerate(rows):
            scores[i, : len(r)] = self.weights[r].sum(axis=1)
        best, back = self.first + scores[:, 0], np.zeros((longest, *scores[:, 0].shape), np.int8)
        for t in range(1, longest):
            through = best[:, :, None] + self.steps
            back[t] = through.argmax(axis=1)
            reached = through.max(axis=1) + scores[:, t]
            best = np.where((t < lengths)[:, None], reached, best)
        label = (best + self.last).argmax(axis=1)
        labels = np.zeros((len(rows), longest), np.int8)
        for t in range(longest - 1, -1, -1):
            inside = t < lengths
            labels[inside, t] = label[inside]
            if t:
                label = np.where(inside, back[t][np.arange(len(rows)), label], label)
        return [row[:n].tolist() for row, n in zip(labels, lengths, strict=True)]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


Example = tuple[Run, list[int]]


def names_of(examples: list[Example]) -> set[str]:
    """The features of labelled runs."""
    return {f for run, _ in examples for word in run.features() for f in word}


def train(
    examples: list[Example],
    rounds: int = 150,
    rate: float = 0.3,
    decay: float = 1e-3,
    names: set[str] | None = None,
) -> Field:
    """Fit a field to labelled runs, with their features or only those `names`: gradient ascent
    on their log-likelihood, by forward and backward sums over all runs at once, with steps
    scaled per weight."""
    made = Field()
    if not examples:
        return made
    names = sorted(names_of(examples) if names is None else names)
    made.index = {f: i for i, f in enumerate(names)}
    made.weights = np.zeros((len(names) + 1, len(LABELS)))
    lengths = np.array([len(run.words) for run, _ in examples])
    n, longest, size = len(examples), int(lengths.max()), len(LABELS)
    rows = np.full((n, longest, WIDTH), len(names))
    gold = np.zeros((n, longest), int)
    for i, (run, labels) in enumerate(examples):
        rows[i, : len(labels)] = made.rows(run)
        gold[i, : len(labels)] = labels
    inside = np.arange(longest) < lengths[:, None]
    ends = np.arange(n), lengths - 1

    one = np.eye(size)[gold] * inside[..., None]
    pairs = inside[:, 1:]
    seen_steps = np.einsum("nti,ntj->ij", one[:, :-1] * pairs[..., None], one[:, 1:])
    parts = [made.weights, made.steps, made.first, made.last]
    squares = [np.full_like(p, 1e-8) for p in parts]
    for _ in range(rounds):
        scores = made.weights[rows].sum(axis=2)
        ahead, behind = np.zeros((n, longest, size)), np.zeros((n, longest, size))
        ahead[:, 0] = made.first + scores[:, 0]
        for t in range(1, longest):
            ahead[:, t] = _logsum(ahead[:, t - 1, :, None] + made.steps, 1) + scores[:, t]
        behind[ends] = made.last
        for t in range(longest - 2, -1, -1):
            back = _logsum(made.steps + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where((t < lengths - 1)[:, None], back, behind[:, t])
        total = _logsum(ahead[ends] + made.last, 1)
        chance = np.exp(np.minimum(ahead + behind - total[:, None, None], 0)) * inside[..., None]
        joint = (
            ahead[:, :-1, :, None]
            + made.steps
            + (scores[:, 1:] + behind[:, 1:])[:, :, None, :]
            - total[:, None, None, None]
        )
        joint = np.exp(np.minimum(joint, 0)) * pairs[..., None, None]
        wrong = one - chance
        change = np.zeros_like(made.weights)
        np.add.at(change, rows.reshape(-1, WIDTH), wrong.reshape(-1, 1, size))
        changes = [
            change,
            seen_steps - joint.sum(axis=(0, 1)),
            wrong[:, 0].sum(axis=0),
            wrong[ends].sum(axis=0),
        ]
        for part, step, square in zip(parts, changes, squares, strict=True):
            step = step / n - decay * part
            square += step**2
            part += rate * step / np.sqrt(square)
        made.weights[-1] = 0
    return made


# --- labelled words -----------------------------------------------------------------------

#: Labelled lines, each span as [kind text]. Formats that the patterns miss, and
#: numbers that are no personal data.
EXAMPLES = (
    "call [phone (212) 555-0147] after noon",
    "office [phone (030) 555-2291] or [phone (044) 555-7310]",
    "tel [phone 212-555-0147] ext",
    "fax [phone 415-555-2671] please",
    "mobile [phone 303.555.0182] only",
    "ring [phone 020 7946 0958] today",
    "phone [phone +1 (415) 555-2671] now",
    "write to [email jo.doe@mail.example.com] soon",
    "mail [email a_b@example.org] or [phone +44 20 7946 0958]",
    "at [ip 192.0.2.17] and [ip 198.51.100.3] again",
    "card [card 4111 1111 1111 1111] expires",
    "paid by [card 4111-1111-1111-1111] online",
    "card [card 4111111111111111] expires",
    "card [card 4111.1111.1111.1111] valid",
    "from [phone +1 (303) 555-0182] [ip 192.0.2.44] on",
    "by [phone +1 (617) 555-0139] [ip 198.51.100.27] too",
    "in 1999 or 2024 there were 12 of 300",
    "on 2024-01-31 at 10:45 it cost 12.50 or 1,200",
    "version 1.2.3 of 10.4 was 3.14159",
    "page 12-15 and 100-200 of 2-3",
    "id 0123456789abcdef0123456789abcdef01234567 done",
    'token = "269a7c5e9a1b4c3d2e1f00998877665544332211" end',
    "room 101 (2) 3rd floor 4th",
    "score 3-2 and 10-7 after 90 minutes",
    "order 123456 and 7654321 shipped",
    "number 12345678901234567890123 is long",
    "user @name and @other said",
    "10 % of 5,000 is 500",
    "www.example.com/en/7198 or /de/39547.html",
    "9807915762804491 and 1234567890123 are numbers",
)
_MARKED = re.compile(r"\[(\w+) ([^\]]+)\]")
#: Documents whose spans of fixed patterns are labelled words as well.
SAMPLE_DOCUMENTS = 400
#: Bounds of training: characters of a sampled text, words of a run, lines of a labelled table.
TRAIN_CHARACTERS, TRAIN_WORDS, LABELLED_LINES = 20_000, 40, 10_000


def _example(line: str) -> tuple[str, list[Span]]:
    spans, out, at = [], "", 0
    for m in _MARKED.finditer(line):
        out += line[at : m.start()]
        spans.append((m.group(1), len(out), len(out) + len(m.group(2))))
        out += m.group(2)
        at = m.end()
    return out + line[at:], spans


class Covered:
    """Spans looked up by place, in logarithmic time: the spans in order of their starts, with
    the greatest end up to each."""

    def __init__(self, spans: list[Span]):
        self.spans = _sorted(spans)
        self.starts = [s[1] for s in self.spans]
        self.ends = list(accumulate((s[2] for s in self.spans), max))

    def first(self, start: int, end: int) -> Span | None:
        """The first span that has a character between start and end: the one at which the
        greatest end so far passes `start` reaches that far itself."""
        at = bisect_right(self.ends, start)
        return self.spans[at] if at < len(self.spans) and self.starts[at] < end else None


def labelled(text: str, spans: list[Span]) -> list[Example]:
    """The runs of a text with the labels that the spans give their words."""
    out, covered = [], Covered(spans)
    for run in runs_of(text):
        labels, before = [], None
        for start, end in run.spans:
            hit = covered.first(start, end)
            labels.append(LABELS.index(f"{'I' if hit == before else 'B'}-{hit[0]}") if hit else 0)
            before = hit
        out.append((run, labels))
    return out


def labelled_lines(table: DataFrame, line: str = "line") -> list[str]:
    """The lines of a small labelled table, spans marked as [kind text]: at most LABELLED_LINES."""
    rows = pick(table, line=line).where("line is not null").limit(LABELLED_LINES + 1).collect()
    if len(rows) > LABELLED_LINES:
        raise ValueError(f"over {LABELLED_LINES} labelled lines")
    return [r["line"] for r in rows]


def fit(
    docs: DataFrame,
    text: str = "text",
    sample: int = SAMPLE_DOCUMENTS,
    lines: DataFrame | Sequence[str] = EXAMPLES,
    characters: int = TRAIN_CHARACTERS,
    words: int = TRAIN_WORDS,
) -> Field:
    """A field fitted to labelled lines (texts, or a table with a column `line`) and to the
    spans of fixed patterns in at most `sample` documents with a digit or an @, taken by the
    hash of their text. Of a sampled text it reads `characters` at most, and runs of at most
    `words` words: this bounds training alone, all documents are searched whole.
    Words around a run count only if the labelled lines have them: beside the spans of patterns
    any word stands by chance."""
    lines = labelled_lines(lines) if isinstance(lines, DataFrame) else lines
    rows = pick(docs, text=text).where(F.col("text").rlike("[0-9@]"))
    rows = hash_sample(rows, ["text"], rows.count(), sample)
    examples = [x for line in lines for x in labelled(*_example(line))] * 3
    sampled: list[Example] = []
    for row in rows.select(F.substring("text", 1, characters).alias("text")).collect():
        for run, labels in labelled(row["text"], base_spans(row["text"])):
            if len(labels) <= words:
                sampled.append((run, labels))
    names = names_of(examples) | {f for f in names_of(sampled) if not f.startswith(("cue ", "then "))}
    return train(examples + sampled, names=names)


# --- spans --------------------------------------------------------------------------------

_EDGE = ".,;:!?\"'<>[]{}|*#%&$="
_LEAST = {"email": (0, 200), "ip": (4, 12), "card": (12, 19), "phone": (9, 15)}


def _field_spans(text: str, run: Run, labels: list[int]) -> list[Span]:
    """The spans of a labelled run, without punctuation around them, if they can be of their
    kind at all."""
    spans, groups = [], []
    starts = [start for start, _ in run.spans[1:]]
    for label, (start, end), following in zip(labels, run.spans, [*starts, None], strict=True):
        if not label:
            continue
        prefix, kind = LABELS[label].split("-")
        if prefix == "I" and groups and groups[-1][0] == kind and groups[-1][3] == start:
            groups[-1][2] = end
        else:
            groups.append([kind, start, end, None])
        groups[-1][3] = following
    for kind, start, end, _ in groups:
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        found = text[start:end]
        least, most = _LEAST[kind]
        digits = "".join(_DIGIT.findall(found))
        if kind == "email":
            fits = found.count("@") == 1 and "." in found.partition("@")[2]
        else:
            fits = kind == "phone" or (luhn(digits) if kind == "card" else found.count(".") == 3)
        if fits and least <= len(digits) <= most:
            spans.append((kind, start, end))
    return spans


def find(texts: list[str], model: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text. What the field adds does not touch a base span."""
    bases = [base_spans(t) for t in texts]
    runs = [(i, run) for i, t in enumerate(texts) for run in runs_of(t)]
    alls = [list(b) for b in bases]
    covered = [Covered(b) for b in bases]
    for (i, run), labels in zip(runs, model.decode([r for _, r in runs]), strict=True):
        for span in _field_spans(texts[i], run, labels) if any(labels) else ():
            if not covered[i].first(span[1], span[2]):
                alls[i].append(span)
    return [(b, _sorted(a)) for b, a in zip(bases, alls, strict=True)]


def _told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield part, [t or "" for t in part.column("text").to_pylist()]


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Field | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are those of the fixed patterns; spans (kind:start:end in code
    points, end exclusive, comma-joined) adds what the field finds. Null texts count as empty.
    Repeated rows stay. An empty table gives an empty result. Other columns are not used.
    """
    rows = pick(docs, doc_id=doc_id, text=text)
    model = model or fit(rows)
    kind = dict(rows.dtypes)["doc_id"]
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches):
            found = find(texts, model)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    *(pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS),
                    pa.array([hashlib.sha256(_told(b).encode()).hexdigest() for b, _ in found], pa.string()),
                    pa.array([_told(a) for _, a in found], pa.string()),
                ],
                names,
            )

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or group of overlapping ones, replaced by its first kind."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", model: Field | None = None) -> DataFrame:
    """All rows and columns, personal data in the text replaced; null texts stay null."""
    model = model or fit(docs, text)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(texts), 500):
            part = texts[i : i + 500].to_pylist()
            found = find([t or "" for t in part], model)
            out += [t if t is None else redacted(t, a) for t, (_, a) in zip(part, found, strict=True)]
        return pa.array(out, pa.string())

    return docs.withColumn(text, clean(F.col(f"`{text}`")))
