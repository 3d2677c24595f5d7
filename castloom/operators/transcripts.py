"""Time-coded segments: lookup, overlap, merging, parsing, planning of pieces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castloom.functions.text import SPACE, blank, normalize_text, strip, word_count
from castloom.operators.ordered import neighbour
from castloom.operators.rows import keep_first, validate

#: Fixed values, in seconds.
CHUNK_S, OVERLAP_S, CHUNKING_FROM_S = 600, 30, 900
CLIP_S, ASSUMED_S = 300, 3600
#: Readable page length and OCR confidence below which a page is weak.
SELECTABLE_MIN_CHARACTERS, OCR_MIN_CONFIDENCE = 20, 30.0
MEDIA_DOLLARS_PER_MB = 0.000125


def joined_text(order: str, text: str, separator: str) -> Column:
    """Aggregate: texts of a group in ``order``, joined. The joined text is the result cell."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text).alias("t"))))
    return F.array_join(F.transform(ordered, lambda s: s["t"]), separator)


def full_text(segments: DataFrame, separator: str = " ") -> DataFrame:
    """Text of each transcript, segments in order."""
    return segments.groupBy("episode_id").agg(
        joined_text("seg_no", "text", separator).alias("text")
    )


def page_text(pages: DataFrame) -> DataFrame:
    """Text of each document: pages in order with a blank line between, empty ones skipped."""
    full = pages.where(F.coalesce("text", F.lit("")) != "")
    return full.groupBy("doc_id").agg(joined_text("page_no", "text", "\n\n").alias("text"))


def transcript_stats(segments: DataFrame) -> DataFrame:
    """Segments, words, and the end of the last segment (not the latest end)."""
    end = F.col("start_s") + F.col("duration_s")
    return segments.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("segment_count"),
        F.sum(word_count(F.col("text"))).alias("word_count"),
        F.max_by(end, F.struct("start_s", "seg_no")).alias("duration_s"),
    )


#: Seconds of a cell at the lowest level, and cells that times are held to on either side.
CELL_S, MOST_CELLS = 60.0, 1 << 52


def _cell(seconds: Column) -> Column:
    """The lowest cell of a time; endless times fall into the outermost cells."""
    cell = F.floor(F.least(F.greatest(seconds / CELL_S, F.lit(-1.0 * MOST_CELLS)), F.lit(1.0 * MOST_CELLS)))
    return cell.cast("bigint")


def _in_cells(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Two rows at most per range: its level, where cells are twice as long as one level below,
    is the lowest at which it touches no more cells than two."""
    first, last = _cell(start), F.greatest(_cell(start), _cell(end))
    level = F.ceil(F.log2(F.greatest(last - first, F.lit(1)))).cast("int")
    rows = df.withColumns({"_f": first, "_t": last, "_level": level})
    cells = F.expr("sequence(shiftright(_f, _level), shiftright(_t, _level))")
    return rows.withColumn("_cell", F.explode(cells)).drop("_f", "_t")


def _at_cells(df: DataFrame, seconds: Column, ranges: DataFrame) -> DataFrame:
    """The cells of a time at each level that the ranges have, a few in practice."""
    levels = ranges.agg(F.collect_set("_level")).scalar()
    rows = df.withColumn("_lowest", _cell(seconds)).withColumn("_level", F.explode(levels))
    return rows.withColumn("_cell", F.expr("shiftright(_lowest, _level)")).drop("_lowest")


def segment_at(segments: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe the first segment with start <= t < end; probes without one stay.

    Dyadic cells: a segment is in two cells at most, of a level that fits its length, however
    long it is; a probe is looked up once per level. Joined on (episode, level, cell), so one
    long episode is spread over many tasks.
    """
    s = segments.where(F.col("duration_s") > 0).select(
        "episode_id",
        "seg_no",
        "text",
        F.col("start_s").alias("_start"),
        (F.col("start_s") + F.col("duration_s")).alias("_end"),
    )
    spans = _in_cells(s, F.col("_start"), F.col("_end"))
    asked = _at_cells(probes, F.col("at_s"), spans)
    found = F.when(F.col("s.seg_no").isNotNull(), F.struct("s.seg_no", "s.text"))
    hit = _same_cell("p", "s") & (F.col("_start") <= F.col("at_s")) & (F.col("at_s") < F.col("_end"))
    hits = asked.alias("p").join(spans.alias("s"), hit).select(*(f"p.{c}" for c in probes.columns), found.alias("_hit"))
    # Probes without a hit come from the probes themselves: also those in tables without segments.
    every = hits.unionByName(probes.withColumn("_hit", F.lit(None).cast(hits.schema["_hit"].dataType)))
    first = every.groupBy(*probes.columns).agg(F.min("_hit").alias("_first"))
    return first.select(*probes.columns, "_first.seg_no", "_first.text")


def _same_cell(left: str, right: str) -> Column:
    same = F.lit(True)
    for column in ("episode_id", "_level", "_cell"):
        same &= F.col(f"{left}.{column}") == F.col(f"{right}.{column}")
    return same


def segments_in_range(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pairs of range and segment that overlap; touching is not overlapping.

    Of two that overlap, either the segment begins in the range or the range in the segment: so
    the begin of each is looked up in the dyadic cells of the other, and each pair appears once.
    """
    s = segments.withColumn("_end", F.col("start_s") + F.col("duration_s"))
    overlap = (F.col("start_s") < F.col("to_s")) & (F.col("_end") > F.col("from_s"))
    asked = _in_cells(ranges, F.col("from_s"), F.col("to_s"))
    begins = _at_cells(s, F.col("start_s"), asked)
    spans = _in_cells(s, F.col("start_s"), F.col("_end"))
    probes = _at_cells(ranges, F.col("from_s"), spans)
    columns = [
        *[F.col(f"r.{c}") for c in ranges.columns],
        *(f"s.{c}" for c in ("seg_no", "text", "start_s", "duration_s")),
    ]
    inside = begins.alias("s").join(
        asked.alias("r"), _same_cell("r", "s") & overlap & (F.col("start_s") >= F.col("from_s"))
    )
    around = probes.alias("r").join(
        spans.alias("s"), _same_cell("r", "s") & overlap & (F.col("start_s") < F.col("from_s"))
    )
    return inside.select(*columns).unionByName(around.select(*columns))


def segment_durations(
    segments: DataFrame, order: Sequence[str] = ("start_s", "seg_no"), clamp: bool = False
) -> DataFrame:
    """Each segment lasts until the next one starts; the last keeps its own length."""
    near = neighbour(segments, ["episode_id"], list(order), "start_s", "_next")
    gap = F.col("_next") - F.col("start_s")
    gap = F.greatest(F.lit(0.0), gap) if clamp else gap
    lasts = F.when(F.col("_next").isNotNull(), gap).otherwise(F.col("duration_s"))
    return near.withColumn("duration_s", lasts).drop("_next")


def merge_chunks(
    segments: DataFrame, chunk_s: float = CHUNK_S, overlap_s: float = OVERLAP_S
) -> DataFrame:
    """One transcript from overlapping chunks.

    Starts are shifted to the whole recording, the overlap is taken from the earlier
    chunk, durations run to the next start. A transcript of one chunk is left alone.
    """
    spread = segments.groupBy("episode_id").agg(
        (F.min("chunk") != F.max("chunk")).alias("_many")
    )
    counted = segments.join(spread, "episode_id")
    single = counted.where(~F.col("_many")).drop("_many")
    several = counted.where("_many").drop("_many")
    kept = several.where((F.col("chunk") == 0) | (F.col("start_s") >= overlap_s))
    shifted = kept.withColumn("start_s", F.col("start_s") + F.col("chunk") * (chunk_s - overlap_s))
    merged = segment_durations(shifted, ["start_s", "chunk", "seg_no"])
    return merged.unionByName(single)


def merge_clips(segments: DataFrame, clips: DataFrame) -> DataFrame:
    """One transcript from separate clips.

    ``clips`` has (episode_id, offset_s, silent, length_known). When the length is not
    known, the first silent clip after the start ends the transcript.
    """
    ends = clips.where(
        F.col("silent") & (F.col("offset_s") > 0) & ~F.coalesce("length_known", F.lit(False))
    )
    cut = ends.groupBy("episode_id").agg(F.min("offset_s").alias("_cut"))
    silent = clips.where("silent").select("episode_id", "offset_s")
    spoken = segments.join(silent, ["episode_id", "offset_s"], "left_anti")
    kept = spoken.join(cut, "episode_id", "left").where(
        (F.col("_cut").isNull() | (F.col("offset_s") < F.col("_cut"))) & ~blank(F.col("text"))
    )
    shifted = kept.drop("_cut").withColumn("start_s", F.col("start_s") + F.col("offset_s"))
    return segment_durations(shifted, ["start_s", "offset_s", "seg_no"], clamp=True)


def merge_summaries(chunks: DataFrame) -> DataFrame:
    """Summaries of a transcript's chunks, in order, empty ones skipped."""
    told = chunks.where(~blank(F.col("summary")))
    return told.groupBy("episode_id").agg(joined_text("chunk", "summary", " ").alias("summary"))


_STAMP = r"\d{1,2}:\d{2}(?::\d{2})?"
_TURN = rf"\[({_STAMP})\]{SPACE}*([^:]+):{SPACE}*"


def _stamp_seconds(stamp: Column) -> Column:
    numbers = F.regexp_extract_all(stamp, F.lit(r"\d+"), F.lit(0))
    return F.aggregate(numbers, F.lit(0), lambda sum, n: sum * 60 + n.cast("int")).cast("double")


def _with_gaps(df: DataFrame, turns: str) -> DataFrame:
    """Number the array of structs (text, start_s) and set each duration to the next start's gap.

    A column is made for every step, so that each is computed once: an expression that names
    an array several times would compute it as often.
    """
    following = F.slice(F.col(f"{turns}.start_s"), F.lit(2), F.greatest(F.size(turns), F.lit(1)) - 1)
    timed = df.withColumn("_pairs", F.arrays_zip(F.col(turns).alias("turn"), following.alias("next")))
    return timed.withColumn(
        turns,
        F.transform(
            "_pairs",
            lambda s, i: F.struct(
                i.cast("bigint").alias("seg_no"),
                s["turn"]["text"].alias("text"),
                s["turn"]["start_s"].alias("start_s"),
                F.coalesce(s["next"] - s["turn"]["start_s"], F.lit(0.0)).alias("duration_s"),
            ),
        ),
    ).drop("_pairs")


def _rows_of(df: DataFrame, turns: str, *keep: str) -> DataFrame:
    """One row per element. The outer form, for the inner one would first compute the array to
    see whether it has any."""
    rows = df.select(*keep, F.explode_outer(turns).alias("_s")).where("_s is not null")
    return rows.select(*keep, *(f"_s.{c}" for c in ("seg_no", "text", "start_s", "duration_s")))


def transcript_summary(text: Column) -> Column:
    """Text after a leading ``SUMMARY:`` up to a blank line or the first time stamp."""
    told = F.regexp_extract(strip(text), rf"(?is)^SUMMARY:{SPACE}*(.+?)(?:\n\n|\n\[)", 1)
    return strip(told)


def parse_transcript(df: DataFrame, *keep: str) -> DataFrame:
    """Segments of ``[MM:SS] Speaker: text`` runs: keep columns, seg_no, text, start_s, duration_s.

    The speaker may be any text without a colon. Without a single run the whole text is one
    segment at 0. Each text is matched and cut once, in time proportional to its stamps; no
    row leaves its task.
    """
    whole = df.select(*keep, strip(F.col("text")).alias("_whole"))
    cut = whole.select(
        *keep,
        # What opens a run, none for what stands before the first, and what was said behind it.
        F.concat(F.array(F.lit("")), F.regexp_extract_all("_whole", F.lit(_TURN), F.lit(0))).alias("_marks"),
        F.split("_whole", _TURN).alias("_said"),
    )
    cut = cut.withColumn("_runs", F.arrays_zip(F.col("_marks").alias("mark"), F.col("_said").alias("said")))
    runs = cut.withColumn(
        "_runs", F.when(F.size("_runs") > 1, F.slice("_runs", F.lit(2), F.size("_runs"))).otherwise(F.col("_runs"))
    )

    def turn(run: Column) -> Column:
        mark = run["mark"]
        stamp = F.regexp_extract(mark, _STAMP, 0)
        speaker = strip(F.regexp_extract(mark, rf"(?s)\]([^:]+):{SPACE}*$", 1))
        told = F.concat(F.lit("["), stamp, F.lit("] "), speaker, F.lit(": "), strip(run["said"]))
        return F.struct(
            F.when(mark == "", run["said"]).otherwise(told).alias("text"), _stamp_seconds(stamp).alias("start_s")
        )

    timed = _with_gaps(runs.withColumn("_turns", F.transform("_runs", turn)), "_turns")
    # Stamps out of order: the transcript is sorted after durations are set, as a stable sort.
    ranked = F.transform("_turns", lambda s: F.struct(s["start_s"].alias("start_s"), s["seg_no"], s.alias("s")))
    ordered = timed.withColumn("_turns", F.transform(F.array_sort(ranked), lambda r: r["s"]))
    rows = _rows_of(ordered.withColumn("_turns", F.transform("_turns", _renumbered)), "_turns", *keep)
    return rows


def _renumbered(segment: Column, at: Column) -> Column:
    return segment.withField("seg_no", at.cast("bigint"))


def parse_transcript_lines(df: DataFrame, *keep: str) -> DataFrame:
    """Line variant: a stamp at the start of a line opens a segment that later lines join.

    ``Speaker n:`` is removed, text before the first stamp is a segment at 0, and a stamp
    without text vanishes; a text of nothing else is one segment at 0.
    """
    opening = rf"(?<![^\n])(?=\[{_STAMP}\])"
    cut = df.select(*keep, F.col("text").alias("_text"), F.split("text", opening).alias("_blocks"))
    stamped = cut.withColumn(
        "_blocks",
        F.transform(
            F.filter("_blocks", lambda b: b != ""),
            lambda b: F.struct(
                F.regexp_extract(b, rf"^\[({_STAMP})\]", 1).alias("stamp"),
                F.regexp_extract_all(F.regexp_replace(b, rf"^\[{_STAMP}\]", ""), F.lit("[^\n]*"), F.lit(0)).alias("lines"),
            ),
        ),
    )

    def block(b: Column) -> Column:
        said = F.transform(
            b["lines"],
            lambda line, i: F.when(
                (i == 0) & (b["stamp"] != ""),
                F.regexp_replace(strip(line), rf"^[Ss]peaker{SPACE}*\d*{SPACE}*:?{SPACE}*", ""),
            ).otherwise(strip(line)),
        )
        return F.struct(
            strip(F.array_join(F.filter(said, lambda x: x != ""), " ")).alias("text"),
            _stamp_seconds(b["stamp"]).alias("start_s"),
        )

    spoken = stamped.withColumn("_turns", F.transform("_blocks", block))
    spoken = spoken.withColumn("_turns", F.filter("_turns", lambda s: s["text"] != ""))
    alone = F.array(F.struct(strip(F.col("_text")).alias("text"), F.lit(0.0).alias("start_s")))
    told = spoken.withColumn("_turns", F.when(F.size("_turns") == 0, alone).otherwise(F.col("_turns")))
    return _rows_of(_with_gaps(told, "_turns"), "_turns", *keep)


def text_as_transcript(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain texts as one segment each, and the blank ones as rejects."""
    good, bad = validate(texts, {"text is empty": ~blank(F.col("text"))})
    segments = good.select(
        "episode_id",
        F.lit(0).cast("bigint").alias("seg_no"),
        strip(F.col("text")).alias("text"),
        F.lit(0.0).alias("start_s"),
        F.lit(0.0).alias("duration_s"),
        F.lit("text").alias("source"),
        F.lit("und").alias("language"),
        word_count(F.col("text")).alias("word_count"),
    )
    return segments, bad


def needs_chunking(duration_s: Column) -> Column:
    return duration_s > CHUNKING_FROM_S


def chunk_plan(
    df: DataFrame, duration: str = "duration_s", chunk_s: int = CHUNK_S, overlap_s: int = OVERLAP_S
) -> DataFrame:
    """Overlapping windows; a further one starts only while at least an overlap remains."""
    step = chunk_s - overlap_s
    length = F.col(duration)
    last = F.greatest(F.lit(0), F.floor((length - overlap_s) / step).cast("int"))
    rows = df.where(length > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    start = (F.col("chunk") * step).cast("double")
    return rows.withColumn("start_s", start).withColumn(
        "end_s", F.least(F.col("start_s") + chunk_s, length.cast("double"))
    )


def clip_plan(
    df: DataFrame, duration: str = "duration_s", most_s: int | None = None, assumed_s: int = ASSUMED_S
) -> DataFrame:
    """Adjacent clips of the whole recording.

    An unknown length counts as ``assumed_s``, and ``length_assumed`` says so. ``most_s``
    plans only that much of a recording; ``rest_s`` tells what it leaves out.
    """
    known = F.nullif(F.col(duration).cast("int"), F.lit(0))
    length = F.coalesce(known, F.lit(assumed_s))
    planned = length if most_s is None else F.least(length, F.lit(most_s))
    rows = df.withColumns(
        {
            "offset_s": F.explode(F.sequence(F.lit(0), planned - 1, F.lit(CLIP_S))),
            "length_assumed": known.isNull(),
            "rest_s": length - planned,
        }
    )
    return rows.withColumn("end_s", F.least(F.col("offset_s") + CLIP_S, planned))


def media_cost(size_bytes: Column) -> Column:
    return size_bytes / F.lit(1024.0 * 1024.0) * MEDIA_DOLLARS_PER_MB


def chat_markdown(exchanges: DataFrame) -> DataFrame:
    """Numbered question and answer pairs of a conversation as one note."""
    pairs = F.array_sort(F.collect_list(F.struct("pair", "question", "response")))
    lines = F.transform(
        F.col("_pairs"),
        lambda p, i: F.concat(
            F.lit("### Q"), (i + 1).cast("string"), F.lit(": "), p["question"],
            F.lit("\n\n"), p["response"], F.lit("\n"),
        ),
    )
    return (
        exchanges.groupBy("conv_id", "podcast", "title")
        .agg(pairs.alias("_pairs"))
        .select(
            "conv_id",
            F.concat(
                F.lit("# My Notes: "), "title", F.lit("\n\n**Podcast:** "), "podcast",
                F.lit("\n\n## Interview Reflections\n\n"), F.array_join(lines, "\n"),
            ).alias("markdown"),
        )
    )


def ocr_lines(words: DataFrame) -> DataFrame:
    """Words of a page as lines in first-seen order, with their mean confidence.

    Confidences below 0 do not count; without one that counts the page is empty.
    """
    seen = words.withColumn("word", strip(F.col("word"))).where(F.col("word") != "")
    key = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("block_no", "par_no", "line_no")]
    good = F.when(F.col("confidence") >= 0, F.col("confidence"))
    lines = seen.groupBy("doc_id", "page_no", *key).agg(
        F.min("word_no").alias("_first"),
        joined_text("word_no", "word", " ").alias("_line"),
        F.sum(good).alias("_sum"),
        F.count(good).alias("_n"),
    )
    pages = lines.groupBy("doc_id", "page_no").agg(
        joined_text("_first", "_line", "\n").alias("_text"),
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("_mean"),
    )
    read = F.col("_mean").isNotNull()
    return pages.select(
        "doc_id",
        "page_no",
        F.when(read, F.col("_text")).otherwise("").alias("text"),
        F.when(read, F.round("_mean", 2)).otherwise(0.0).alias("confidence"),
    )


def merge_pages(
    pages: DataFrame, ocr: DataFrame, mode: str = "auto"
) -> tuple[DataFrame, DataFrame]:
    """Text and method per document from selectable page text and OCR, and the rejects.

    ``pages`` has (doc_id, page_no, text, failed), ``ocr`` has (doc_id, page_no, text,
    confidence). In mode ``auto`` only pages with little selectable text are read by OCR,
    and that text is the fallback when OCR finds nothing or is unsure.
    """
    if mode not in ("auto", "always", "never"):
        raise ValueError(f"unknown mode: {mode}")
    p = pages.select(
        "doc_id", "page_no", normalize_text(F.coalesce("text", F.lit(""))).alias("_sel"), "failed"
    )
    o = ocr.select(
        "doc_id",
        "page_no",
        normalize_text(F.coalesce("text", F.lit(""))).alias("_ocr"),
        F.col("confidence").alias("_conf"),
        F.lit(True).alias("_rendered"),
    )
    both = p.join(o, ["doc_id", "page_no"], "full")
    selectable, usable = F.coalesce("_sel", F.lit("")), F.coalesce("_sel", F.lit("")) != ""
    failed = F.coalesce("failed", F.lit(False))
    fallback = usable if mode == "auto" else F.lit(False)
    ask = {
        "auto": (F.length(selectable) < SELECTABLE_MIN_CHARACTERS) | failed,
        "always": F.lit(True),
        "never": F.lit(False),
    }[mode]
    rendered = F.coalesce("_rendered", F.lit(False))
    empty, weak = F.col("_ocr") == "", F.col("_conf") < OCR_MIN_CONFIDENCE
    plain = F.when(usable, "selectable_text").otherwise("empty")
    choice = (
        F.when(~ask, F.when(failed & (mode == "never"), "unreadable").otherwise(plain))
        .when(~rendered, "not rendered")
        .when(empty, F.when(fallback, "selectable_text").otherwise("empty"))
        .when(weak, F.when(fallback, "selectable_text").otherwise("weak ocr"))
        .otherwise("ocr")
    )
    text = F.when(F.col("_choice") == "ocr", F.col("_ocr")).when(
        F.col("_choice") == "selectable_text", selectable
    )
    warning = F.when(ask & rendered & empty & usable & (mode == "auto"), "empty ocr").when(
        ask & rendered & empty, "no readable text"
    ).when(ask & rendered & weak & usable & (mode == "auto"), "weak ocr")
    rows = both.withColumn("_choice", choice).select(
        "doc_id", "page_no", "_choice", text.alias("_text"), warning.alias("_warning")
    )
    has = {n: F.bool_or(F.col("_choice") == n) for n in ("ocr", "selectable_text")}
    bad = F.min(
        F.when(F.col("_choice").isin("unreadable", "not rendered", "weak ocr"),
               F.struct("page_no", F.col("_choice").alias("why")))
    )
    said = F.array_sort(
        F.collect_list(F.when(F.coalesce("_text", F.lit("")) != "", F.struct("page_no", "_text")))
    )
    docs = rows.groupBy("doc_id").agg(
        strip(F.array_join(F.transform(said, lambda s: s["_text"]), "\n\n")).alias("text"),
        F.when(has["ocr"] & has["selectable_text"], "hybrid")
        .when(has["ocr"], "ocr")
        .otherwise("selectable_text")
        .alias("method"),
        F.count(F.lit(1)).alias("page_count"),
        F.count("_warning").alias("warnings"),
        bad.alias("_bad"),
    )
    reason = F.when(F.col("_bad").isNotNull(), F.format_string("%s on page %d", "_bad.why", "_bad.page_no"))
    reason = F.coalesce(reason, F.when(F.col("text") == "", "no readable text"))
    told = docs.withColumn("reason", reason).drop("_bad")
    return told.where("reason IS NULL").drop("reason"), told.where("reason IS NOT NULL").select(
        "doc_id", "reason"
    )


def provenance(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Size and hash of each source and of its text, and its pages in order."""
    text = strip(F.col("text"))
    rows = docs.select(
        "doc_id",
        F.octet_length("source").cast("bigint").alias("size_bytes"),
        F.sha2("source", 256).alias("source_sha256"),
        F.length(text).cast("bigint").alias("text_characters"),
        F.sha2(text, 256).alias("text_sha256"),
    )
    if pages is None:
        return rows
    listed = pages.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page_no", "method", "characters"))).alias("pages")
    )
    return rows.join(listed, "doc_id", "left")


def pick_captions(tracks: DataFrame, preferred: Sequence[str] = ("en",)) -> DataFrame:
    """The caption track to use per video and why.

    Exact language first (written before generated), then regional variants, then tracks
    that translate to a preferred language, then any. A preference outranks track order.
    """
    language, no = F.col("language"), F.col("track_no")

    def rank(step: int, index: int, reason: Column, second: Column | None = None) -> Column:
        return F.struct(
            F.lit(step).alias("step"),
            F.lit(index).alias("index"),
            (second if second is not None else F.lit(0)).alias("second"),
            no.alias("track"),
            reason.alias("reason"),
        )

    options = []
    for i, lang in enumerate(preferred):
        exact = F.concat(F.lit("preferred language "), F.lit(lang))
        generated = F.col("is_generated").cast("int")
        options.append(F.when(language == lang, rank(1, i, exact, generated)))
        variant = F.concat(F.lit("language variant "), language)
        options.append(F.when(language.startswith(f"{lang}-"), rank(3, i, variant)))
        translated = F.concat(language, F.lit(f" translated to {lang}"))
        can = F.col("is_translatable") & F.array_contains("translation_languages", lang)
        options.append(F.when(can, rank(4, i, translated)))
    options.append(rank(5, 0, F.concat(F.lit("available language "), language)))
    best = tracks.withColumn("_rank", F.array_min(F.array(*options)))
    return keep_first(best, ["video_id"], ["_rank"]).select(
        "video_id", "track_no", "language", F.col("_rank.reason").alias("reason")
    )
