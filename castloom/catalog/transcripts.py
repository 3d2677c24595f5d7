"""Queries over segments, transcripts and document pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from castloom.catalog import bindings as b
from castloom.catalog.bindings import oracle, table
from castloom.catalog.functions import _SP, _strip
from castloom.operators import transcripts as tr


def _hash(column):
    return F.sha2(column, 256)


def full_text(spark, folder):
    texts = tr.full_text(b.segments(spark, folder))
    return texts.select("episode_id", _hash("text").alias("text_hash"))


def _pages(spark, folder):
    rows = table(spark, folder, "conversations")
    return rows.select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").alias("page_no"),
        F.when(F.col("turn") % 4 == 3, F.lit("")).otherwise(F.col("text")).alias("text"),
    )


def page_text(spark, folder):
    texts = tr.page_text(_pages(spark, folder))
    return texts.select("doc_id", _hash("text").alias("text_hash"))


def transcript_stats(spark, folder):
    stats = tr.transcript_stats(b.segments(spark, folder))
    return stats.withColumn("duration_s", F.round("duration_s", 3))


def _probes(spark, folder):
    shift = F.col("seg_no") * 37 % 120
    return b.segments(spark, folder).select(
        F.concat_ws("-", "episode_id", "seg_no").alias("probe_id"),
        "episode_id",
        (F.col("start_s") + shift).alias("at_s"),
    )


def segment_at(spark, folder):
    hits = tr.segment_at(b.segments(spark, folder), _probes(spark, folder))
    return hits.select("probe_id", "at_s", "seg_no")


def segments_in_range(spark, folder):
    ranges = b.segments(spark, folder).select(
        F.concat_ws("-", "episode_id", "seg_no").alias("range_id"),
        "episode_id",
        F.col("start_s").alias("from_s"),
        (F.col("start_s") + F.col("seg_no") * 100).alias("to_s"),
    )
    pairs = tr.segments_in_range(b.segments(spark, folder), ranges)
    return pairs.select("range_id", "seg_no", "start_s")


def segment_durations(spark, folder):
    rows = tr.segment_durations(b.segments(spark, folder))
    return rows.select("episode_id", "seg_no", F.round("duration_s", 3).alias("duration_s"))


def _chunks(spark, folder):
    chunk = F.floor(F.col("seg_no") / 2).cast("bigint")
    return b.segments(spark, folder).select(
        "episode_id",
        chunk.alias("chunk"),
        "seg_no",
        "text",
        (F.col("seg_no") % 2 * 45 + F.col("seg_no") * 7 % 50).cast("double").alias("start_s"),
        "duration_s",
    )


def merge_chunks(spark, folder):
    rows = tr.merge_chunks(_chunks(spark, folder))
    return rows.select(
        "episode_id", "chunk", "seg_no", "start_s", F.round("duration_s", 3).alias("duration_s")
    )


def merge_clips(spark, folder):
    rows = b.segments(spark, folder)
    offset = (F.floor(F.col("seg_no") / 2) * 300).cast("double")
    clipped = rows.select(
        "episode_id",
        offset.alias("offset_s"),
        "seg_no",
        F.when(F.col("seg_no") % 7 == 5, F.lit(" ")).otherwise(F.col("text")).alias("text"),
        (F.col("seg_no") % 2 * 60).cast("double").alias("start_s"),
        "duration_s",
    )
    clips = clipped.groupBy("episode_id", "offset_s").agg(
        (F.pmod(F.col("episode_id") + F.col("offset_s") / 300, F.lit(5)) == 4).alias("silent"),
        (F.col("episode_id") % 2 == 0).alias("length_known"),
    )
    merged = tr.merge_clips(clipped, clips)
    return merged.select(
        "episode_id", "seg_no", "start_s", F.round("duration_s", 3).alias("duration_s")
    )


def merge_summaries(spark, folder):
    summary = F.when(F.col("seg_no") % 3 == 1, F.lit("  ")).otherwise(F.col("text"))
    rows = b.segments(spark, folder).select(
        "episode_id", F.col("seg_no").alias("chunk"), summary.alias("summary")
    )
    return tr.merge_summaries(rows).select("episode_id", _hash("summary").alias("summary_hash"))


def _stamped(spark, folder, speaker):
    """Whole documents written out as stamped texts, four words to a stamp.

    Dealt by episode once, as whole texts: neither words nor lines leave their task after that.
    """
    four = F.regexp_extract_all("text", F.lit(r"(?U)\S++(?:\s++\S++){0,3}"), F.lit(0))
    rows = b.transcripts(spark, folder).repartition("episode_id").select(
        "episode_id", F.posexplode(four).alias("no", "piece")
    )
    plain = F.translate(F.regexp_replace("piece", r"(?U)\s+", " "), ":[]", ";()")
    pieces = rows.groupBy("episode_id", F.col("no").cast("bigint").alias("seg_no")).agg(F.collect_list(plain).alias("pieces"))
    # Texts of one id are told at once, word by word.
    words = F.flatten(
        F.transform("pieces", lambda p: F.transform(F.split(p, " "), lambda w, i: F.struct(i.alias("no"), w.alias("word"))))
    )
    together = F.array_join(F.transform(F.array_sort(words), lambda x: x["word"]), " ")
    said = F.when(F.size("pieces") == 1, F.get("pieces", F.lit(0))).otherwise(together)
    lines = pieces.select("episode_id", "seg_no", said.alias("said"))
    n = F.col("seg_no")
    clock = F.format_string("[%02d:%02d:%02d] ", F.floor(n / 400), F.floor(n / 60) % 60, n % 60)
    return tr.full_text(lines.select("episode_id", "seg_no", F.concat(clock, F.lit(speaker), "said").alias("text")), "\n")


def parse_transcript(spark, folder):
    rows = tr.parse_transcript(_stamped(spark, folder, "Ann B: "), "episode_id")
    return rows.select("episode_id", "seg_no", _hash("text").alias("text_hash"), "start_s", "duration_s")


def parse_transcript_lines(spark, folder):
    rows = tr.parse_transcript_lines(_stamped(spark, folder, "Speaker 2: "), "episode_id")
    return rows.select("episode_id", "seg_no", _hash("text").alias("text_hash"), "start_s", "duration_s")


def text_as_transcript(spark, folder):
    texts = b.transcripts(spark, folder).select("episode_id", "text")
    segments, _ = tr.text_as_transcript(texts)
    return segments.select(
        "episode_id", "seg_no", _hash("text").alias("text_hash"), "source", "language", "word_count"
    )


def chunk_plan(spark, folder):
    rows = b.transcripts(spark, folder).select(
        "episode_id", (F.length("text") / 2).alias("duration_s")
    )
    plan = tr.chunk_plan(rows.where(tr.needs_chunking(F.col("duration_s"))))
    return plan.select("episode_id", F.col("chunk").cast("bigint").alias("chunk"), "start_s", "end_s")


def clip_plan(spark, folder):
    length = F.when(F.col("episode_id") % 5 != 0, F.length("text"))
    rows = b.transcripts(spark, folder).select("episode_id", length.alias("duration_s"))
    plan = tr.clip_plan(rows)
    return plan.select(
        "episode_id",
        F.col("offset_s").cast("bigint").alias("offset_s"),
        F.col("end_s").cast("bigint").alias("end_s"),
        "length_assumed",
    )


def media_cost(spark, folder):
    cost = tr.media_cost(F.col("size_bytes") * 1000)
    return b.cache_entries(spark, folder).select("entry_id", F.round(cost, 9).alias("cost_usd"))


def chat_markdown(spark, folder):
    turns = table(spark, folder, "conversations")
    pair = F.floor(F.col("turn") / 2).cast("bigint")
    pairs = turns.groupBy("conv_id", pair.alias("pair")).agg(
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("question"),
        F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("response"),
    )
    exchanges = pairs.where("question IS NOT NULL AND response IS NOT NULL").select(
        "*",
        F.concat(F.lit("Show "), F.col("conv_id") % 7).alias("podcast"),
        F.concat(F.lit("Talk "), "conv_id").alias("title"),
    )
    notes = tr.chat_markdown(exchanges)
    return notes.select("conv_id", _hash("markdown").alias("note_hash"))


def _words(spark, folder):
    """Words of each turn as OCR words, three to a line."""
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").alias("page_no"),
        F.posexplode(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")).alias("word_no", "word"),
    )
    no = F.col("word_no")
    line = F.floor(no / 3).cast("int")
    return rows.select(
        "doc_id",
        "page_no",
        "word_no",
        "word",
        F.lit(1).alias("block_no"),
        F.floor(line / 4).cast("int").alias("par_no"),
        (line % 4).alias("line_no"),
        F.when(F.col("page_no") % 5 == 4, -1.0)
        .otherwise((no * 7 % 100 - 5).cast("double"))
        .alias("confidence"),
    )


def ocr_lines(spark, folder):
    pages = tr.ocr_lines(_words(spark, folder))
    return pages.select("doc_id", "page_no", _hash("text").alias("text_hash"), "confidence")


def _page_inputs(spark, folder):
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text"
    )
    kind = F.pmod(F.col("doc_id") + F.col("page_no"), F.lit(6))
    word = F.substring_index("text", " ", 1)
    pages = rows.select(
        "doc_id",
        "page_no",
        F.when(kind < 3, F.col("text")).when(kind == 3, F.lit("")).otherwise(word).alias("text"),
        F.lit(False).alias("failed"),
    )
    ocr = rows.where(F.col("doc_id") % 4 != 1).select(
        "doc_id",
        "page_no",
        F.when(kind == 5, F.lit(" ")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 4, 12.5).otherwise(80.0).alias("confidence"),
    )
    return pages, ocr


def merge_pages(spark, folder):
    good, _ = tr.merge_pages(*_page_inputs(spark, folder))
    return good.select("doc_id", _hash("text").alias("text_hash"), "method", "page_count", "warnings")


def merge_pages_rejects(spark, folder):
    _, bad = tr.merge_pages(*_page_inputs(spark, folder))
    return bad


def provenance(spark, folder):
    pages = table(spark, folder, "documents").select(
        "doc_id", F.col("text").alias("source"), "text"
    )
    return tr.provenance(pages)


def pick_captions(spark, folder):
    rows = table(spark, folder, "documents")
    langs = {"en": "en-GB", "fr": "fr", "de": "de", "es": "en"}
    language = F.col("lang")
    for old, new in langs.items():
        language = F.when(F.col("lang") == old, new).otherwise(language)
    tracks = rows.select(
        F.floor(F.col("doc_id") / 3).cast("bigint").alias("video_id"),
        F.col("doc_id").alias("track_no"),
        language.alias("language"),
        (F.col("doc_id") % 2 == 0).alias("is_generated"),
        (F.col("doc_id") % 3 == 0).alias("is_translatable"),
        F.array(F.lit("nl"), F.lit("de")).alias("translation_languages"),
    )
    return tr.pick_captions(tracks, ("en", "nl"))


QUERIES = {
    "full_text": full_text,
    "page_text": page_text,
    "transcript_stats": transcript_stats,
    "segment_at": segment_at,
    "segments_in_range": segments_in_range,
    "segment_durations": segment_durations,
    "merge_chunks": merge_chunks,
    "merge_clips": merge_clips,
    "merge_summaries": merge_summaries,
    "parse_transcript": parse_transcript,
    "parse_transcript_lines": parse_transcript_lines,
    "text_as_transcript": text_as_transcript,
    "chunk_plan": chunk_plan,
    "clip_plan": clip_plan,
    "media_cost": media_cost,
    "chat_markdown": chat_markdown,
    "ocr_lines": ocr_lines,
    "merge_pages": merge_pages,
    "merge_pages_rejects": merge_pages_rejects,
    "provenance": provenance,
    "pick_captions": pick_captions,
}

#: What ``_stamped`` writes: four words to a stamp, whose hours change every 400 stamps, so
#: that stamps repeat and go back.
_SAID = {
    "words": f"""SELECT doc_id AS episode_id, list_filter(regexp_split_to_array(text, '{_SP}+'),
       lambda w: w <> '') AS w FROM documents""",
    "pieces": """SELECT episode_id, seg_no, array_to_string(w[4 * seg_no + 1 : 4 * seg_no + 4], ' ') AS piece
FROM (SELECT *, unnest(range(0, (len(w) + 3) // 4)) AS seg_no FROM words)""",
    "said": """SELECT episode_id, seg_no, translate(piece, ':[]', ';()') AS said,
       CAST(seg_no // 400 * 3600 + seg_no // 60 % 60 * 60 + seg_no % 60 AS DOUBLE) AS start_s FROM pieces""",
}


def _normal(text: str) -> str:
    lines = f"list_transform(string_split({text}, chr(10)), lambda l: {_strip('l')})"
    squeezed = f"regexp_replace(array_to_string({lines}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return _strip(squeezed)


ORACLES = {
    "full_text": oracle(
        """SELECT episode_id, sha256(string_agg(text, ' ' ORDER BY seg_no)) AS text_hash
FROM segments GROUP BY episode_id""",
        "segments",
    ),
    "page_text": oracle(
        """SELECT conv_id AS doc_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn))
       AS text_hash FROM conversations WHERE turn % 4 <> 3 GROUP BY conv_id"""
    ),
    "transcript_stats": oracle(
        f"""SELECT episode_id, count(*) AS segment_count, CAST(sum(len(list_filter(
       regexp_split_to_array(text, '{_SP}+'), lambda w: w <> ''))) AS BIGINT) AS word_count,
       round(arg_max(start_s + duration_s, seg_no), 3) AS duration_s
FROM segments GROUP BY episode_id""",
        "segments",
    ),
    "segment_at": oracle(
        """SELECT p.episode_id || '-' || p.seg_no AS probe_id, p.at_s, min(s.seg_no) AS seg_no
FROM (SELECT *, start_s + seg_no * 37 % 120 AS at_s FROM segments) p LEFT JOIN segments s
  ON s.episode_id = p.episode_id AND s.start_s <= p.at_s AND p.at_s < s.start_s + s.duration_s
GROUP BY ALL""",
        "segments",
    ),
    "segments_in_range": oracle(
        """SELECT r.episode_id || '-' || r.seg_no AS range_id, s.seg_no, s.start_s
FROM segments r JOIN segments s ON s.episode_id = r.episode_id
 AND s.start_s < r.start_s + r.seg_no * 100 AND s.start_s + s.duration_s > r.start_s""",
        "segments",
    ),
    "segment_durations": oracle(
        """SELECT episode_id, seg_no, round(coalesce(lead(start_s) OVER (PARTITION BY episode_id
       ORDER BY start_s, seg_no) - start_s, duration_s), 3) AS duration_s FROM segments""",
        "segments",
    ),
    "merge_chunks": oracle(
        """SELECT episode_id, chunk, seg_no, start_s, round(CASE WHEN many THEN coalesce(
       lead(start_s) OVER (PARTITION BY episode_id ORDER BY start_s, chunk, seg_no) - start_s,
       duration_s) ELSE duration_s END, 3) AS duration_s FROM shifted""",
        "segments",
        chunks="""SELECT episode_id, seg_no // 2 AS chunk, seg_no, duration_s,
       CAST(seg_no % 2 * 45 + seg_no * 7 % 50 AS DOUBLE) AS start_s,
       max(seg_no // 2) OVER (PARTITION BY episode_id) > 0 AS many FROM segments""",
        shifted="""SELECT episode_id, chunk, seg_no, many, duration_s,
       CASE WHEN many THEN start_s + chunk * 570 ELSE start_s END AS start_s FROM chunks
WHERE NOT many OR chunk = 0 OR start_s >= 30""",
    ),
    "merge_clips": oracle(
        """SELECT episode_id, seg_no, start_s, round(CASE WHEN next IS NULL THEN duration_s
       ELSE greatest(0.0, next - start_s) END, 3) AS duration_s
FROM (SELECT *, lead(start_s) OVER (PARTITION BY episode_id ORDER BY start_s, offset_s, seg_no)
             AS next FROM kept)""",
        "segments",
        clips="""SELECT *, seg_no // 2 * 300 AS offset_s, (episode_id + seg_no // 2) % 5 = 4
       AS silent, seg_no % 7 = 5 AS is_blank FROM segments""",
        cuts="""SELECT episode_id, min(offset_s) AS cut FROM clips
WHERE silent AND offset_s > 0 AND episode_id % 2 = 1 GROUP BY episode_id""",
        kept="""SELECT c.episode_id, seg_no, offset_s, duration_s,
       CAST(seg_no % 2 * 60 + offset_s AS DOUBLE) AS start_s
FROM clips c LEFT JOIN cuts k ON k.episode_id = c.episode_id
WHERE NOT silent AND NOT is_blank AND (cut IS NULL OR offset_s < cut)""",
    ),
    "merge_summaries": oracle(
        """SELECT episode_id, sha256(string_agg(text, ' ' ORDER BY seg_no)) AS summary_hash
FROM segments WHERE seg_no % 3 <> 1 GROUP BY episode_id""",
        "segments",
    ),
    "parse_transcript": oracle(
        """SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY start_s, seg_no) - 1 AS seg_no,
       sha256(printf('[%02d:%02d:%02d] Ann B: ', seg_no // 400, seg_no // 60 % 60, seg_no % 60) || said)
         AS text_hash, start_s, duration_s
FROM (SELECT *, coalesce(lead(start_s) OVER (PARTITION BY episode_id ORDER BY seg_no) - start_s, 0.0)
        AS duration_s FROM said)""",
        **_SAID,
    ),
    "parse_transcript_lines": oracle(
        """SELECT episode_id, seg_no, sha256(said) AS text_hash, start_s,
       coalesce(lead(start_s) OVER (PARTITION BY episode_id ORDER BY seg_no) - start_s, 0.0)
         AS duration_s FROM said""",
        **_SAID,
    ),
    "text_as_transcript": oracle(
        f"""SELECT episode_id, CAST(0 AS BIGINT) AS seg_no, sha256({_strip('text')}) AS text_hash,
       'text' AS source, 'und' AS language, len(list_filter(regexp_split_to_array(text, '{_SP}+'),
       lambda w: w <> '')) AS word_count
FROM transcripts WHERE {_strip('text')} <> ''""",
        "transcripts",
    ),
    "chunk_plan": oracle(
        """SELECT episode_id, chunk, CAST(chunk * 570 AS DOUBLE) AS start_s,
       least(chunk * 570 + 600, d)::DOUBLE AS end_s
FROM (SELECT episode_id, d, unnest(range(0, CAST(floor((d - 30) / 570) AS BIGINT) + 1)) AS chunk
      FROM (SELECT episode_id, length(text)::DOUBLE / 2 AS d FROM transcripts) WHERE d > 900)""",
        "transcripts",
    ),
    "clip_plan": oracle(
        """SELECT episode_id, offset_s, least(offset_s + 300, d) AS end_s, length_assumed
FROM (SELECT episode_id, d, length_assumed, unnest(range(0, d, 300)) AS offset_s FROM (
  SELECT episode_id, episode_id % 5 = 0 OR length(text) = 0 AS length_assumed,
         CASE WHEN episode_id % 5 = 0 OR length(text) = 0 THEN 3600 ELSE length(text) END AS d
  FROM transcripts))""",
        "transcripts",
    ),
    "media_cost": oracle(
        """SELECT entry_id, round(size_bytes * 1000 / 1048576.0::DOUBLE * 0.000125::DOUBLE, 9)
       AS cost_usd FROM cache_entries""",
        "cache_entries",
    ),
    "chat_markdown": oracle(
        """SELECT conv_id, sha256('# My Notes: Talk ' || conv_id || E'\\n\\n**Podcast:** Show ' ||
       conv_id % 7 || E'\\n\\n## Interview Reflections\\n\\n' ||
       string_agg('### Q' || n || ': ' || q || E'\\n\\n' || r || E'\\n', E'\\n' ORDER BY pair))
       AS note_hash
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pair) AS n FROM (
  SELECT conv_id, turn // 2 AS pair, max(text) FILTER (role = 'user') AS q,
         max(text) FILTER (role = 'assistant') AS r FROM conversations GROUP BY ALL)
  WHERE q IS NOT NULL AND r IS NOT NULL) GROUP BY conv_id"""
    ),
    "ocr_lines": oracle(
        """SELECT conv_id AS doc_id, turn AS page_no, sha256(CASE WHEN turn % 5 = 4 THEN ''
       ELSE string_agg(line, chr(10) ORDER BY line_no) END) AS text_hash,
       CASE WHEN turn % 5 = 4 THEN 0.0 ELSE round(sum(s) / sum(n), 2) END::DOUBLE AS confidence
FROM (SELECT conv_id, turn, (i - 1) // 3 AS line_no, string_agg(w, ' ' ORDER BY i) AS line,
             sum(c) FILTER (c >= 0) AS s, count(*) FILTER (c >= 0) AS n
      FROM (SELECT conv_id, turn, i, words[i] AS w, CAST((i - 1) * 7 % 100 - 5 AS DOUBLE) AS c
            FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM spoken))
      GROUP BY ALL) GROUP BY conv_id, turn""",
        spoken=f"""SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '{_SP}+'),
       lambda w: w <> '') AS words FROM conversations""",
    ),
    "merge_pages": oracle(
        """SELECT doc_id, sha256(string_agg(t, chr(10) || chr(10) ORDER BY page_no) FILTER (t <> ''))
       AS text_hash,
       CASE WHEN bool_or(choice = 'ocr') AND bool_or(choice = 'sel') THEN 'hybrid'
            WHEN bool_or(choice = 'ocr') THEN 'ocr' ELSE 'selectable_text' END AS method,
       count(*) AS page_count, count(*) FILTER (warned) AS warnings
FROM chosen GROUP BY doc_id
HAVING NOT bool_or(choice IN ('none', 'weak')) AND bool_or(t <> '')""",
        **(_chosen := {
            "inputs": f"""SELECT conv_id AS doc_id, turn AS page_no, (conv_id + turn) % 6 AS k,
       {_normal('text')} AS whole,
       {_normal("split_part(text, ' ', 1)")} AS word FROM conversations""",
            "chosen": """SELECT doc_id, page_no, choice,
       CASE choice WHEN 'ocr' THEN whole WHEN 'sel' THEN sel ELSE '' END AS t,
       ask AND rendered AND (k = 5 OR (k = 4 AND sel <> '')) AS warned
FROM (SELECT *, CASE WHEN NOT ask THEN 'sel' WHEN NOT rendered THEN 'none'
             WHEN k = 5 THEN CASE WHEN sel <> '' THEN 'sel' ELSE 'empty' END
             WHEN k = 4 THEN CASE WHEN sel <> '' THEN 'sel' ELSE 'weak' END
             ELSE 'ocr' END AS choice
      FROM (SELECT *, length(sel) < 20 AS ask, doc_id % 4 <> 1 AS rendered
            FROM (SELECT *, CASE WHEN k < 3 THEN whole WHEN k = 3 THEN '' ELSE word END AS sel
                  FROM inputs)))""",
        }),
    ),
    "merge_pages_rejects": oracle(
        """SELECT doc_id, coalesce(CASE arg_min(choice, page_no) FILTER (choice IN ('none', 'weak'))
       WHEN 'none' THEN 'not rendered' WHEN 'weak' THEN 'weak ocr' END || ' on page ' ||
       min(page_no) FILTER (choice IN ('none', 'weak')), 'no readable text') AS reason
FROM chosen GROUP BY doc_id HAVING bool_or(choice IN ('none', 'weak')) OR NOT bool_or(t <> '')""",
        **_chosen,
    ),
    "provenance": oracle(
        f"""SELECT doc_id, strlen(text) AS size_bytes, sha256(text) AS source_sha256,
       length(s) AS text_characters, sha256(s) AS text_sha256
FROM (SELECT doc_id, text, {_strip('text')} AS s FROM documents)"""
    ),
    "pick_captions": oracle(
        """SELECT video_id, track_no, language, reason
FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY step, pref, gen, track_no) AS rn
      FROM ranked) WHERE rn = 1""",
        tracks="""SELECT doc_id // 3 AS video_id, doc_id AS track_no, CASE lang WHEN 'en' THEN 'en-GB'
       WHEN 'es' THEN 'en' ELSE lang END AS language FROM documents""",
        ranked="""
SELECT *, 1 AS step, 0 AS pref, (track_no % 2 = 0)::INT AS gen, 'preferred language en' AS reason
FROM tracks WHERE language = 'en'
UNION ALL SELECT *, 3, 0, 0, 'language variant ' || language FROM tracks WHERE language LIKE 'en-%'
UNION ALL SELECT *, 4, 1, 0, language || ' translated to nl' FROM tracks WHERE track_no % 3 = 0
UNION ALL SELECT *, 5, 0, 0, 'available language ' || language FROM tracks""",
    ),
}
