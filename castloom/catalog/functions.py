"""Text and URL expressions over whole documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from castloom.catalog import bindings as b
from castloom.catalog.bindings import oracle
from castloom.functions import text as t
from castloom.functions import urls as u

_SP = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_NOT_SLUG = r"[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x85\p{Z}-]"
_SEP = r"[\s\x0b\x1c-\x1f\x85\p{Z}_-]+"
_SEP_KEPT = r"[\s\x0b\x1c-\x1f\x85\p{Z}-]+"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def _slug(x: str, n: int) -> str:
    whole = (
        f"trim(regexp_replace(regexp_replace(lower({x}), '{_NOT_SLUG}', '', 'g'), "
        f"'{_SEP}', '-', 'g'), '-')"
    )
    return (
        f"CASE WHEN length({whole}) > {n} "
        f"THEN regexp_replace(left({whole}, {n}), '-[^-]*$', '') ELSE {whole} END"
    )


def _path_slug(x: str, n: int | None) -> str:
    whole = (
        f"trim(regexp_replace(regexp_replace(lower({x}), '{_NOT_SLUG}', '', 'g'), "
        f"'{_SEP_KEPT}', '-', 'g'), '-')"
    )
    if n is None:
        return whole
    return f"CASE WHEN length({whole}) > {n} THEN rtrim(left({whole}, {n}), '-') ELSE {whole} END"


def _key(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"


_DAY = "TIMESTAMP '2024-01-01 00:00:00' + episode_id * INTERVAL '1' DAY"


def _documents(spark, folder):
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("episode_id").cast("int"))
    return b.transcripts(spark, folder).withColumn("day", day.cast("timestamp"))


def slug(spark, folder):
    return _documents(spark, folder).select("episode_id", t.slug(F.col("text"), 50).alias("slug"))


def path_slug(spark, folder):
    return _documents(spark, folder).select(
        "episode_id", t.path_slug(F.concat_ws("_", "podcast", "text"), 50).alias("slug")
    )


def key_slug(spark, folder):
    return _documents(spark, folder).select(
        "episode_id",
        F.sha2(t.key_slug(F.col("text")), 256).alias("key_hash"),
        F.length(t.heading_slug(F.col("text"))).cast("bigint").alias("heading_length"),
    )


def episode_key(spark, folder):
    rows = _documents(spark, folder)
    podcast, title = F.col("podcast"), F.col("text")
    late = F.when(F.col("episode_id") % 2 == 0, F.col("day"))
    return rows.select(
        "episode_id",
        t.episode_key(podcast, title, F.col("day")).alias("key"),
        t.episode_directory(
            podcast, title, late, F.lit("2025-06-01").cast("timestamp")
        ).alias("directory"),
    )


def fmt_duration(spark, folder):
    seconds = F.when(F.col("seg_no") % 5 != 4, F.col("duration_s") * 40 + F.col("start_s"))
    rows = b.segments(spark, folder).withColumn("d", seconds)
    d = F.col("d")
    return rows.select(
        "episode_id",
        "seg_no",
        t.fmt_duration(d).alias("plain"),
        t.fmt_duration_padded(d).alias("padded"),
        t.fmt_duration_short(d).alias("short"),
        F.sha2(t.fmt_segment(F.col("start_s"), F.col("text")), 256).alias("segment_hash"),
    )


def fmt_size(spark, folder):
    size = F.col("size_bytes") * 97 * (F.col("entry_id") % 9)
    return b.cache_entries(spark, folder).select("entry_id", t.fmt_size(size).alias("size"))


def word_count(spark, folder):
    return _documents(spark, folder).select("episode_id", t.word_count(F.col("text")).alias("words"))


def est_tokens(spark, folder):
    text = F.col("text")
    return _documents(spark, folder).select(
        "episode_id",
        t.est_tokens(text).alias("tokens"),
        (t.est_tokens(text) + 2000).alias("prompt_tokens"),
        t.count_tokens(F.col("language")).alias("counter_tokens"),
    )


def normalize_text(spark, folder):
    return _documents(spark, folder).select(
        "episode_id",
        F.sha2(t.normalize_text(F.col("text")), 256).alias("text_hash"),
        F.length(t.normalize_text(F.col("text"))).cast("bigint").alias("length"),
    )


def truncate(spark, folder):
    text = F.col("text")
    return _documents(spark, folder).select(
        "episode_id",
        t.truncate(text, 80).alias("cut"),
        F.sha2(t.truncate_words(text, 1600), 256).alias("words_hash"),
    )


def truncate_url(spark, folder):
    return b.sources(spark, folder).select(
        "source_id",
        t.truncate_url(F.col("url"), 50).alias("at_50"),
        t.truncate_url(F.col("url"), 26).alias("at_26"),
        t.truncate_url(F.col("url"), 12).alias("at_12"),
    )


def title_case(spark, folder):
    name = F.concat(F.col("template_name"), F.lit("_and-more_what's 3rd o'clock.md"))
    return b.results(spark, folder).select("episode_id", t.title_case(name).alias("heading"))


def rounding(spark, folder):
    return b.cache_entries(spark, folder).select(
        "entry_id", t.megabytes(F.col("size_bytes") * 1000).alias("megabytes")
    )


def content_key(spark, folder):
    return _documents(spark, folder).select(
        "episode_id",
        t.content_key(
            template=F.lit("summary"),
            transcript_hash=F.sha2("text", 256),
            provider=F.when(F.col("episode_id") % 4 != 0, F.col("podcast")),
        ).alias("key"),
        t.media_key(F.col("text")).alias("media_key"),
    )


#: Secrets as they occur in the documents.
TOKEN = (r'token = "[0-9a-f]{40}"', 'token = "[REDACTED]"')


def redact(spark, folder):
    clean = t.redact(F.col("text"), [*t.KEY_PATTERNS, TOKEN])
    return _documents(spark, folder).select(
        "episode_id",
        F.sha2(clean, 256).alias("clean_hash"),
        (clean != F.col("text")).alias("changed"),
    )


def metadata_defaults(spark, folder):
    rows = b.sources(spark, folder)
    podcast = F.when(F.col("source_id") % 3 == 0, F.lit(" ")).otherwise(F.col("host"))
    title = F.when(F.col("source_id") % 4 == 0, F.concat(F.lit(" "), F.col("host")))
    return rows.select(
        "source_id",
        t.metadata_podcast(podcast).alias("podcast"),
        t.metadata_title(title, F.col("url")).alias("title"),
    )


def path_part(spark, folder):
    return b.sources(spark, folder).select(
        "source_id", t.path_part(F.concat(F.lit("../"), F.col("url"))).alias("part")
    )


def source_kind(spark, folder):
    number, host = F.col("source_id") % 7, F.col("host")
    value = (
        F.when(number == 0, F.lit(" - "))
        .when(number == 1, F.concat(host, F.lit("/a/b.html")))
        .when(number == 2, F.concat(F.lit("https://"), host, F.lit("/audio/x.MP3?k=1")))
        .when(number == 3, F.concat(F.lit("ftp://"), host, F.lit("/x")))
        .when(number == 4, host)
        .when(number == 5, F.concat(F.lit("https://YouTu.be/v"), F.col("source_id")))
        .otherwise(F.col("url"))
    )
    saved = F.col("host").startswith("m.")
    return b.sources(spark, folder).select("source_id", u.source_kind(value, saved).alias("kind"))


def source_kind_web(spark, folder):
    number = F.col("source_id") % 6
    url = (
        F.when(number == 0, F.concat(F.lit("https://"), "host", F.lit("/Feed/a")))
        .when(number == 1, F.concat(F.lit("https://"), "host", F.lit("/x.M4A")))
        .when(number == 2, F.concat(F.lit("https://www.Youtube.com/watch?v="), "source_id"))
        .when(number == 3, F.concat(F.lit("https://podcasts."), "host", F.lit("/s")))
        .when(number == 4, F.col("url"))
        .otherwise(F.col("host"))
    )
    kind = u.source_kind_web(url)
    return b.sources(spark, folder).select(
        "source_id",
        kind.alias("kind"),
        u.kind_label(kind).alias("label"),
        u.source_host(url).alias("shown_host"),
    )


_VIDEO_CASES = (
    "https://www.youtube.com/watch?list=PL1&v=vid{n}",
    "https://youtu.be/vid{n}?t=3",
    "https://youtube.com/embed/vid{n}?x=1",
    "https://www.youtube.com/shorts/vid{n}",
    "https://m.youtube.com/live/vid{n}/",
    "https://www.youtube.com/feeds/videos.xml?channel_id=UC{n}",
    "https://www.youtube.com/channel/UC{n}/videos",
    "https://www.youtube.com/playlist?list=PL{n}",
)


def url_parts(spark, folder):
    number = F.col("source_id")
    url = F.col("url")
    for i, case in enumerate(_VIDEO_CASES):
        before, after = case.split("{n}")
        built = F.concat(F.lit(before), number, F.lit(after))
        url = F.when(number % 9 == i, built).otherwise(url)
    rows = b.sources(spark, folder).withColumn("address", url)
    a = F.col("address")
    return rows.select(
        "source_id",
        u.video_id(a).alias("video_id"),
        u.watch_url(a).alias("watch_url"),
        u.channel_id(a).alias("channel_id"),
        u.channel_id_from_path(a).alias("path_channel_id"),
        u.is_playlist(a).alias("is_playlist"),
        u.is_video_host(a).alias("is_video_host"),
        u.is_video_url(a).alias("is_video_url"),
    )


def normalize_url(spark, folder):
    return b.sources(spark, folder).select(
        "source_id",
        u.normalize_url(F.col("url")).alias("normalized"),
        u.title_from_url(F.concat("url", F.lit("/my%20Show_No+1.mp3"))).alias("title"),
        u.title_from_url(F.col("url")).alias("plain_title"),
    )


QUERIES = {
    "slug": slug,
    "path_slug": path_slug,
    "key_slug": key_slug,
    "episode_key": episode_key,
    "fmt_duration": fmt_duration,
    "fmt_size": fmt_size,
    "word_count": word_count,
    "est_tokens": est_tokens,
    "normalize_text": normalize_text,
    "truncate": truncate,
    "truncate_url": truncate_url,
    "title_case": title_case,
    "rounding": rounding,
    "content_key": content_key,
    "redact": redact,
    "metadata_defaults": metadata_defaults,
    "path_part": path_part,
    "source_kind": source_kind,
    "source_kind_web": source_kind_web,
    "url_parts": url_parts,
    "normalize_url": normalize_url,
}

_HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"


def _short_url(n: int) -> str:
    half = (n - 3) // 2
    return f"""CASE WHEN length(h || p) <= {n} THEN h || p
         WHEN length(h) > {n - 3} THEN left(h, {half}) || '...' || right(h, {half})
         WHEN {n - 3} - length(h) > 0 AND contains(p, '/')
              AND length(regexp_extract(p, '[^/]*$', 0)) < {n - 3} - length(h)
           THEN h || '/...' || regexp_extract(p, '[^/]*$', 0)
         ELSE h || '/...' END"""


_ADDRESS = (
    "SELECT source_id, CASE source_id % 9 "
    + " ".join(
        f"WHEN {i} THEN concat('{c.split('{n}')[0]}', source_id, '{c.split('{n}')[1]}')"
        for i, c in enumerate(_VIDEO_CASES)
    )
    + " ELSE url END AS a FROM sources"
)

_D = "CAST(floor(d) AS BIGINT)"

ORACLES = {
    "slug": oracle(f"SELECT episode_id, {_slug('text', 50)} AS slug FROM transcripts", "transcripts"),
    "path_slug": oracle(
        f"SELECT episode_id, {_path_slug('x', 50)} AS slug FROM joined",
        "transcripts",
        joined="SELECT episode_id, concat(podcast, '_', text) AS x FROM transcripts",
    ),
    "key_slug": oracle(
        f"""SELECT episode_id, sha256({_key('text')}) AS key_hash,
       length({_key("regexp_replace(" + _strip('lower(text)') + ", '[`*_~\\[\\]()]', '', 'g')")})
         AS heading_length FROM transcripts""",
        "transcripts",
    ),
    "episode_key": oracle(
        f"""SELECT episode_id,
       {_slug('podcast', 30)} || '-' || strftime({_DAY}, '%Y-%m-%d') || '-' || {_slug('text', 40)}
         AS key,
       {_path_slug('podcast', None)} || '/' || strftime(CASE WHEN episode_id % 2 = 0 THEN {_DAY}
         ELSE TIMESTAMP '2025-06-01' END, '%Y-%m-%d') || '-' || {_path_slug('text', 50)}
         AS directory FROM transcripts""",
        "transcripts",
    ),
    "fmt_duration": oracle(
        f"""SELECT episode_id, seg_no,
       CASE WHEN d IS NULL THEN 'Unknown'
            WHEN {_D} >= 3600 THEN printf('%d:%02d:%02d', {_D} // 3600, {_D} % 3600 // 60, {_D} % 60)
            ELSE printf('%d:%02d', {_D} // 60, {_D} % 60) END AS plain,
       CASE WHEN d IS NULL THEN 'Unknown'
            WHEN {_D} >= 3600
              THEN printf('%02d:%02d:%02d', {_D} // 3600, {_D} % 3600 // 60, {_D} % 60)
            ELSE printf('%02d:%02d', {_D} // 60, {_D} % 60) END AS padded,
       CASE WHEN d IS NULL THEN NULL WHEN d < 60 THEN {_D} || 's'
            WHEN d < 3600 THEN {_D} // 60 || 'm' WHEN d < 86400 THEN {_D} // 3600 || 'h'
            ELSE {_D} // 86400 || 'd' END AS short,
       sha256(printf('[%02d:%02d] ', CAST(start_s AS BIGINT) // 60, CAST(start_s AS BIGINT) % 60)
              || text) AS segment_hash FROM timed""",
        "segments",
        timed="""SELECT *, CASE WHEN seg_no % 5 <> 4 THEN duration_s * 40 + start_s END AS d
FROM segments""",
    ),
    "fmt_size": oracle(
        """SELECT entry_id, CASE WHEN s < 1024 THEN s || ' B'
       WHEN s < 1048576 THEN format('{:.1f} KB', s / 1024.0::DOUBLE)
       ELSE format('{:.1f} MB', s / 1048576.0::DOUBLE) END AS size FROM sized""",
        "cache_entries",
        sized="SELECT entry_id, size_bytes * 97 * (entry_id % 9) AS s FROM cache_entries",
    ),
    "word_count": oracle(
        f"""SELECT episode_id, len(list_filter(regexp_split_to_array(text, '{_SP}+'),
       lambda w: w <> '')) AS words FROM transcripts""",
        "transcripts",
    ),
    "est_tokens": oracle(
        """SELECT episode_id, greatest(1, length(text) // 4) AS tokens,
       greatest(1, length(text) // 4) + 2000 AS prompt_tokens,
       length(language) // 4 AS counter_tokens FROM transcripts""",
        "transcripts",
    ),
    "normalize_text": oracle(
        "SELECT episode_id, sha256(n) AS text_hash, length(n) AS length FROM normal",
        "transcripts",
        normal=f"""SELECT episode_id, {_strip(
            "regexp_replace(array_to_string(list_transform(regexp_split_to_array(text, "
            "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85]'), lambda l: " + _strip('l') + "), chr(10)), "
            "'\\n{3,}', chr(10) || chr(10), 'g')"
        )} AS n FROM transcripts""",
    ),
    "truncate": oracle(
        f"""SELECT episode_id,
       CASE WHEN length(text) <= 80 THEN text ELSE left(text, 77) || '...' END AS cut,
       sha256(CASE WHEN length(text) <= 1600 THEN text
              ELSE regexp_replace(left(text, 1597), '{_SP}+$', '') || '...' END) AS words_hash
FROM transcripts""",
        "transcripts",
    ),
    "truncate_url": oracle(
        f"""SELECT source_id, {_short_url(50)} AS at_50, {_short_url(26)} AS at_26,
       {_short_url(12)} AS at_12 FROM parts""",
        "sources",
        parts=f"SELECT source_id, {_HOST} AS h, {_PATH} AS p FROM sources",
    ),
    "title_case": oracle(
        """SELECT episode_id, CASE template_name WHEN 'summary' THEN 'Summary And More What''S 3Rd O''Clock'
       WHEN 'quotes' THEN 'Quotes And More What''S 3Rd O''Clock' ELSE 'Key Concepts And More What''S 3Rd O''Clock' END AS heading
FROM results""",
        "results",
    ),
    "rounding": oracle(
        """SELECT entry_id,
       CAST(format('{:.2f}', size_bytes * 1000 / 1048576.0::DOUBLE) AS DOUBLE) AS megabytes
FROM cache_entries""",
        "cache_entries",
    ),
    "content_key": oracle(
        """SELECT episode_id, sha256('{"provider":"' ||
         coalesce(CASE WHEN episode_id % 4 <> 0 THEN podcast END, 'unknown') ||
         '","template":"summary","transcript_hash":"' || sha256(text) || '"}') AS key,
       left(sha256(text), 16) AS media_key FROM transcripts""",
        "transcripts",
    ),
    "redact": oracle(
        "SELECT episode_id, sha256(clean) AS clean_hash, clean <> text AS changed FROM cleaned",
        "transcripts",
        cleaned=f"""SELECT episode_id, text, regexp_replace(regexp_replace(regexp_replace(text,
       'AIza[A-Za-z0-9_-]+', '[REDACTED_GEMINI_KEY]', 'g'),
       'sk-ant-[A-Za-z0-9_-]+', '[REDACTED_CLAUDE_KEY]', 'g'),
       '{TOKEN[0]}', '{TOKEN[1]}', 'g') AS clean FROM transcripts""",
    ),
    "metadata_defaults": oracle(
        """SELECT source_id, CASE WHEN source_id % 3 = 0 THEN '_inbox' ELSE host END AS podcast,
       CASE WHEN source_id % 4 = 0 THEN host
            ELSE coalesce(nullif(regexp_replace(regexp_extract(
              regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '([^/]+)/*$', 1),
              '[-_+]+', ' ', 'g'), ''), 'Untitled capture') END AS title FROM sources""",
        "sources",
    ),
    "path_part": oracle(
        r"""SELECT source_id, regexp_replace(replace('../' || url, '..', ''), '[/\\]', '-', 'g')
       AS part FROM sources""",
        "sources",
    ),
    "source_kind": oracle(
        """SELECT source_id, CASE WHEN source_id % 7 = 0 THEN 'stdin'
       WHEN starts_with(host, 'm.') THEN 'saved_feed'
       WHEN source_id % 7 = 2 THEN 'direct_media' WHEN source_id % 7 = 3 THEN 'unknown_url'
       WHEN source_id % 7 = 4 THEN 'saved_feed' WHEN source_id % 7 = 5 THEN 'youtube'
       ELSE 'url' END AS kind FROM sources""",
        "sources",
    ),
    "source_kind_web": oracle(
        """SELECT source_id, kind, CASE kind WHEN 'rss' THEN 'RSS feed' WHEN 'media' THEN 'Media file'
       WHEN 'youtube' THEN 'YouTube' WHEN 'podcast' THEN 'Podcast' WHEN 'web' THEN 'Web source'
       ELSE 'Source' END AS label,
       CASE source_id % 6 WHEN 2 THEN 'youtube.com' WHEN 3 THEN 'podcasts.' || host
            WHEN 5 THEN host ELSE regexp_replace(host, '^www\\.', '') END AS shown_host FROM kinds""",
        "sources",
        kinds="""SELECT *, CASE source_id % 6 WHEN 0 THEN 'rss' WHEN 1 THEN 'media'
       WHEN 2 THEN 'youtube' WHEN 3 THEN 'podcast' WHEN 5 THEN 'unknown'
       ELSE CASE WHEN contains(lower(url), '/feed') THEN 'rss' ELSE 'web' END END AS kind
FROM sources""",
    ),
    "url_parts": oracle(
        """SELECT source_id,
       CASE WHEN source_id % 9 < 5 THEN concat('vid', source_id) END AS video_id,
       CASE WHEN source_id % 9 IN (0, 1, 3, 4)
            THEN concat('https://www.youtube.com/watch?v=vid', source_id) ELSE a END AS watch_url,
       CASE WHEN source_id % 9 = 5 THEN concat('UC', source_id) END AS channel_id,
       CASE WHEN source_id % 9 = 6 THEN concat('UC', source_id) END AS path_channel_id,
       source_id % 9 IN (0, 7) AS is_playlist, source_id % 9 < 8 AS is_video_host,
       source_id % 9 < 5 AS is_video_url FROM addresses""",
        "sources",
        addresses=_ADDRESS,
    ),
    "normalize_url": oracle(
        """SELECT source_id, CASE WHEN regexp_matches(bare, '^https?://[^/]*$') THEN bare || '/'
       ELSE bare END AS normalized,
       CASE WHEN regexp_matches(url, '[?#]') THEN last ELSE 'my Show No 1' END AS title,
       last AS plain_title FROM parts""",
        "sources",
        parts="""SELECT source_id, url, regexp_replace(url, '#.*$', '') AS bare,
       nullif(regexp_replace(regexp_extract(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1),
         '([^/]+)/*$', 1), '[-_+]+', ' ', 'g'), '') AS last FROM sources""",
    ),
}
