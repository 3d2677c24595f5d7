"""Text expressions: slugs, durations, sizes, counting, trimming, redaction.

Everything is a column expression. Whitespace and word characters follow Unicode, as
Java's ``\\s`` and ``\\w`` do not without being told.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]"
_WORD = r"\p{L}\p{N}_"


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+$", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+", "")


def blank(text: Column) -> Column:
    """True for null, empty and white space."""
    return F.coalesce(strip(text) == "", F.lit(True))


def _strip_dashes(text: Column) -> Column:
    return F.regexp_replace(text, "^-+|-+$", "")


def slug(text: Column, max_length: int = 50) -> Column:
    """File-system safe name; an over-long one is cut back to a whole word."""
    kept = F.regexp_replace(F.lower(text), rf"(?U)[^{_WORD}\s\x1c-\x1f-]", "")
    dashed = F.regexp_replace(kept, r"(?U)[\s\x1c-\x1f_-]+", "-")
    whole = _strip_dashes(dashed)
    cut = F.regexp_replace(F.substring(whole, 1, max_length), "-[^-]*$", "")
    return F.when(F.length(whole) > max_length, cut).otherwise(whole)


def path_slug(text: Column, max_length: int | None = None) -> Column:
    """Directory variant: underscores stay, the cut may fall inside a word."""
    kept = F.regexp_replace(F.lower(text), rf"(?U)[^{_WORD}\s\x1c-\x1f-]", "")
    whole = _strip_dashes(F.regexp_replace(kept, r"(?U)[\s\x1c-\x1f-]+", "-"))
    if max_length is None:
        return whole
    cut = F.regexp_replace(F.substring(whole, 1, max_length), "-+$", "")
    return F.when(F.length(whole) > max_length, cut).otherwise(whole)


def key_slug(name: Column) -> Column:
    """ASCII key of a feed name."""
    return _strip_dashes(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"))


def heading_slug(heading: Column) -> Column:
    """Anchor of a markdown heading: marks go first, then as ``key_slug``."""
    return key_slug(F.regexp_replace(strip(F.lower(heading)), r"[`*_~\[\]()]", ""))


def episode_key(podcast: Column, title: Column, published: Column) -> Column:
    return F.concat_ws(
        "-", slug(podcast, 30), F.date_format(published, "yyyy-MM-dd"), slug(title, 40)
    )


def episode_directory(
    podcast: Column, title: Column, published: Column, processed: Column
) -> Column:
    """``podcast/date-title``; the processing date stands in for a missing one."""
    day = F.date_format(F.coalesce(published, processed), "yyyy-MM-dd")
    return F.concat(path_slug(podcast), F.lit("/"), day, F.lit("-"), path_slug(title, 50))


def fmt_duration(seconds: Column) -> Column:
    """``H:MM:SS`` or ``M:SS``; ``Unknown`` for null."""
    whole = seconds.cast("bigint")
    hours, minutes, secs = _clock(whole)
    return (
        F.when(seconds.isNull(), "Unknown")
        .when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, secs))
        .otherwise(F.format_string("%d:%02d", minutes, secs))
    )


def fmt_duration_padded(seconds: Column) -> Column:
    """As ``fmt_duration`` with every part two digits wide."""
    hours, minutes, secs = _clock(F.floor(seconds).cast("bigint"))
    return (
        F.when(seconds.isNull(), "Unknown")
        .when(hours > 0, F.format_string("%02d:%02d:%02d", hours, minutes, secs))
        .otherwise(F.format_string("%02d:%02d", minutes, secs))
    )


def fmt_duration_short(seconds: Column) -> Column:
    """Largest whole unit: ``30s``, ``2m``, ``1h``, ``3d``."""

    def whole(divisor: int, unit: str) -> Column:
        return F.concat((seconds / divisor).cast("bigint").cast("string"), F.lit(unit))

    return (
        F.when(seconds < 60, whole(1, "s"))
        .when(seconds < 3600, whole(60, "m"))
        .when(seconds < 86400, whole(3600, "h"))
        .otherwise(whole(86400, "d"))
    )


def fmt_segment(start_s: Column, text: Column) -> Column:
    """``[MM:SS] text`` with minutes running past 59."""
    whole = start_s.cast("bigint")
    return F.format_string("[%02d:%02d] %s", _div(whole, 60), whole % 60, text)


def _div(number: Column, divisor: int) -> Column:
    return F.floor(number / divisor).cast("bigint")


def _clock(whole: Column) -> tuple[Column, Column, Column]:
    return _div(whole, 3600), _div(whole % 3600, 60), whole % 60


def fmt_size(size_bytes: Column) -> Column:
    kb, mb = 1024, 1024 * 1024
    return (
        F.when(size_bytes < kb, F.concat(size_bytes.cast("string"), F.lit(" B")))
        .when(size_bytes < mb, F.format_string("%.1f KB", F.bround(size_bytes / F.lit(float(kb)), 1)))
        .otherwise(F.format_string("%.1f MB", F.bround(size_bytes / F.lit(float(mb)), 1)))
    )


def word_count(text: Column) -> Column:
    """Tokens between white space."""
    return F.size(F.filter(F.split(text, f"{SPACE}+"), lambda t: t != "")).cast("bigint")


def est_tokens(text: Column) -> Column:
    """Four characters make a token, and a text has at least one."""
    return F.greatest(F.lit(1).cast("bigint"), count_tokens(text))


def count_tokens(text: Column) -> Column:
    """Estimate without the floor of one."""
    return _div(F.length(text), 4)


def normalize_text(text: Column) -> Column:
    """Trim every line, keep at most one blank line in a row, trim the whole."""
    lines = F.transform(F.split(text, r"\R|[\x1c-\x1e]"), strip)
    joined = F.array_join(lines, "\n")
    return strip(F.regexp_replace(joined, "\n{3,}", "\n\n"))


def truncate(text: Column, max_length: int, suffix: str = "...") -> Column:
    cut = F.concat(F.substring(text, 1, max_length - len(suffix)), F.lit(suffix))
    return F.when(F.length(text) <= max_length, text).otherwise(cut)


def truncate_words(text: Column, max_length: int) -> Column:
    """As ``truncate``, with white space before the dots removed."""
    cut = F.concat(rstrip(F.substring(text, 1, max_length - 3)), F.lit("..."))
    return F.when(F.length(text) <= max_length, text).otherwise(cut)


def truncate_url(url: Column, max_length: int = 50) -> Column:
    """Host and path within ``max_length``, keeping the host and a short last part."""
    from castloom.functions.urls import netloc, path

    host, rest = netloc(url), path(url)
    plain = F.concat(host, rest)
    half = (max_length - 3) // 2
    middle = F.concat(F.substring(host, 1, half), F.lit("..."), F.right(host, F.lit(half)))
    last = F.regexp_extract(rest, r"([^/]*)$", 1)
    remaining = F.lit(max_length - 3) - F.length(host)
    return (
        F.when(F.length(plain) <= max_length, plain)
        .when(F.length(host) > max_length - 3, middle)
        .when(
            (remaining > 0) & F.contains(rest, F.lit("/")) & (F.length(last) < remaining),
            F.concat(host, F.lit("/..."), last),
        )
        .otherwise(F.concat(host, F.lit("/...")))
    )


def title_case(filename: Column) -> Column:
    """Heading of a file: the stem in title case, dashes and underscores as blanks.

    A letter after anything but a letter is a capital, also after a digit or an apostrophe.
    """
    stem = F.regexp_replace(filename, r"(?<=.)\.[^.]+$", "")
    letter = r"[\p{Lu}\p{Ll}\p{Lt}]"
    words = F.split(F.lower(F.regexp_replace(stem, "[-_]", " ")), rf"(?<!{letter})(?={letter})")
    raised = F.transform(
        words,
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))),
    )
    return F.array_join(raised, "")


#: Key shapes and what stands in for them.
KEY_PATTERNS = (
    (r"AIza[A-Za-z0-9_-]+", "[REDACTED_GEMINI_KEY]"),
    (r"sk-ant-[A-Za-z0-9_-]+", "[REDACTED_CLAUDE_KEY]"),
)


def redact(text: Column, patterns: Sequence[tuple[str, str]] = KEY_PATTERNS) -> Column:
    for pattern, placeholder in patterns:
        text = F.regexp_replace(text, pattern, placeholder)
    return text


def path_part(name: Column) -> Column:
    """One safe path component, null when nothing is left."""
    safe = F.replace(name, F.lit(".."), F.lit(""))
    safe = F.regexp_replace(safe, r"[/\\]", "-")
    safe = F.regexp_replace(safe, r"\x00", "")
    return F.when(~blank(safe), safe)


def metadata_podcast(podcast: Column) -> Column:
    """Podcast name, or the inbox for direct links."""
    return F.coalesce(F.nullif(strip(podcast), F.lit("")), F.lit("_inbox"))


def metadata_title(title: Column, url: Column) -> Column:
    """Title, else one read off the URL, else a fixed one."""
    from castloom.functions.urls import title_from_url

    return F.coalesce(
        F.nullif(strip(title), F.lit("")), title_from_url(url), F.lit("Untitled capture")
    )


def megabytes(size_bytes: Column) -> Column:
    return F.bround(size_bytes / F.lit(1024.0 * 1024.0), 2)


def content_key(**parts: Column) -> Column:
    """SHA-256 of the named parts as JSON with sorted keys; null counts as ``unknown``."""
    named = [F.coalesce(parts[n].cast("string"), F.lit("unknown")).alias(n) for n in sorted(parts)]
    return F.sha2(F.to_json(F.struct(*named)), 256)


def media_key(url: Column) -> Column:
    """File name of cached media: 16 hexadecimal digits of the URL's hash."""
    return F.substring(F.sha2(url, 256), 1, 16)
