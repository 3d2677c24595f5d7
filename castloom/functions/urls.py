"""URL expressions: parts, kinds, video and channel ids, readable titles.

Parts are read with patterns rather than ``parse_url``: sources contain addresses that a
strict parser refuses although host and path are plain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from castloom.functions.text import key_slug, strip

#: Fixed values.
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be")
FEED_PATH = "/feeds/videos.xml"
MEDIA_SUFFIXES = (
    ".aac", ".aif", ".aiff", ".avi", ".flac", ".m4a", ".m4v", ".mkv", ".mov", ".mp3",
    ".mp4", ".mpeg", ".mpg", ".oga", ".ogg", ".opus", ".wav", ".webm",
)
TITLE_SUFFIXES = (
    ".mp3", ".m4a", ".wav", ".aac", ".ogg", ".flac", ".mp4", ".webm", ".mkv", ".m4v", ".mov",
)
GENERIC_TITLES = (
    "audio", "embed", "episode", "feed", "feeds", "live", "playlist", "shorts",
    "videosxml", "watch",
)
KIND_LABELS = {
    "youtube": "YouTube",
    "rss": "RSS feed",
    "podcast": "Podcast",
    "media": "Media file",
    "web": "Web source",
}

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def _empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def hostname(url: Column) -> Column:
    bare = F.regexp_replace(netloc(url), r"^.*@|:[0-9]*$", "")
    return F.lower(bare)


def path(url: Column) -> Column:
    after = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?", "")
    return F.regexp_replace(F.regexp_extract(after, r"^([^?#]*)", 1), r";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def decode(text: Column, *, plus: bool = True) -> Column:
    """Percent decoding; a text that is not well encoded stays as it is."""
    source = text if plus else F.replace(text, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(source), text)


def query_value(url: Column, name: str) -> Column:
    """First non-empty value of a query field, decoded; null without one."""
    raw = F.regexp_extract(query(url), rf"(?:^|&){name}=([^&]+)", 1)
    return _empty_to_null(decode(raw))


def is_video_host(url: Column) -> Column:
    return (scheme(url) != "") & hostname(url).isin(*VIDEO_HOSTS)


def is_video_url(url: Column) -> Column:
    """Pages the caption reader accepts."""
    return F.regexp_like(
        url, F.lit(r"(?i)youtube\.com/(?:watch|embed/|shorts/|live/)|youtu\.be/")
    )


def is_playlist(url: Column) -> Column:
    listed = F.regexp_like(query(url), F.lit(r"(?:^|&)list=[^&]"))
    where = path(url)
    return is_video_host(url) & (
        listed | (where == "/playlist") | where.startswith("/playlist/")
    )


def video_id(url: Column) -> Column:
    """Lenient rule: the host only has to contain the site's name."""
    host, where = netloc(url), path(url)
    watch = F.when(
        F.contains(host, F.lit("youtube.com")) & F.contains(where, F.lit("/watch")),
        query_value(url, "v"),
    )
    short = F.when(
        F.contains(host, F.lit("youtu.be")),
        _empty_to_null(F.regexp_replace(where, "^/+|/+$", "")),
    )
    paths = [
        _empty_to_null(F.regexp_extract(url, rf"youtube\.com/{part}/([^/?]+)", 1))
        for part in ("embed", "shorts", "live")
    ]
    return F.coalesce(watch, short, *paths)


def watch_url(url: Column) -> Column:
    """Strict rule: known hosts only; anything else is returned unchanged."""
    host, where = F.lower(netloc(url)), path(url)
    short = F.regexp_extract(where, r"^/*([^/]+)", 1)
    nested = F.regexp_extract(where, r"^/(?:shorts|live)/+([^/]+)", 1)
    found = _empty_to_null(
        F.when(host == "youtu.be", short).when(
            host.isin("youtube.com", "www.youtube.com", "m.youtube.com"),
            F.when(where == "/watch", F.coalesce(query_value(url, "v"), F.lit(""))).otherwise(
                nested
            ),
        )
    )
    return F.coalesce(F.concat(F.lit("https://www.youtube.com/watch?v="), found), url)


def channel_id(url: Column) -> Column:
    """Channel named by a video feed's address."""
    feed = is_video_host(url) & (path(url) == FEED_PATH)
    return F.when(feed, query_value(url, "channel_id"))


def channel_id_from_path(url: Column) -> Column:
    return F.when(
        is_video_host(url),
        _empty_to_null(F.regexp_extract(path(url), r"^/channel/(UC[A-Za-z0-9_-]+)/?", 1)),
    )


def _suffix(where: Column) -> Column:
    name = F.regexp_extract(where, r"([^/]+)/*$", 1)
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def with_scheme(value: Column) -> Column:
    """``example.com/path`` is taken as https."""
    bare = (scheme(value) == "") & F.contains(value, F.lit(".")) & F.contains(value, F.lit("/"))
    return F.when(bare, F.concat(F.lit("https://"), value)).otherwise(value)


def source_kind(
    value: Column, saved_feed: Column | None = None, local_file: Column | None = None
) -> Column:
    """Kind of a raw input; the flags tell whether it names a saved feed or a file."""
    text = strip(value)
    url = with_scheme(text)
    supported = scheme(url).isin("http", "https") & (netloc(url) != "")
    false = F.lit(False)
    return (
        F.when(text == "-", "stdin")
        .when(saved_feed if saved_feed is not None else false, "saved_feed")
        .when(local_file if local_file is not None else false, "local_file")
        .when(scheme(url) == "", "saved_feed")
        .when(~supported, "unknown_url")
        .when(F.lower(netloc(url)).isin(*VIDEO_HOSTS), "youtube")
        .when(_suffix(F.lower(path(url))).isin(*MEDIA_SUFFIXES), "direct_media")
        .otherwise("url")
    )


def _is_web_address(url: Column) -> Column:
    special = scheme(url).isin("http", "https", "ftp", "ws", "wss")
    return F.coalesce((scheme(url) != "") & (~special | (hostname(url) != "")), F.lit(False))


def source_kind_web(url: Column) -> Column:
    """Kind shown in the library."""
    host, where = hostname(url), F.lower(path(url))
    feed = where.endswith(".rss") | where.endswith(".xml") | F.contains(where, F.lit("/feed"))
    return (
        F.when(~_is_web_address(url), "unknown")
        .when(host.isin(*VIDEO_HOSTS), "youtube")
        .when(feed, "rss")
        .when(F.regexp_like(where, F.lit(r"\.(mp3|m4a|wav|mp4|webm|aac)$")), "media")
        .when(F.contains(host, F.lit("podcast")), "podcast")
        .otherwise("web")
    )


def kind_label(kind: Column) -> Column:
    label = F.lit("Source")
    for name, text in KIND_LABELS.items():
        label = F.when(kind == name, text).otherwise(label)
    return label


def source_host(url: Column) -> Column:
    return (
        F.when(F.coalesce(url == "", F.lit(True)), "Unknown source")
        .when(_is_web_address(url), F.regexp_replace(hostname(url), r"^www\.", ""))
        .otherwise(url)
    )


def normalize_url(url: Column) -> Column:
    """Address without its fragment, scheme and host in lower case, root path as ``/``."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", 1))
    head = F.regexp_replace(head, r"^(http://.*):80$|^(https://.*):443$", "$1$2")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*", "")
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(head == "", bare).otherwise(F.concat(head, rest))


def title_from_url(url: Column) -> Column:
    """Readable title from the last path part; null when it is empty or generic."""
    name = strip(decode(F.regexp_extract(path(url), r"([^/]+)/*$", 1), plus=False))
    ending = "|".join(s.replace(".", r"\.") for s in TITLE_SUFFIXES)
    # What separates words, and a file ending, in one pass; then the blanks and dots around.
    words = F.regexp_replace(
        F.regexp_replace(name, rf"(?Ui)(?:{ending})$|[-_+\s\x1c-\x1f]+", " "), r"^[ .]+|[ .]+$", ""
    )
    letters = F.regexp_replace(F.lower(words), "[^a-z0-9]+", "")
    return F.when((words != "") & ~letters.isin(*GENERIC_TITLES), words)


def feed_name_base(channel_name: Column, feed_url: Column) -> Column:
    """Feed name from the channel's name, else its id, else a fixed one."""
    cid = F.lower(query_value(feed_url, "channel_id"))
    return F.coalesce(
        _empty_to_null(key_slug(channel_name)), _empty_to_null(cid), F.lit("youtube-feed")
    )
