"""Feed documents (RSS 2.0 and Atom) as a table of entries in feed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castloom.operators.ordered import positions

_ITEM = (
    "title string, link string, guid string, pubDate string, description string, "
    "`content:encoded` string, enclosure array<struct<_url string, _type string>>, "
    "`itunes:duration` string, `itunes:episode` string, `itunes:season` string"
)
_RSS = f"title string, item array<struct<{_ITEM}>>"
_ATOM = (
    "title string, entry array<struct<title string, id string, "
    "link array<struct<_rel string, _href string, _type string>>, published string, "
    "updated string, summary string, content array<string>, `yt:videoId` string, "
    "`media:group` struct<`media:description` string>>>"
)


def _read(spark: SparkSession, paths, tag: str, schema: str) -> DataFrame:
    xml = spark.read.format("xml").option("rowTag", tag).schema(schema)
    return xml.load(paths).withColumn("file", F.col("_metadata.file_path"))


def _text(value: Column) -> Column:
    return value.cast("string")


def _entry(
    *, title, link, enclosures, links, video, published, updated, summary, content, duration,
    episode, season, entry_id,
) -> list[Column]:
    none = F.lit(None)
    return [
        F.trim(title).alias("title"),
        _text(link).alias("link"),
        enclosures.alias("enclosures"),
        links.alias("links"),
        _text(video).alias("yt_videoid"),
        _text(published).alias("published"),
        _text(updated).alias("updated"),
        _text(summary).alias("summary"),
        _text(none).alias("description"),
        content.alias("content"),
        _text(duration).alias("itunes_duration"),
        _text(episode).alias("itunes_episode"),
        _text(season).alias("itunes_season"),
        _text(entry_id).alias("id"),
        _text(none).alias("guid"),
    ]


def _rss_entry(i: str) -> list[Column]:
    c, none = (lambda name: F.col(f"{i}.`{name}`")), F.lit(None)
    enclosures = F.transform(
        c("enclosure"),
        lambda e: F.struct(
            e["_type"].alias("type"), e["_url"].alias("href"), F.lit(None).cast("string").alias("url")
        ),
    )
    content = F.when(
        c("content:encoded").isNotNull(), F.array(F.struct(c("content:encoded").alias("value")))
    )
    return _entry(
        title=c("title"), link=c("link"), enclosures=enclosures,
        links=none.cast("array<struct<rel:string,href:string>>"), video=none,
        published=c("pubDate"), updated=none, summary=c("description"), content=content,
        duration=c("itunes:duration"), episode=c("itunes:episode"), season=c("itunes:season"),
        entry_id=c("guid"),
    )


def _atom_entry(i: str) -> list[Column]:
    c, none = (lambda name: F.col(f"{i}.`{name}`")), F.lit(None)
    rel = lambda x: F.coalesce(x["_rel"], F.lit("alternate"))
    enclosed = F.filter(c("link"), lambda x: rel(x) == "enclosure")
    enclosures = F.transform(
        enclosed,
        lambda x: F.struct(
            x["_type"].alias("type"), x["_href"].alias("href"), F.lit(None).cast("string").alias("url")
        ),
    )
    links = F.transform(
        c("link"), lambda x: F.struct(rel(x).alias("rel"), x["_href"].alias("href"))
    )
    first = F.get(F.filter(c("link"), lambda x: rel(x) == "alternate"), F.lit(0))["_href"]
    content = F.transform(c("content"), lambda x: F.struct(x.alias("value")))
    return _entry(
        title=c("title"), link=first, enclosures=enclosures, links=links, video=c("yt:videoId"),
        published=c("published"), updated=c("updated"),
        summary=F.coalesce(c("summary"), c("media:group")["media:description"]),
        content=content, duration=none, episode=none, season=none, entry_id=c("id"),
    )


def read_feeds(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Entries of all feed documents, numbered in feed order.

    Both dialects are read with fixed schemas (inference would take ``01:02:03`` for a
    time of day). The order comes from the array of entries within one document, so it
    does not depend on how files are split.
    """
    rss = _read(spark, paths, "channel", _RSS).select(
        F.trim("title").alias("feed"), "file", F.posexplode("item").alias("at", "i")
    )
    atom = _read(spark, paths, "feed", _ATOM).select(
        F.trim("title").alias("feed"), "file", F.posexplode("entry").alias("at", "i")
    )
    head = ["feed", "file", (F.col("at") + 1).cast("bigint").alias("position")]
    return rss.select(*head, *_rss_entry("i")).unionByName(atom.select(*head, *_atom_entry("i")))


def read_cut_feeds(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Entries of RSS documents that end early and give no entry in ``read_feeds``.

    Such a document, and its last item, read as rows of nulls. Only whole items are kept.
    They are numbered in the order of the file: rows of a split rise within it, and splits of
    a file are told apart by where they start.
    """
    read = _read(spark, paths, "channel", "title string, item array<struct<title string>>")
    whole = read.where("title IS NOT NULL OR item IS NOT NULL").select("file").distinct()
    items = (
        _read(spark, paths, "item", _ITEM)
        .where("coalesce(title, link, guid, pubDate, description) IS NOT NULL OR enclosure IS NOT NULL")
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("block", F.expr("input_file_block_start()"))
    )
    cut = items.join(whole, "file", "left_anti")
    cut = positions(cut, ["file"], ["block", "row"], "at").drop("block", "row")
    packed = cut.select("file", "at", F.struct(*[f"`{c}`" for c in cut.columns if c not in ("file", "at")]).alias("i"))
    return packed.select(
        F.lit(None).cast("string").alias("feed"), "file", F.col("at").alias("position"), *_rss_entry("i")
    )


def empty_feeds(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Documents without a single entry, which count as errors."""
    rss = _read(spark, paths, "channel", "title string, item array<struct<title string>>")
    atom = _read(spark, paths, "feed", "title string, entry array<struct<title string>>")
    reason = F.lit("no entries").alias("reason")
    return rss.where("item IS NULL AND title IS NOT NULL").select("file", reason).unionByName(
        atom.where("entry IS NULL AND title IS NOT NULL").select("file", reason)
    )
