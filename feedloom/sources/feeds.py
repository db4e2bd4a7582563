"""Feed scan: RSS and Atom documents in a table become normalised item rows.

Input is ``feeds(source_id, feed_xml, …)``, one row per downloaded document. Parsing is
``from_xml`` inside the scan stage, so no shuffle happens until an operator needs one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.dates import to_iso
from feedloom.functions.text import blank_to_null, snippet

# The elements read of RSS 2.0, RSS 1.0 and Atom, with their usual prefixes.
_MEDIA = """
  `media:content`: array<struct<
    _url: string, _width: string, _height: string, _type: string, _medium: string>>,
  `media:thumbnail`: array<struct<_url: string, _width: string, _height: string>>,
  `media:group`: string
"""
_ITEM = f"""struct<
  title: string, link: string, guid: string, pubDate: string, `dc:date`: string, author: string,
  `dc:creator`: string, description: string, `content:encoded`: string, comments: string,
  category: array<string>, enclosure: struct<_url: string, _type: string, _length: string>, {_MEDIA}
>"""
_ENTRY = f"""struct<
  title: string, link: array<struct<_href: string, _rel: string>>, id: string,
  published: string, updated: string, author: array<struct<name: string>>, content: string,
  category: array<struct<_term: string>>, {_MEDIA}
>"""
FEED_SCHEMA = f"""
  channel struct<title: string, item: array<{_ITEM}>>,
  item array<{_ITEM}>,
  id string, title string, entry array<{_ENTRY}>
"""
_XML_OPTIONS = {"ignoreSurroundingSpaces": "false", "attributePrefix": "_"}
UNKNOWN_FEED = "Unknown Feed"
PARSE_ERROR = "Feed could not be parsed"
RAW_KEYS = (
    "title", "contentSnippet", "content:encoded", "content", "link", "pubDate", "isoDate",
    "creator", "author", "dc:creator", "enclosure", "media:content", "media:thumbnail",
    "media:group", "categories", "guid", "comments",
)


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per feed document below ``path``: ``(path, feed_xml)``."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("feed_xml"))


def _entry_item(entry: Column) -> Column:
    """An Atom entry in the shape of an RSS item."""
    main = F.filter(entry["link"], lambda link: link["_rel"] == "alternate")
    link = F.coalesce(F.get(main, F.lit(0)), F.get(entry["link"], F.lit(0)))["_href"]
    none = F.lit(None).cast("string")
    return F.struct(
        entry["title"].alias("title"),
        link.alias("link"),
        entry["id"].alias("guid"),
        F.coalesce(entry["published"], entry["updated"]).alias("pubDate"),
        none.alias("dc:date"),
        F.get(entry["author"], F.lit(0))["name"].alias("author"),
        none.alias("dc:creator"),
        entry["content"].alias("description"),
        none.alias("content:encoded"),
        none.alias("comments"),
        F.transform(entry["category"], lambda c: c["_term"]).alias("category"),
        F.lit(None).cast("struct<_url: string, _type: string, _length: string>").alias("enclosure"),
        entry["media:content"].alias("media:content"),
        entry["media:thumbnail"].alias("media:thumbnail"),
        entry["media:group"].alias("media:group"),
    )


def parse_feeds(feeds: DataFrame) -> DataFrame:
    """Replace ``feed_xml`` by ``feed_ok``, ``feed_title`` and the ``raw_items`` array.

    A document that is neither RSS nor Atom is kept with ``feed_ok = false``: that is the
    source failure of a collection run.
    """
    others = [c for c in feeds.columns if c != "feed_xml"]
    parsed = feeds.select(*others, F.from_xml("feed_xml", FEED_SCHEMA, _XML_OPTIONS).alias("_feed"))
    feed = F.col("_feed")
    entries = F.transform(feed["entry"], _entry_item).cast(f"array<{_ITEM}>")
    known = feed["channel"].isNotNull() | feed["entry"].isNotNull() | feed["id"].isNotNull()
    return parsed.select(
        *others,
        F.coalesce(known, F.lit(False)).alias("feed_ok"),
        F.coalesce(feed["channel"]["title"], feed["title"], F.lit(UNKNOWN_FEED)).alias("feed_title"),
        F.coalesce(feed["channel"]["item"], feed["item"], entries).alias("raw_items"),
    )


def explode_items(parsed: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per feed item with its position; a feed without items gives none.

    ``keep_empty`` keeps one row with a null position for such a feed, so that one table
    holds the items and the outcome of every document.
    """
    others = [c for c in parsed.columns if c != "raw_items"]
    explode = F.posexplode_outer if keep_empty else F.posexplode
    return parsed.select(*others, explode("raw_items").alias("pos", "_raw")).select(
        *others, F.col("pos").cast("long").alias("pos"), raw_item(F.col("_raw")).alias("raw")
    )


def raw_item(item: Column) -> Column:
    """The feed parser's view of one item: null means the key is absent."""
    body = blank_to_null(item["description"])
    date = blank_to_null(item["pubDate"])
    media = F.get(item["media:content"], F.lit(0))
    thumb = F.get(item["media:thumbnail"], F.lit(0))
    fields = {
        "title": item["title"],
        "contentSnippet": snippet(body),
        "content:encoded": item["content:encoded"],
        "content": body,
        "link": item["link"],
        "pubDate": date,
        "isoDate": to_iso(F.coalesce(date, blank_to_null(item["dc:date"]))),
        "creator": item["dc:creator"],
        "author": item["author"],
        "dc:creator": item["dc:creator"],
        "enclosure": item["enclosure"],
        "media:content": media,
        "media:thumbnail": thumb,
        "media:group": item["media:group"],
        "categories": item["category"],
        "guid": item["guid"],
        "comments": item["comments"],
    }
    return F.struct(*[fields[name].alias(name) for name in RAW_KEYS])


def item_image(raw: Column) -> Column:
    """First non-empty of media content, thumbnail, enclosure; else ''."""
    candidates = (raw["media:content"]["_url"], raw["media:thumbnail"]["_url"], raw["enclosure"]["_url"])
    return F.coalesce(*[blank_to_null(c) for c in candidates], F.lit(""))


def normalise_items(items: DataFrame, keep_raw: bool = False) -> DataFrame:
    """Raw items to the seven item fields. Only an absent key falls through, '' does not."""
    raw, none = F.col("raw"), F.lit("")
    fields = {
        "title": F.coalesce(raw["title"], none),
        "summary": F.coalesce(raw["contentSnippet"], raw["content"], none),
        "content": F.coalesce(raw["content:encoded"], raw["content"], raw["contentSnippet"], none),
        "url": F.coalesce(raw["link"], none),
        "published_at": F.coalesce(raw["isoDate"], raw["pubDate"]),
        "author": F.coalesce(raw["creator"], raw["author"], none),
        "image": item_image(raw),
    }
    others = [c for c in items.columns if c != "raw" or keep_raw]
    return items.select(*others, *[c.alias(n) for n, c in fields.items()])


def read_items(feeds: DataFrame) -> DataFrame:
    """Feed documents to normalised items."""
    return normalise_items(explode_items(parse_feeds(feeds)))
