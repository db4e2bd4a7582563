"""News entities derived from the given tables.

Each view is one SQL text that Spark and DuckDB both run, so a query and its oracle start
from the same rows. Every view covers its whole base tables; ``case … % n`` only varies
field values, it never leaves rows out.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("documents", "pages", "events")
ITEMS_PER_FEED_RANGE = 500

VIEWS = {
    "sources": """
        select concat('src_', n) as source_id, source as name,
          case when n % 7 = 6 then 'API' else 'RSS' end as type,
          concat('https://feeds.example.org/', n, '.xml') as url,
          case when n % 5 = 4 then 'INACTIVE' else 'ACTIVE' end as status,
          1 + n % 10 as priority, 30 + 15 * (n % 3) as fetch_interval, 'en' as language,
          concat('Feed ', n) as description,
          case n % 4 when 1 then 'RSS_ONLY' when 2 then 'RSS_PLUS_HTML_FETCH' when 3 then null
            else 'AUTO' end as fetch_strategy
        from (select distinct source, cast(substr(source, 4) as int) as n from {documents}) d""",
    "fallback_map": """
        select source_id, concat('src_', cast(substr(source_id, 5) as int) + 2) as fallback_id
        from {sources} where fetch_strategy is null or fetch_strategy <> 'RSS_PLUS_HTML_FETCH'""",
    "items": """
        select d.doc_id as item_id, concat('src_', cast(substr(d.source, 4) as int)) as source_id,
          d.doc_id as pos,
          case when d.doc_id % 41 = 40 then '' else trim(replace(regexp_extract(d.text, '^[^.]*', 0), chr(10), ' ')) end
            as title,
          case when d.doc_id % 4 = 0 then '' else trim(regexp_extract(d.text, '^[^\n]*', 0)) end as summary,
          d.text as content,
          case when d.doc_id % 53 = 52 then 'not a url'
            else coalesce(p.url, concat('https://item.example.org/', d.doc_id)) end as url,
          case when d.doc_id % 6 = 0 then null when d.doc_id % 6 = 1 then 'Thu, 16 Jul 2026 06:00:00 GMT'
            else '2026-07-16T06:00:00Z' end as published_at,
          case when d.doc_id % 3 = 0 then '' else concat('author', d.doc_id % 17) end as author,
          case when d.doc_id % 2 = 0 then '' else concat('https://img.example.org/', d.doc_id, '.png') end as image,
          case when d.doc_id % 9 = 0 then null
            else split(concat(d.lang, ',', d.source, ',tag_', d.doc_id % 3, ',tag_', d.doc_id % 7, ',news,feed'), ',')
            end as categories
        from {documents} d left join {pages} p on p.page_id = d.doc_id""",
    "crawl": """
        select page_id, url, replace(html, '</head>', concat(
          case when page_id % 2 = 0 then concat('<meta name="author" content="page author ', page_id, '">')
            else '' end,
          case when page_id % 3 = 0 then
            concat('<meta property="og:image" content="https://img.example.org/hero/', page_id, '.jpg">')
            else '' end,
          case when page_id % 5 = 0 then ''
            else '<meta property="article:published_time" content="2026-07-15T12:00:00Z">' end,
          case page_id % 10 when 0 then '<meta name="description" content="">' when 1 then ''
            else concat('<meta name="description" content="About page ', page_id, '">') end,
          '</head>')) as html
        from {pages}""",
    "articles": """
        select concat('art_', d.doc_id) as id, concat('slug-', d.doc_id % 200) as slug,
          concat('src_', cast(substr(d.source, 4) as int)) as source_id,
          case when d.doc_id % 5 = 0 then null else concat('cat_', d.doc_id % 5) end as category_id,
          split(concat('tag_', d.doc_id % 3, ',tag_', d.doc_id % 7), ',') as tags, d.lang as language,
          case d.doc_id % 8 when 0 then 'RAW' when 1 then 'NORMALIZED' when 2 then 'AI_PROCESSING'
            when 3 then 'PENDING_REVIEW' when 4 then 'APPROVED' when 5 then 'PUBLISHED'
            when 6 then 'REJECTED' else 'ARCHIVED' end as status,
          case when d.doc_id % 8 = 5 then e.ts + interval '1' day else null end as published_at,
          e.ts as created_at, e.ts as updated_at
        from {documents} d join {events} e on e.event_id = d.doc_id""",
    "stored": """
        select distinct concat('art_', md5(concat(i.source_id, '~', i.url))) as id
        from {items} i join {events} e on e.user_id = i.item_id""",
    "commands": """
        select event_id as seq, concat('art_', user_id * 7) as article_id,
          case event_type when 'signup' then 'approve' when 'click' then 'reject' when 'view' then 'archive'
            when 'purchase' then 'publish' else 'submit' end as command, ts
        from {events}""",
    "patches": """
        select event_id as seq, concat('art_', user_id * 7) as id,
          split(case event_type when 'signup' then 'status' when 'click' then 'category_id' when 'view' then 'slug'
            when 'purchase' then 'tags,language' else 'status,slug' end, ',') as fields,
          case event_type when 'signup' then 'APPROVED' when 'error' then 'PENDING' end as status,
          case when event_type = 'view' then concat('patched-', event_id) when event_type = 'error' then '' end
            as slug,
          cast(null as varchar(9)) as category_id,
          case when event_type = 'purchase' then split(concat('sale,k', user_id), ',') end as tags,
          case when event_type = 'purchase' then
            case when event_id % 10 = 3 then 'much-too-long' else 'vi' end end as language
        from {events}""",
    "source_patches": """
        select event_id as seq, concat('src_', user_id) as source_id,
          split(case event_type when 'signup' then 'status' when 'click' then 'fetch_strategy'
            when 'view' then 'priority,fetch_interval' when 'purchase' then 'name' else 'url' end, ',') as fields,
          case when event_type = 'signup' then case when event_id % 3 = 0 then 'PAUSED' else 'INACTIVE' end end
            as status,
          case when event_type = 'click' then 'RSS_ONLY' end as fetch_strategy,
          case when event_type = 'view' then cast(event_id % 6 as int) end as priority,
          case when event_type = 'view' then cast(event_id % 7 * 10 as int) end as fetch_interval,
          case when event_type = 'purchase' then case when event_id % 4 = 0 then '' else concat('renamed ', event_id) end
            end as name,
          case when event_type = 'error' then
            case when event_id % 2 = 0 then 'nowhere' else concat('https://moved.example.org/', event_id) end end as url
        from {events}""",
    "source_candidates": """
        select page_id,
          case when page_id % 13 = 0 then '' else split_part(url, '/', 3) end as name,
          case page_id % 9 when 0 then 'ATOM' when 1 then null else 'RSS' end as type,
          case when page_id % 7 = 0 then 'nope' else url end as url,
          cast(page_id % 4 as int) as priority,
          case when page_id % 3 = 0 then null else cast(page_id % 5 * 30 as int) end as fetch_interval,
          case page_id % 8 when 0 then '' when 1 then 'much-too-long' else 'en' end as language,
          case page_id % 6 when 0 then 'SOMETIMES' when 1 then null else 'AUTO' end as fetch_strategy
        from {pages}""",
    "delete_ids": """
        select distinct concat('art_', user_id * 7) as id from {events} where event_type = 'error'""",
    "queue": """
        select event_id as message_id,
          case when event_id % 2 = 0
            then concat(chr(123), '"articleId":"art_', event_id % 11 * 1000 + event_id % 97, '"', chr(125))
            else concat('art_', event_id % 11 * 1000 + event_id % 97) end as body,
          1 + event_id % 4 as receive_count, ts as sent_at
        from {events}""",
    "bus": """
        select event_id, ts, case when event_type = 'purchase' then 'ArticleApproved' else 'ArticleViewed' end
            as detail_type,
          concat(chr(123), '"articleId":"art_', user_id * 7, '"', chr(125)) as detail
        from {events}""",
    "requests": """
        select p.url, e.ts from {events} e join {pages} p on p.page_id = e.user_id""",
    "last_fetch": """
        select concat('src_', cast(substr(d.source, 4) as int)) as source_id, max(e.ts) as last_fetch
        from {events} e join {documents} d on d.doc_id = e.user_id
        where e.event_type = 'view' group by d.source""",
    "categories": """
        select concat('cat_', n) as id, concat('Category ', n) as name, concat('category-', n) as slug,
          n % 3 <> 2 as is_active
        from (select distinct doc_id % 6 as n from {documents}) d""",
    "tags": """
        select concat('tag_', n) as slug, concat('Tag ', n) as name
        from (select distinct doc_id % 8 as n from {documents}) d""",
}


def needs(view: str) -> list[str]:
    """Names a view's SQL refers to, in order."""
    return [name for _, name, _, _ in Formatter().parse(VIEWS[view]) if name]


def oracle_views(*names: str) -> str:
    """``with …`` prefix that defines the views (and what they need) for DuckDB."""
    ordered: dict[str, None] = {}

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for dep in needs(name):
                visit(dep)
            ordered[name] = None

    for name in names:
        visit(name)
    parts = [f"{n} as ({VIEWS[n].format_map({d: d for d in needs(n)})})" for n in ordered]
    return "with " + ",\n".join(parts)


def _cdata(c: Column) -> Column:
    safe = F.replace(c, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    return F.concat(F.lit("<![CDATA["), safe, F.lit("]]>"))


def _escaped(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def _tag(name: str, value: Column) -> Column:
    """An element, or nothing when the value is null."""
    return F.coalesce(F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>")), F.lit(""))


def _feed_head() -> Column:
    return F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" '
              'xmlns:content="http://purl.org/rss/1.0/modules/content/" '
              'xmlns:media="http://search.yahoo.com/mrss/"><channel><title>Feed of '),
        F.col("source_id"), F.lit("</title>"),
    )


def render_feeds(items: DataFrame) -> DataFrame:
    """RSS documents ``(source_id, feed_no, feed_xml)`` from item rows.

    A document covers one range of positions, so it has at most ``ITEMS_PER_FEED_RANGE``
    items however large its source is.
    """
    n, image = F.col("item_id"), F.nullif(F.col("image"), F.lit(""))
    author = F.nullif(F.col("author"), F.lit(""))

    def attribute(kind: str, extra: str, rest: int) -> Column:
        text = F.concat(F.lit(f"<{kind} url=\""), image, F.lit(f"\" {extra}/>"))
        return F.coalesce(F.when(n % 6 == rest, text), F.lit(""))

    categories = F.transform("categories", lambda c: F.concat(F.lit("<category>"), c, F.lit("</category>")))
    item = F.concat(
        F.lit("<item>"),
        _tag("title", _cdata(F.col("title"))),
        _tag("link", _escaped(F.col("url"))),
        _tag("guid", n.cast("string")),
        _tag("pubDate", F.col("published_at")),
        _tag("dc:creator", F.when(n % 2 == 0, author)),
        _tag("author", F.when(n % 2 == 1, author)),
        _tag("description", _cdata(F.col("summary"))),
        _tag("content:encoded", _cdata(F.col("content"))),
        _tag("comments", F.when(n % 10 == 3, F.lit("https://talk.example.org"))),
        F.coalesce(F.array_join(categories, ""), F.lit("")),
        attribute("media:content", 'width="640" type="image/png"', 1),
        attribute("media:thumbnail", 'width="64" height="64"', 3),
        attribute("enclosure", 'type="image/png" length="1000"', 5),
        F.lit("</item>"),
    )
    numbered = items.select(
        "source_id", F.floor(F.col("pos") / ITEMS_PER_FEED_RANGE).cast("long").alias("feed_no"),
        F.struct("pos", item.alias("xml")).alias("entry"),
    )
    bodies = numbered.groupBy("source_id", "feed_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("entry")), lambda e: e["xml"]), "").alias("body")
    )
    return bodies.select("source_id", "feed_no", F.concat(_feed_head(), "body", F.lit("</channel></rss>")).alias("feed_xml"))


def broken_feeds(items: DataFrame) -> DataFrame:
    """One more document of each source whose id ends in 8, cut off inside its first item."""
    cut = items.filter(F.col("source_id").endswith("8")).select("source_id").distinct()
    text = F.concat(_feed_head(), F.lit("<item><title>"))
    return cut.select("source_id", F.lit(-1).cast("long").alias("feed_no"), text.alias("feed_xml"))


class Corpus:
    """The views over one data folder, built when first used: ``Corpus(spark, dir).items``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder
        self._built: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.typed(df)

    @staticmethod
    def typed(df: DataFrame) -> DataFrame:
        """Event times are stored without zone; they are UTC."""
        return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df

    def derive(self, view: str, **given: DataFrame) -> DataFrame:
        """A view over other inputs than the stored tables, such as one stream batch."""
        inputs = {n: given[n] if n in given else getattr(self, n) for n in needs(view)}
        return self.spark.sql(VIEWS[view], **inputs)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in (*TABLES, *VIEWS, "feeds", "arrived_feeds"):
            raise AttributeError(name)
        if name not in self._built:
            if name in TABLES:
                self._built[name] = self.table(name)
            elif name == "feeds":
                self._built[name] = render_feeds(self.items)
            elif name == "arrived_feeds":
                self._built[name] = self.feeds.unionByName(broken_feeds(self.items))
            else:
                self._built[name] = self.derive(name)
        return self._built[name]
