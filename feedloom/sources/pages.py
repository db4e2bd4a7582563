"""Page scan: crawled HTML becomes the fetched-content record.

``extract_pages`` is the default extractor; any callable with the same shape
(``pages(url, html) -> url + FETCHED_FIELDS``) can take its place in ``collect``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import text as tx
from feedloom.functions.dates import to_iso
from feedloom.schemas import EXCERPT_CHARS, FETCHED_FIELDS

Extractor = Callable[[DataFrame], DataFrame]

# Where each field of a page is looked for.
HEAD = r"(?is)^.*?</head>"
TITLE = r"(?is)<title\b[^>]*>([^<]*)</title>"
ARTICLE = r"(?is)<article\b[^>]*>(.*)</article>"
BODY = r"(?is)<body\b[^>]*>(.*)</body>"
NON_CONTENT = r"(?is)<(script|style|nav|footer)\b.*?</\1>|<!--.*?-->"
FIRST_IMAGE = r"""(?is)<img\b[^>]*?\ssrc\s*=\s*["']([^"']*)["']"""
TIME_TAG = r"""(?is)<time\b[^>]*?\sdatetime\s*=\s*["']([^"']*)["']"""
CONTENT_ATTR = r"""(?is)\scontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def _meta_tag(c: Column, name: str) -> Column:
    """The first meta tag called ``name``; '' when there is none."""
    return F.regexp_extract(c, rf"""(?is)<meta\b[^>]*?\s(?:name|property)\s*=\s*["']{name}["'][^>]*>""", 0)


def _content(tag: Column) -> Column:
    """Content attribute of a meta tag; null when there is no tag."""
    quoted = F.concat(F.regexp_extract(tag, CONTENT_ATTR, 1), F.regexp_extract(tag, CONTENT_ATTR, 2))
    return F.when(tag != "", tx.decode_entities(quoted))


def extract_pages(pages: DataFrame) -> DataFrame:
    """All columns but ``html`` plus the fetched fields; unreadable pages give no row.

    The steps are separate projections, so that each pattern runs once over the text it
    needs: metas over the head only, text rules over the article only.
    """
    others = [c for c in pages.columns if c != "html"]
    html = F.col("html")
    readable = pages.filter(html.rlike(r"(?i)<(article|body)\b"))
    head = F.regexp_extract(html, HEAD, 0)
    metas = {
        "_description": "description", "_og": "og:image", "_twitter": "twitter:image",
        "_author": "author", "_published": "article:published_time",
    }
    parts = readable.withColumns({"_head": head, "_article": F.regexp_extract(html, ARTICLE, 1)})
    parts = parts.withColumn("_head", F.when(F.col("_head") == "", html).otherwise(F.col("_head")))
    tags = parts.withColumns({k: _meta_tag(F.col("_head"), name) for k, name in metas.items()})
    body = F.regexp_replace(F.regexp_extract(html, BODY, 1), NON_CONTENT, "")
    found = tags.select(
        *others,
        tx.decode_entities(F.regexp_extract("_head", TITLE, 1)).alias("title"),
        F.when(F.col("_article") != "", F.col("_article")).otherwise(body).alias("_content"),
        _content(F.col("_description")).alias("_description"),
        F.coalesce(
            tx.blank_to_null(_content(F.col("_og"))),
            tx.blank_to_null(_content(F.col("_twitter"))),
            F.regexp_extract(html, FIRST_IMAGE, 1),
        ).alias("hero_image"),
        F.coalesce(_content(F.col("_author")), F.lit("")).alias("author"),
        F.coalesce(
            tx.blank_to_null(_content(F.col("_published"))), F.regexp_extract(html, TIME_TAG, 1)
        ).alias("_date"),
    )
    # The lead is kept apart from the text, so that a reader of the excerpt alone does not
    # have every page stripped, only those without a description.
    text = tx.strip_html(F.col("_content"))
    lead = F.when(F.col("_description").isNull(), F.substring(text, 1, EXCERPT_CHARS))
    counted = found.withColumns({"text": text, "_lead": lead})
    counted = counted.withColumn("word_count", tx.collapsed_word_count(F.col("text")))
    return counted.select(
        *others,
        "title",
        F.col("_content").alias("html"),
        "text",
        F.coalesce("_description", tx.collapsed_excerpt(F.col("_lead"))).alias("excerpt"),
        "hero_image",
        "author",
        to_iso(F.col("_date")).alias("published_at"),
        "word_count",
        tx.reading_minutes(F.col("word_count")).alias("reading_time_minutes"),
    )


def pandas_extractor(fn: Callable, schema: str) -> Extractor:
    """Wrap a pandas batch function (page frame in, record frame out) as an extractor.

    ``schema`` must list ``url``, the column that orders pages of one URL, and the fetched
    fields. Arrow batches, no shuffle.
    """

    def extract(pages: DataFrame) -> DataFrame:
        def batches(frames):
            for frame in frames:
                yield fn(frame)

        return pages.mapInPandas(batches, schema=schema)

    return extract


def latest_per_url(extracted: DataFrame, order: str, fields: tuple[str, ...] = FETCHED_FIELDS) -> DataFrame:
    """One record per URL, the one with the highest ``order``; combined before the shuffle.

    Name the ``fields`` that are needed: others are neither shuffled nor computed.
    """
    record = F.struct(*fields)
    return extracted.groupBy("url").agg(F.max_by(record, F.col(order)).alias("page")).select("url", "page.*")
