"""Collection: decide per item how to get its text, join pages, merge both records.

Plan shape: items join the few active sources by broadcast; only items that need their
page are shuffled (by URL), all others bypass the join; extraction runs in the page scan,
for a small run only on the pages it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.checks import is_url
from feedloom.functions.text import blank_to_null, is_filled, utf16_length
from feedloom.operators.joins import dimension_join, hot_keys, lookup_join
from feedloom.schemas import FULL_CONTENT_CHARS
from feedloom.sources.feeds import PARSE_ERROR
from feedloom.sources.pages import Extractor, extract_pages, latest_per_url

# The fields of a fetched page that a merge can use.
MERGED_FIELDS = ("title", "html", "excerpt", "hero_image", "author", "published_at")

Analyzer = Callable[[Column], Column]
Merger = Callable[[Column, Column, Column], dict[str, Column]]


def active_sources(sources: DataFrame) -> DataFrame:
    return sources.filter(F.col("status") == "ACTIVE")


def sources_of_type(sources: DataFrame, kind: str) -> DataFrame:
    return sources.filter(F.col("type") == kind)


def collectable_sources(sources: DataFrame) -> DataFrame:
    """Active RSS sources; others are skipped without being a failure."""
    return sources_of_type(active_sources(sources), "RSS")


def join_sources(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items of collectable sources, with the source fields later steps need."""
    wanted = collectable_sources(sources).select(
        "source_id",
        F.col("name").alias("source_name"),
        F.col("language").alias("source_language"),
        F.col("fetch_strategy").alias("source_strategy"),
    )
    return dimension_join(items, wanted, "source_id", F.col("item_id"))


def has_full_content(content: Column) -> Column:
    return utf16_length(content) >= FULL_CONTENT_CHARS


def content_reason(content: Column) -> Column:
    size = utf16_length(content).cast("string")
    full = F.concat(F.lit("Content length "), size, F.lit(f" >= {FULL_CONTENT_CHARS} characters"))
    short = F.concat(
        F.lit("Content length "), size,
        F.lit(f" < {FULL_CONTENT_CHARS} characters (truncated/excerpt only)"),
    )
    return F.when(has_full_content(content), full).otherwise(short)


def plan_fetch(items: DataFrame, analyzer: Analyzer = has_full_content) -> DataFrame:
    """Add ``rss_length``, ``strategy`` and ``needs_page``."""
    fixed = blank_to_null(F.col("source_strategy"))
    auto = F.when(analyzer(F.col("content")), "RSS_ONLY").otherwise("RSS_PLUS_HTML_FETCH")
    planned = items.withColumn("rss_length", utf16_length(F.col("content")).cast("long"))
    planned = planned.withColumn("strategy", F.when(fixed != "AUTO", fixed).otherwise(auto))
    return planned.withColumn("needs_page", F.col("strategy") == "RSS_PLUS_HTML_FETCH")


def can_fetch() -> Column:
    """The page is needed and its address is one; anything else can never be fetched."""
    return F.col("needs_page") & F.coalesce(is_url(F.col("url")), F.lit(False))


def wanted_pages(planned: DataFrame, pages: DataFrame) -> DataFrame:
    """Leave pages out that no item needs, before they are extracted.

    A run must not extract a crawl of all times for the items of today. The join has no
    hint: few addresses are broadcast by their size, many are shuffled.
    """
    addresses = planned.filter(can_fetch()).select("url").distinct()
    return pages.join(addresses, "url", "left_semi")


def attach_pages(planned: DataFrame, fetched: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Left join the fetched record (unique per URL) as struct ``page`` where it is needed.

    All other rows, also those with an address that is no URL, stay out of the shuffle.
    """
    direct = planned.filter(~can_fetch())
    joined = lookup_join(planned.filter(can_fetch()), fetched, "url", F.col("item_id"), hot, hit="page")
    return joined.unionByName(direct, allowMissingColumns=True)


def merge_records(item: Column, page: Column, source_name: Column) -> dict[str, Column]:
    """Field-by-field merge of feed item and fetched page, with the origin of each choice."""
    use_html = is_filled(page["html"])
    page_author, item_author = is_filled(page["author"]), is_filled(item["author"])
    page_image, item_image = is_filled(page["hero_image"]), is_filled(item["image"])
    return {
        "title": F.coalesce(blank_to_null(page["title"]), item["title"]),
        "summary": F.when(is_filled(item["summary"]), item["summary"]).otherwise(
            F.coalesce(page["excerpt"], item["summary"])
        ),
        "content": F.when(use_html, page["html"]).otherwise(item["content"]),
        "published_at": F.coalesce(page["published_at"], item["published_at"]),
        "author": F.when(page_author, page["author"]).when(item_author, item["author"]).otherwise(source_name),
        "author_source": F.when(page_author, "FETCHER").when(item_author, "RSS").otherwise("SOURCE_DEFAULT"),
        "image": F.when(page_image, page["hero_image"]).when(item_image, item["image"]).otherwise(""),
        "image_source": F.when(page_image, "FETCHER").when(item_image, "RSS").otherwise("NONE"),
        "content_source": F.when(use_html, "FETCHER").otherwise("RSS"),
    }


def merge_items(attached: DataFrame, merger: Merger = merge_records) -> DataFrame:
    """Article inputs with the provenance and length columns of the collection log."""
    item = {c: F.col(c) for c in ("title", "summary", "content", "published_at", "author", "image")}
    merged = merger(item, F.col("page"), F.col("source_name"))
    original = F.struct(
        merged["title"].alias("title"),
        merged["summary"].alias("summary"),
        merged["content"].alias("content"),
        F.col("url").alias("url"),
        merged["published_at"].alias("published_at"),
        merged["image"].alias("image"),
        merged["author"].alias("author"),
    )
    return attached.select(
        "item_id",
        "source_id",
        "pos",
        F.col("title").alias("item_title"),
        original.alias("original"),
        F.col("source_language").alias("language"),
        F.array().cast("array<string>").alias("tags"),
        merged["author"].alias("author"),
        merged["image"].alias("cover_image"),
        "strategy",
        "needs_page",
        "rss_length",
        F.coalesce(utf16_length(F.col("page.html")), F.lit(0)).cast("long").alias("fetched_length"),
        merged["author_source"].alias("author_source"),
        merged["image_source"].alias("image_source"),
        merged["content_source"].alias("content_source"),
    )


def merge_articles(
    items: DataFrame,
    sources: DataFrame,
    pages: DataFrame,
    *,
    page_order: str = "page_id",
    extractor: Extractor = extract_pages,
    analyzer: Analyzer = has_full_content,
    merger: Merger = merge_records,
) -> DataFrame:
    """Items, sources and crawled pages to merged article inputs (one row per item)."""
    planned = plan_fetch(join_sources(items, sources), analyzer)
    fetched = latest_per_url(extractor(wanted_pages(planned, pages)), page_order, MERGED_FIELDS)
    # Counting the item table's URL column alone is cheaper than counting planned rows.
    return merge_items(attach_pages(planned, fetched, hot_keys(items, "url")), merger)


def collect_log(merged: DataFrame) -> DataFrame:
    """The per-item collection detail record."""
    return merged.select(
        F.col("item_title").alias("title"),
        "strategy",
        F.when(F.col("needs_page"), "YES").otherwise("NO").alias("html_fetch"),
        F.col("rss_length"),
        F.col("fetched_length"),
        "author_source",
        "image_source",
        "content_source",
    )


def source_errors(sources: DataFrame, scanned: DataFrame) -> DataFrame:
    """One error row per collectable source with an unreadable feed document."""
    failed = scanned.groupBy("source_id").agg(F.bool_and("feed_ok").alias("_ok")).filter(~F.col("_ok"))
    bad = collectable_sources(sources).join(failed, "source_id", "left_semi")
    return bad.select(
        F.lit("source").alias("kind"),
        F.col("source_id").alias("id"),
        F.format_string(f"Source %s (%s): {PARSE_ERROR}", "source_id", "name").alias("message"),
    )


def item_errors(rejected: DataFrame) -> DataFrame:
    """One error row per rejected item; the text carries the item's feed title."""
    return rejected.select(
        F.lit("item").alias("kind"),
        F.col("item_id").cast("string").alias("id"),
        F.concat(F.lit('Item "'), F.col("item_title"), F.lit('": Validation failed')).alias("message"),
    )


def collect_summary(sources: DataFrame, errors: DataFrame, created: DataFrame) -> DataFrame:
    """Run counters in one row. A skipped non-RSS source counts as collected."""
    active = active_sources(sources).agg(F.count(F.lit(1)).alias("n"))
    failed = errors.agg(F.count_if(F.col("kind") == "source").alias("failed"), F.count(F.lit(1)).alias("all"))
    made = created.agg(F.count(F.lit(1)).alias("n"))
    return failed.select(
        (active.scalar() - F.col("failed")).alias("collected_sources"),
        made.scalar().alias("articles_created"),
        F.col("failed").alias("failed_sources"),
        F.col("all").alias("error_count"),
    )


def error_counts(errors: DataFrame) -> DataFrame:
    """Errors per kind; the error table itself stays whole and distributed."""
    return errors.groupBy("kind").agg(F.count(F.lit(1)).alias("n_errors"))
