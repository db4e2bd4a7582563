"""Feed-quality reports: per-source aggregates, long form, and sources-as-columns form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.text import is_filled, utf16_length
from feedloom.operators.joins import lookup_join
from feedloom.schemas import FETCHED_FIELDS, FULL_CONTENT_CHARS, KNOWN_ITEM_KEYS
from feedloom.sources.feeds import RAW_KEYS

SAMPLE_ITEMS = 3
MAX_REPORT_COLUMNS = 200
SIZE_FIELDS = (
    "word_count", "reading_time_minutes", "html_length", "text_length", "has_image", "has_author", "has_date",
)


def first_items(items: DataFrame, n: int = SAMPLE_ITEMS) -> DataFrame:
    """First ``n`` items per source in feed order.

    The rank filter becomes a group limit before the shuffle, so a source of any size
    sends at most ``n`` rows per input partition. Project to narrow columns first.
    """
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy("pos", "item_id"))
    return items.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def first_item(items: DataFrame) -> DataFrame:
    """First item per source in feed order."""
    row = F.min_by(F.struct(*items.columns), F.struct("pos", "item_id"))
    return items.groupBy("source_id").agg(row.alias("_i")).select("_i.*")


def source_quality(items: DataFrame) -> DataFrame:
    """Mean content length of the first three items, verdict and recommended strategy."""
    sized = items.select("source_id", "pos", "item_id", utf16_length(F.col("content")).alias("size"))
    means = first_items(sized).groupBy("source_id").agg(F.avg("size").alias("avg_length"))
    full = F.col("avg_length") > FULL_CONTENT_CHARS
    return means.select(
        "source_id",
        "avg_length",
        F.floor(F.col("avg_length") + 0.5).cast("long").alias("rounded_length"),
        full.alias("contains_full_content"),
        F.when(full, "RSS_ONLY").otherwise("RSS_PLUS_HTML_FETCH").alias("strategy"),
        F.when(full, "RSS already contains full article")
        .otherwise("RSS only contains excerpt").alias("reason"),
    )


def field_coverage(items: DataFrame) -> DataFrame:
    """Per source: item count and a flag per field telling whether any item fills it.

    ``has_categories`` looks at the first item only, if the items carry ``categories``.
    """
    flags = [F.bool_or(is_filled(F.col(c))).alias(c) for c in ("title", "summary", "content", "author", "image")]
    flags.append(F.bool_or(F.col("published_at").isNotNull()).alias("published_at"))
    if "categories" in items.columns:
        lead = F.min_by(F.coalesce(F.size("categories"), F.lit(0)), F.struct("pos", "item_id"))
        flags.append((lead > 0).alias("categories"))
    return items.groupBy("source_id").agg(F.count(F.lit(1)).alias("item_count"), *flags)


def flag_rows(coverage: DataFrame, fields: list[str]) -> DataFrame:
    """Flag columns as a map, then one row per source and field."""
    pairs = [x for f in fields for x in (F.lit(f), F.col(f))]
    return coverage.select("source_id", F.explode(F.create_map(*pairs)).alias("field", "available"))


def metric_rows(report: DataFrame, key: str, metrics: dict[str, Column]) -> DataFrame:
    """Long form ``(key, metric, value)``; every value as text."""
    pairs = [x for name, c in metrics.items() for x in (F.lit(name), c.cast("string"))]
    return report.select(key, F.explode(F.create_map(*pairs)).alias("metric", "value"))


def report_columns(names: DataFrame, at_least: int = 1) -> list[str]:
    """The sorted values of a one-column table, if they are few enough to be columns."""
    rows = names.distinct().limit(MAX_REPORT_COLUMNS + 1).collect()
    if len(rows) > MAX_REPORT_COLUMNS:
        raise ValueError(f"more than {MAX_REPORT_COLUMNS} report columns; use the long form")
    if len(rows) < at_least:
        raise ValueError(f"a comparison needs at least {at_least} sources")
    return sorted(row[0] for row in rows)


def side_by_side(long: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """Metrics as rows, sources as columns.

    Only for a readable number of sources: beyond ``MAX_REPORT_COLUMNS`` this refuses and
    the long form is the report. Pass ``columns`` to spare a pass over the report.
    """
    columns = report_columns(long.select(key)) if columns is None else columns
    return long.groupBy("metric").pivot(key, columns).agg(F.first("value"))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "YES").otherwise("NO")


def coverage_metrics(coverage: DataFrame, quality: DataFrame) -> DataFrame:
    """Seven field flags, full-content verdict and item count per source, long form."""
    joined = coverage.join(quality.select("source_id", "contains_full_content"), "source_id", "left")
    fields = ("title", "summary", "content", "author", "image", "categories", "published_at")
    metrics = {f: yes_no(F.col(f)) for f in fields if f in coverage.columns}
    metrics["full_content"] = yes_no(F.coalesce("contains_full_content", F.lit(False)))
    metrics["item_count"] = F.col("item_count")
    return metric_rows(joined, "source_id", metrics)


def collection_report(merged: DataFrame, expected: DataFrame) -> DataFrame:
    """First merged item per source against the expected strategy and fetch flag.

    A source expected but without items shows N/A and matches nothing.
    """
    row = F.min_by(
        F.struct(
            "strategy", "needs_page", "rss_length", "fetched_length", "author", "author_source",
            "cover_image", "image_source",
            utf16_length(F.col("original.content")).cast("long").alias("final_length"),
            utf16_length(F.col("original.summary")).cast("long").alias("final_summary_length"),
        ),
        F.struct("pos", "item_id"),
    )
    first = merged.groupBy("source_id").agg(row.alias("r"))
    joined = expected.join(first, "source_id", "left")
    none, zero = F.lit("N/A"), F.lit(0).cast("long")
    return joined.select(
        "source_id",
        F.coalesce("r.strategy", none).alias("strategy"),
        F.coalesce("r.needs_page", F.lit(False)).alias("html_fetch"),
        F.coalesce("r.rss_length", zero).alias("rss_length"),
        F.coalesce("r.fetched_length", zero).alias("fetched_length"),
        F.coalesce("r.final_length", zero).alias("final_length"),
        F.coalesce("r.final_summary_length", zero).alias("final_summary_length"),
        F.coalesce("r.author", F.lit("")).alias("author"),
        F.coalesce("r.author_source", none).alias("author_source"),
        is_filled(F.col("r.cover_image")).alias("has_image"),
        F.coalesce("r.image_source", none).alias("image_source"),
        F.coalesce(F.col("r.strategy") == F.col("expected_strategy"), F.lit(False)).alias("strategy_match"),
        F.coalesce(F.col("r.needs_page") == F.col("expected_fetch"), F.lit(False)).alias("fetch_match"),
    )


def collection_metrics(report: DataFrame) -> DataFrame:
    """The collection report in long form."""
    empty = F.lit("(empty)")
    return metric_rows(report, "source_id", {
        "strategy": F.col("strategy"),
        "html_fetch": yes_no(F.col("html_fetch")),
        "rss_length": F.col("rss_length"),
        "fetched_length": F.col("fetched_length"),
        "final_length": F.col("final_length"),
        "author": F.coalesce(F.nullif(F.col("author"), F.lit("")), empty),
        "author_source": F.col("author_source"),
        "hero_image": yes_no(F.col("has_image")),
        "image_source": F.col("image_source"),
        "strategy_match": yes_no(F.col("strategy_match")),
        "fetch_match": yes_no(F.col("fetch_match")),
    })


def all_match(report: DataFrame) -> DataFrame:
    """Overall verdict in one row; an empty report matches."""
    return report.agg(
        F.coalesce(F.bool_and("strategy_match"), F.lit(True)).alias("all_strategy_match"),
        F.coalesce(F.bool_and("fetch_match"), F.lit(True)).alias("all_fetch_match"),
    )


def page_sizes(extracted: DataFrame) -> DataFrame:
    """What the fetch report needs of an extracted page; its texts become lengths."""
    others = [c for c in extracted.columns if c not in FETCHED_FIELDS]
    return extracted.select(
        *others,
        "word_count",
        "reading_time_minutes",
        utf16_length(F.col("html")).cast("long").alias("html_length"),
        utf16_length(F.col("text")).cast("long").alias("text_length"),
        is_filled(F.col("hero_image")).alias("has_image"),
        is_filled(F.col("author")).alias("has_author"),
        F.col("published_at").isNotNull().alias("has_date"),
    )


def fetch_report(requests: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Per request ``(key, url)``: success flag and the page's ``SIZE_FIELDS``.

    ``sizes`` is unique per URL; a URL requested very often is served by broadcast.
    """
    joined = lookup_join(requests, sizes.select("url", *SIZE_FIELDS), "url", F.col(key))
    counts = [F.coalesce(F.col(f"hit.{c}"), F.lit(0).cast("long")).alias(c) for c in SIZE_FIELDS[:4]]
    flags = [F.coalesce(F.col(f"hit.{c}"), F.lit(False)).alias(c) for c in SIZE_FIELDS[4:]]
    return joined.select(*requests.columns, F.col("hit").isNotNull().alias("success"), *counts, *flags)


def fetch_metrics(report: DataFrame, key: str) -> DataFrame:
    """Eight metrics per page in long form."""
    return metric_rows(report, key, {
        "status": yes_no(F.col("success")),
        "word_count": F.col("word_count"),
        "reading_time": F.concat(F.col("reading_time_minutes").cast("string"), F.lit(" min")),
        "html_length": F.col("html_length"),
        "text_length": F.col("text_length"),
        "hero_image": yes_no(F.col("has_image")),
        "author": yes_no(F.col("has_author")),
        "published": yes_no(F.col("has_date")),
    })


def fetch_counts(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count_if(F.col("success")).alias("succeeded"), F.count_if(~F.col("success")).alias("failed")
    )


def improvement(report: DataFrame, feed_lengths: DataFrame, key: str) -> DataFrame:
    """Fetched text length against the feed length, as a rounded percentage text.

    ``feed_lengths(key, rss_length)``; an unknown or empty feed text gives N/A.
    """
    joined = report.join(feed_lengths, key, "left")
    rss = F.coalesce(F.col("rss_length"), F.lit(0).cast("long"))
    percent = F.when(rss > 0, F.format_string("%.0f", (F.col("text_length") - rss) / rss * 100)).otherwise("N/A")
    return joined.select(
        key,
        rss.alias("rss_length"),
        F.col("text_length").alias("fetched_length"),
        F.when(F.col("success"), F.concat(percent, F.lit("%"))).otherwise("FAILED").alias("improvement"),
        "has_image",
        "has_author",
    )


def item_keys(raw: Column) -> Column:
    """Names of the keys an item carries."""
    present = F.array(*[F.when(raw[k].isNotNull(), F.lit(k)) for k in RAW_KEYS])
    return F.filter(present, lambda k: k.isNotNull())


def key_profile(items: DataFrame) -> DataFrame:
    """Per source and key: items that carry it, and whether the key is a known one."""
    keys = items.select("source_id", F.explode(item_keys(F.col("raw"))).alias("key"))
    counts = keys.groupBy("source_id", "key").agg(F.count(F.lit(1)).alias("n_items"))
    return counts.withColumn("is_known", F.col("key").isin(*KNOWN_ITEM_KEYS))


def extra_keys(items: DataFrame) -> DataFrame:
    """Per source: keys outside the known set, over all its items."""
    known = F.array(*[F.lit(k) for k in KNOWN_ITEM_KEYS])
    extras = items.select("source_id", F.explode(F.array_except(item_keys(F.col("raw")), known)).alias("key"))
    return extras.groupBy("source_id").agg(F.array_sort(F.collect_set("key")).alias("extra_keys"))


def image_coverage(items: DataFrame) -> DataFrame:
    """Per source: items that carry each image field and each of its attributes."""
    raw = F.col("raw")
    content, thumb, enclosure = raw["media:content"], raw["media:thumbnail"], raw["enclosure"]
    wanted = {
        "media_content": content, "media_content_url": content["_url"], "media_content_width": content["_width"],
        "media_content_height": content["_height"], "media_content_type": content["_type"],
        "media_content_medium": content["_medium"],
        "media_thumbnail": thumb, "media_thumbnail_url": thumb["_url"], "media_thumbnail_width": thumb["_width"],
        "media_thumbnail_height": thumb["_height"],
        "enclosure": enclosure, "enclosure_url": enclosure["_url"], "enclosure_type": enclosure["_type"],
        "enclosure_length": enclosure["_length"],
        "media_group": raw["media:group"],
    }
    counts = [F.count_if(c.isNotNull()).alias(n) for n, c in wanted.items()]
    return items.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_items"), *counts)


def resolve_fallback(primary: DataFrame, fallback_map: DataFrame) -> DataFrame:
    """Choose each source's feed: its own if it has items, else its fallback, else an error.

    ``primary(source_id, feed_ok, item_count)``, ``fallback_map(source_id, fallback_id)``.
    """
    joined = primary.join(fallback_map, "source_id", "left")
    works = F.col("feed_ok") & (F.col("item_count") > 0)
    error = F.when(
        ~works & F.col("fallback_id").isNull(), F.format_string("Failed to fetch %s RSS", "source_id")
    )
    return joined.select(
        "source_id",
        "item_count",
        F.when(works, F.col("source_id")).otherwise(F.col("fallback_id")).alias("chosen_id"),
        (~works & F.col("fallback_id").isNotNull()).alias("used_fallback"),
        error.alias("error"),
    )
