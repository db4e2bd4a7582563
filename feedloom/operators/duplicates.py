"""Exact duplicates and the category and tag dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import collapse_ws
from feedloom.operators.joins import HOT_KEY_ROWS, MAX_HOT_KEYS, dimension_join, lookup_join


def text_key(c: Column) -> Column:
    """Hash of the whole text, ignoring case and whitespace differences."""
    return F.md5(collapse_ws(F.lower(c)))


def mark_duplicates(articles: DataFrame, key: Column, order: str) -> DataFrame:
    """Rows with ``original_id``, the ``order``-smallest row of equal key, and ``copies``.

    Groups are reduced to one row each before anything is joined back, and groups large
    enough to matter are joined by broadcast. A row without a key is an original of its own.
    """
    keyed = articles.withColumn("_key", key)
    groups = keyed.groupBy("_key").agg(
        F.min(order).alias("original_id"), F.count(F.lit(1)).alias("copies")
    )
    large = groups.filter(F.col("copies") >= HOT_KEY_ROWS).orderBy(F.desc("copies"), "_key")
    hot = large.limit(MAX_HOT_KEYS).select("_key")
    joined = lookup_join(keyed, groups, "_key", F.col(order), hot)
    return joined.select(
        *articles.columns,
        F.coalesce("hit.original_id", order).alias("original_id"),
        F.coalesce("hit.copies", F.lit(1).cast("long")).alias("copies"),
    )


def tag_counts(articles: DataFrame) -> DataFrame:
    """Articles per tag, an article counting once for each of its distinct tags."""
    tags = articles.select(F.explode(F.array_distinct("tags")).alias("slug"))
    return tags.groupBy("slug").agg(F.count(F.lit(1)).alias("article_count"))


def tag_dimension(tags: DataFrame, articles: DataFrame) -> DataFrame:
    """Tag table with recomputed counts; unused tags count 0."""
    counts = tag_counts(articles)
    joined = tags.drop("article_count").join(counts, "slug", "left")
    return joined.withColumn("article_count", F.coalesce("article_count", F.lit(0).cast("long")))


def active_categories(categories: DataFrame) -> DataFrame:
    return categories.filter("is_active")


def category_by_slug(categories: DataFrame, slug: str) -> DataFrame:
    return categories.filter(F.col("slug") == slug)


def category_counts(categories: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles per active category. Articles are counted first, so only one row per
    category is joined."""
    counts = articles.groupBy("category_id").agg(F.count(F.lit(1)).alias("n_articles"))
    joined = active_categories(categories).join(counts, F.col("id") == F.col("category_id"), "left")
    return joined.select(
        *categories.columns, F.coalesce("n_articles", F.lit(0).cast("long")).alias("n_articles")
    )


def article_categories(articles: DataFrame, categories: DataFrame) -> DataFrame:
    """Articles with the name of their active category, else null."""
    names = active_categories(categories).select(
        F.col("id").alias("category_id"), F.col("name").alias("category_name")
    )
    joined = dimension_join(articles, names, "category_id", F.col("id"), how="left")
    return joined.select(*articles.columns, "category_name")
