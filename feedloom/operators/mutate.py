"""Writes as set operations: table and batch in, new table rows out.

Patches say which fields they set in ``fields`` (array of column names), because setting
a field to null and leaving it alone are different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import schemas as sc
from feedloom.functions import ids
from feedloom.functions.text import slugify
from feedloom.operators.joins import MAX_WIDE_BROADCAST_ROWS, batch_join, probe

ARTICLE_PATCH_FIELDS = (
    "slug", "category_id", "tags", "language", "author", "cover_image", "status", "published_at",
)
SOURCE_PATCH_FIELDS = (
    "name", "type", "url", "status", "priority", "fetch_interval", "language",
    "description", "fetch_strategy",
)
AI_FIELDS = tuple(f.name for f in sc.AI)


def _or(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


def empty_ai() -> Column:
    fields = [
        (F.array() if f.name == "keywords" else F.lit(None)).cast(f.dataType).alias(f.name) for f in sc.AI
    ]
    return F.struct(*fields)


def article_rows(inputs: DataFrame, as_of: Column) -> DataFrame:
    """Accepted article inputs to full article rows with all defaults."""
    o = F.col("original")
    original = o.withField("image", F.coalesce(o["image"], F.lit(""))).withField(
        "author", F.coalesce(o["author"], F.lit(""))
    )
    return inputs.select(
        ids.article_id(F.col("source_id"), o["url"]).alias("id"),
        slugify(o["title"]).alias("slug"),
        "source_id",
        _or(inputs, "category_id", F.lit(None).cast("string")).alias("category_id"),
        _or(inputs, "tags", F.array().cast("array<string>")).alias("tags"),
        _or(inputs, "language", F.lit(sc.DEFAULT_LANGUAGE)).alias("language"),
        _or(inputs, "author", o["author"]).alias("author"),
        _or(inputs, "cover_image", o["image"]).alias("cover_image"),
        original.alias("original"),
        empty_ai().alias("ai"),
        F.lit("RAW").alias("status"),
        F.lit(None).cast("timestamp").alias("published_at"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
        *[c for c in ("pos", "item_id") if c in inputs.columns],
    )


def source_rows(inputs: DataFrame, as_of: Column) -> DataFrame:
    """Accepted source inputs to full source rows with all defaults."""
    return inputs.select(
        _or(inputs, "source_id", ids.source_id(F.col("url"))).alias("source_id"),
        "name",
        "type",
        "url",
        F.lit("ACTIVE").alias("status"),
        _or(inputs, "priority", F.lit(sc.DEFAULT_PRIORITY)).cast("int").alias("priority"),
        _or(inputs, "fetch_interval", F.lit(sc.DEFAULT_FETCH_INTERVAL)).cast("int").alias("fetch_interval"),
        _or(inputs, "language", F.lit(sc.DEFAULT_LANGUAGE)).alias("language"),
        _or(inputs, "description", F.lit("")).alias("description"),
        _or(inputs, "fetch_strategy", F.lit("AUTO")).alias("fetch_strategy"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )


def read_sources(sources: DataFrame) -> DataFrame:
    """Public source columns with the read-time strategy default."""
    named = [c for c in sc.SOURCE.names if c in sources.columns and c != "fetch_strategy"]
    return sources.select(*named, F.coalesce("fetch_strategy", F.lit("AUTO")).alias("fetch_strategy"))


def read_articles(articles: DataFrame) -> DataFrame:
    """Public article columns only."""
    return articles.select(*[c for c in sc.ARTICLE.names if c in articles.columns])


def first_per_id(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """First row per key. Copies collapse before the shuffle, however many there are."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(key).agg(first.alias("_row")).select("_row.*")


def insert_if_absent(
    rows: DataFrame, existing: DataFrame, key: str, *order: str, small_batch: bool = False
) -> DataFrame:
    """Rows whose key is neither stored nor taken by an earlier row of the batch.

    ``existing`` is read for its key column only. For a large batch, bucket that table by
    key (``store.write_bucketed``) and the anti join does not shuffle it. ``small_batch``
    counts the new keys first and, if they fit, just scans the stored keys for them; use it
    on materialised rows.
    """
    fresh = first_per_id(rows, key, *order)
    stored = existing.select(key)
    if small_batch:
        stored = probe(stored, rows.select(key).distinct(), key)
    return fresh.join(stored, key, "left_anti")


def combine_patches(patches: DataFrame, key: str, order: str, fields: tuple[str, ...]) -> DataFrame:
    """Successive patches of one key to one: the last value set wins, field by field.

    Each field becomes ``struct<v>`` (null when never set), from partial aggregates,
    so one key with very many patches costs no more than any other.
    """
    def last(field: str) -> Column:
        given = F.array_contains("fields", field)
        return F.max_by(F.struct(F.col(field).alias("v")), F.when(given, F.col(order))).alias(field)

    present = [f for f in fields if f in patches.columns]
    return patches.groupBy(key).agg(*[last(f) for f in present])


def apply_patches(
    table: DataFrame, combined: DataFrame, key: str, fields: tuple[str, ...], as_of: Column
) -> DataFrame:
    """New table state; ``updated_at`` moves for every patched row, unknown keys add nothing."""
    present = [f for f in fields if f in combined.columns]
    patch = combined.select(key, F.struct(*present).alias("_patch"))
    joined = batch_join(table, patch, key, max_rows=MAX_WIDE_BROADCAST_ROWS)

    def value(name: str) -> Column:
        if name == "updated_at":
            return F.when(F.col("_patch").isNotNull(), as_of).otherwise(F.col(name)).alias(name)
        if name in present:
            new = F.col("_patch")[name]
            return F.when(new.isNotNull(), new["v"]).otherwise(F.col(name)).alias(name)
        return F.col(name)

    return joined.select(*[value(c) for c in table.columns])


def patch_articles(table: DataFrame, patches: DataFrame, as_of: Column, order: str = "seq") -> DataFrame:
    """Apply valid article patches; ``source_id`` and ``original`` never change."""
    combined = combine_patches(patches, "id", order, ARTICLE_PATCH_FIELDS)
    return apply_patches(table, combined, "id", ARTICLE_PATCH_FIELDS, as_of)


def patch_sources(table: DataFrame, patches: DataFrame, as_of: Column, order: str = "seq") -> DataFrame:
    combined = combine_patches(patches, "source_id", order, SOURCE_PATCH_FIELDS)
    return apply_patches(table, combined, "source_id", SOURCE_PATCH_FIELDS, as_of)


def combine_ai_patches(patches: DataFrame, order: str) -> DataFrame:
    """Successive ``ai`` patches of one id to one: the last value set wins, field by field."""
    def last(name: str) -> Column:
        given = F.array_contains("ai_fields", name)
        return F.max_by(F.struct(F.col("ai")[name].alias("v")), F.when(given, F.col(order))).alias(name)

    combined = patches.groupBy("id").agg(*[last(n) for n in AI_FIELDS])
    named = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in AI_FIELDS]))
    return combined.select("id", F.struct(*[F.col(f"{n}.v").alias(n) for n in AI_FIELDS]).alias("ai"), named.alias("ai_fields"))


def patch_ai(
    table: DataFrame, patches: DataFrame, as_of: Column, mode: str = "merge", order: str = "seq"
) -> DataFrame:
    """Patch the nested ``ai`` record from ``patches(id, ai, ai_fields)``: one row per id, or
    any number with their ``order``. Of several, the last value of each field counts in a
    merge, and the last patch in a replacement.

    ``merge`` changes the fields named in ``ai_fields`` only. ``replace`` gives every
    field that is not named its default, as an update that passes through validation does.
    """
    if mode not in ("merge", "replace"):
        raise ValueError(f"unknown ai mode: {mode}")
    if order in patches.columns and mode == "merge":
        patches = combine_ai_patches(patches, order)
    elif order in patches.columns:
        last = F.max_by(F.struct("id", "ai", "ai_fields"), F.col(order)).alias("_last")
        patches = patches.groupBy("id").agg(last).select("_last.*")
    patch = patches.select("id", F.col("ai").alias("_ai"), F.col("ai_fields").alias("_set"))
    base = F.col("ai") if mode == "merge" else empty_ai()
    fields = [
        F.when(F.array_contains("_set", n), F.col("_ai")[n]).otherwise(base[n]).alias(n) for n in AI_FIELDS
    ]
    joined = batch_join(table, patch, "id", max_rows=MAX_WIDE_BROADCAST_ROWS)
    hit = F.col("_set").isNotNull()
    joined = joined.withColumn("ai", F.when(hit, F.struct(*fields)).otherwise(F.col("ai")))
    joined = joined.withColumn("updated_at", F.when(hit, as_of).otherwise(F.col("updated_at")))
    return joined.select(*table.columns)


def missing_keys(batch: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the batch that the table does not have."""
    keys = batch.select(key).distinct()
    return keys.join(probe(table.select(key), keys, key), key, "left_anti")


def delete_rows(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Table without the listed keys; unknown ones are reported by ``missing_keys``."""
    return batch_join(table, batch.select(key).distinct(), key, "left_anti")


def toggle_sources(sources: DataFrame, batch: DataFrame, as_of: Column) -> DataFrame:
    """Switch ACTIVE to INACTIVE and anything else to ACTIVE, once per listing in the batch."""
    turns = batch.groupBy("source_id").agg((F.count(F.lit(1)) % 2).alias("_odd"))
    joined = batch_join(sources, turns, "source_id")
    hit = F.col("_odd").isNotNull()
    active = F.col("status") == "ACTIVE"
    flipped = F.when(F.col("_odd") == 1, ~active).otherwise(active)
    status = F.when(hit, F.when(flipped, "ACTIVE").otherwise("INACTIVE")).otherwise(F.col("status"))
    out = joined.withColumn("status", status)
    if "updated_at" in sources.columns:
        out = out.withColumn("updated_at", F.when(hit, as_of).otherwise(F.col("updated_at")))
    return out.select(*sources.columns)
