"""The whole collection run as one set of related frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators import collect as co
from feedloom.operators import mutate as mu
from feedloom.operators import validate as va
from feedloom.sources import feeds as fd
from feedloom.sources.queues import article_messages
from feedloom.sources.store import run_dir, stage


@dataclass(frozen=True)
class Collection:
    """Lazy outputs of one run. All derive from ``merged``: pass ``settle`` a written or
    persisted frame if several of them are used, as ``collect_feeds`` does."""

    merged: DataFrame
    log: DataFrame
    rejected: DataFrame
    created: DataFrame
    messages: DataFrame
    errors: DataFrame
    summary: DataFrame


def settle(
    merged: DataFrame, sources: DataFrame, stored: DataFrame, as_of: Column, source_errors: DataFrame | None = None
) -> Collection:
    """Validate merged inputs, insert the new ones, and account for all outcomes."""
    checked = va.with_errors(merged, va.article_issues())
    rejected = va.rejected_rows(checked)
    rows = mu.article_rows(va.valid_rows(checked), as_of)
    created = mu.insert_if_absent(rows, stored, "id", "pos", "item_id")
    # The counters need ids only; counting ``created`` would shuffle whole articles.
    new_ids = rows.select("id").distinct().join(stored.select("id"), "id", "left_anti")
    errors = co.item_errors(rejected)
    if source_errors is not None:
        errors = source_errors.unionByName(errors)
    return Collection(
        merged=merged,
        log=co.collect_log(merged),
        rejected=rejected,
        created=created,
        messages=article_messages(created),
        errors=errors,
        summary=co.collect_summary(sources, errors, new_ids),
    )


def scan_feeds(feeds: DataFrame) -> DataFrame:
    """Normalised items, identified by their guid, else their address, with the outcome of
    their document; a document without items has one row whose position is null."""
    exploded = fd.explode_items(fd.parse_feeds(feeds), keep_empty=True)
    items = fd.normalise_items(exploded, keep_raw=True)
    return items.withColumn("item_id", F.coalesce("raw.guid", "url")).drop("raw")


def collect_feeds(
    feeds: DataFrame,
    sources: DataFrame,
    pages: DataFrame,
    stored: DataFrame,
    as_of: Column,
    work_dir: str | None = None,
    **plug_ins,
) -> Collection:
    """From feed documents to created articles, rejects, errors and counters.

    Scanned feeds and merged items are written below ``work_dir`` (a fresh folder of the
    shared folder if not given), so that each document is parsed once and each item merged
    once, however many outputs are used. The next run may use the same ``work_dir``.
    """
    work = work_dir or run_dir(feeds.sparkSession, "collection")
    scanned = stage(scan_feeds(feeds), f"{work}/scanned")
    items = scanned.filter(F.col("pos").isNotNull())
    merged = stage(co.merge_articles(items, sources, pages, **plug_ins), f"{work}/merged")
    return settle(merged, sources, stored, as_of, co.source_errors(sources, scanned))
