"""Approved-event consumer: publish the article if it still is APPROVED."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators.lifecycle import step
from feedloom.sources.queues import approved_events
from feedloom.sources.store import append_batch
from feedloom.streaming.lifecycle import statuses_before


def publish_approved(events: DataFrame, articles: DataFrame, as_of: Column) -> DataFrame:
    """One publish outcome per article named in approved events."""
    ids = approved_events(events).select("article_id").distinct()
    return step(articles, ids.withColumn("command", F.lit("publish")), as_of)


def run_publish(
    events: DataFrame, articles: Callable[[], DataFrame], out: str, checkpoint: str, as_of: Column | None = None,
    statuses: str | None = None,
) -> StreamingQuery:
    """Drain an event stream into publish outcomes below ``out``, one batch per epoch.

    The new statuses are appended below ``statuses`` (by default beside ``out``) and count in
    later batches, so that an article is published once however often its event comes.
    """
    log = statuses or f"{out}-statuses"

    def process(batch: DataFrame, epoch: int) -> None:
        now = F.current_timestamp() if as_of is None else as_of
        batch.persist()
        ids = approved_events(batch).select(F.col("article_id").alias("id")).distinct()
        base = statuses_before(articles(), ids, log, epoch).persist()
        path = append_batch(publish_approved(batch, base, now), out, epoch)
        done = batch.sparkSession.read.parquet(path).filter("error is null and new_status is not null")
        changed = done.select(F.col("article_id").alias("id"), F.col("new_status").alias("status"), "published_at")
        append_batch(changed.withColumn("epoch", F.lit(epoch).cast("long")), log, epoch)
        base.unpersist()
        batch.unpersist()

    writer = events.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
