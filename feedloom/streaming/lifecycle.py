"""Command stream: carry out lifecycle commands as they arrive.

The article table is not rewritten per batch. Each batch appends the outcome of its
commands and the resulting statuses; the current status of an article is its newest
appended one, else the stored one, looked up for the articles of the batch only. The
appended statuses are compacted now and then, so a batch reads a bounded number of folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators.joins import batch_join, probe
from feedloom.operators.lifecycle import final_statuses, replay
from feedloom.sources.store import append_batch, state_before

STATUS_SCHEMA = "id string, status string, published_at timestamp, epoch long"


def newest(changes: DataFrame) -> DataFrame:
    """The last of the appended ``changes`` of each article."""
    last = F.max_by(F.struct("status", "published_at", "epoch"), F.col("epoch")).alias("_now")
    return changes.groupBy("id").agg(last).select("id", "_now.*")


def current_statuses(articles: DataFrame, changes: DataFrame) -> DataFrame:
    """``(id, status, published_at)`` after the appended ``changes``."""
    latest = newest(changes).select("id", F.struct("status", "published_at").alias("_now"))
    joined = batch_join(articles.select("id", "status", "published_at"), latest, "id")
    hit = F.col("_now").isNotNull()
    return joined.select(
        "id",
        F.when(hit, F.col("_now.status")).otherwise(F.col("status")).alias("status"),
        F.when(hit, F.col("_now.published_at")).otherwise(F.col("published_at")).alias("published_at"),
    )


def statuses_before(articles: DataFrame, ids: DataFrame, log: str, epoch: int) -> DataFrame:
    """``current_statuses`` of the articles ``ids`` (id) as they were before a batch."""
    schema = articles.sparkSession.createDataFrame([], STATUS_SCHEMA).schema
    changes = state_before(articles.sparkSession, log, schema, epoch, newest)
    table = articles.select("id", "status", "published_at")
    return current_statuses(probe(table, ids, "id"), probe(changes, ids, "id"))


def run_lifecycle(
    commands: DataFrame, articles: Callable[[], DataFrame], outcomes: str, statuses: str, checkpoint: str
) -> StreamingQuery:
    """Drain ``commands(seq, article_id, command, ts)``; batches must arrive in time order,
    inside a batch the order is ``(ts, seq)``. A replayed batch starts from the statuses
    before it and replaces its own output."""
    def process(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        ids = batch.select(F.col("article_id").alias("id")).distinct()
        base = statuses_before(articles(), ids, statuses, epoch).persist()
        path = append_batch(replay(base, batch), outcomes, epoch)
        done = batch.sparkSession.read.parquet(path)
        ends = final_statuses(base, done)
        append_batch(ends.withColumn("epoch", F.lit(epoch).cast("long")), statuses, epoch)
        base.unpersist()
        batch.unpersist()

    writer = commands.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
