"""Queue processing: routing of each message, retries, dead letters, expiry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators.joins import probe_join
from feedloom.schemas import DEAD_LETTER_RETENTION_DAYS, MAX_RECEIVES, QUEUE_RETENTION_HOURS
from feedloom.sources.queues import read_messages
from feedloom.sources.store import append_batch


def route_messages(queue: DataFrame, articles: DataFrame, as_of: Column) -> DataFrame:
    """Every message with its article's status and one outcome.

    EXPIRED past the retention; DEAD_LETTER when received too often, or failing on the
    last receive; RETRY when it fails earlier; else PROCESSED. Failing means that the
    article does not exist. A batch naming few articles only scans the article table.
    """
    table = articles.select(F.col("id").alias("article_id"), F.col("status").alias("article_status"))
    joined = probe_join(read_messages(queue), table, "article_id", F.col("message_id"))
    failed, received = F.col("hit").isNull(), F.col("receive_count")
    outcome = (
        F.when(F.col("sent_at") < as_of - F.expr(f"interval {QUEUE_RETENTION_HOURS} hours"), "EXPIRED")
        .when((received > MAX_RECEIVES) | (failed & (received >= MAX_RECEIVES)), "DEAD_LETTER")
        .when(failed, "RETRY")
        .otherwise("PROCESSED")
    )
    return joined.select(
        "message_id", "article_id", "body", "receive_count", "sent_at",
        F.col("hit.article_status").alias("article_status"), outcome.alias("outcome"),
    )


def with_outcome(routed: DataFrame, outcome: str) -> DataFrame:
    return routed.filter(F.col("outcome") == outcome)


def retry_messages(routed: DataFrame) -> DataFrame:
    """Messages to deliver again, with the next receive count."""
    again = with_outcome(routed, "RETRY")
    return again.select("message_id", "body", (F.col("receive_count") + 1).alias("receive_count"), "sent_at")


def live_dead_letters(dead: DataFrame, as_of: Column) -> DataFrame:
    """Dead letters still within their own retention."""
    limit = as_of - F.expr(f"interval {DEAD_LETTER_RETENTION_DAYS} days")
    return dead.filter(F.col("sent_at") >= limit)


def run_queue(
    messages: DataFrame,
    articles: Callable[[], DataFrame],
    out: str,
    checkpoint: str,
    as_of: Column | None = None,
    retry_to: str | None = None,
) -> StreamingQuery:
    """Drain a message stream; every micro-batch appends its routed rows below ``out``.

    A batch that fails is replayed as a whole and replaces its own output. Retries go to
    ``retry_to``; put that folder among the stream's inputs and the next run reads them.
    """
    def process(batch: DataFrame, epoch: int) -> None:
        now = F.current_timestamp() if as_of is None else as_of
        batch.persist()
        path = append_batch(route_messages(batch, articles(), now), out, epoch)
        batch.unpersist()
        if retry_to:
            written = batch.sparkSession.read.parquet(path)
            append_batch(retry_messages(written), retry_to, epoch)

    writer = messages.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
