"""Scheduled collection: each trigger collects the feed documents that arrived since the last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators.mutate import insert_if_absent
from feedloom.plans.collection import collect_feeds
from feedloom.sources.queues import article_messages
from feedloom.sources.store import append_batch, state_before

PERIOD = "15 minutes"
#: The outputs of a run from feed documents, each a folder with one batch per epoch.
OUTPUTS = ("articles", "errors", "summary", "messages")
IDS = "id string"


def _distinct_ids(rows: DataFrame) -> DataFrame:
    return rows.select("id").distinct()


def stored_ids(spark: SparkSession, out: str, epoch: int) -> DataFrame:
    """Ids of the articles that earlier epochs wrote below ``out``."""
    return state_before(spark, out, spark.createDataFrame([], IDS).schema, epoch, _distinct_ids)


def _start(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, scheduled: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": PERIOD} if scheduled else {"availableNow": True}
    return writer.trigger(**trigger).start()


def run_collection(
    arrivals: DataFrame,
    collect: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    queue_path: str | None = None,
    scheduled: bool = False,
) -> StreamingQuery:
    """``collect`` turns the new rows of one trigger into accepted article rows.

    Articles already stored are left out, so a replayed batch or a re-delivered feed adds
    nothing. Without ``scheduled`` the stream stops when it has read what is there.
    """
    def process(batch: DataFrame, epoch: int) -> None:
        rows = collect(batch).persist()
        stored = stored_ids(batch.sparkSession, out, epoch)
        order = [c for c in ("pos", "item_id") if c in rows.columns] or ["id"]
        path = append_batch(insert_if_absent(rows, stored, "id", *order, small_batch=True), out, epoch)
        rows.unpersist()
        if queue_path:
            written = batch.sparkSession.read.parquet(path)
            append_batch(article_messages(written), queue_path, epoch)

    return _start(arrivals, process, checkpoint, scheduled)


def run_feed_collection(
    feeds: DataFrame,
    sources: Callable[[], DataFrame],
    pages: Callable[[], DataFrame],
    stored: Callable[[], DataFrame],
    out: str,
    checkpoint: str,
    as_of: Column | None = None,
    scheduled: bool = False,
) -> StreamingQuery:
    """Collect the raw feed documents ``feeds(source_id, feed_no, feed_xml)`` that arrived.

    Each epoch writes its new articles, its errors (documents that cannot be parsed, items that
    are refused), its counters and its queue messages as ``<out>/<output>/batch=<epoch>``, and
    then a commit. ``read_output`` reads committed epochs only, so all outputs of an epoch
    appear together. A replayed epoch starts from the same articles and replaces its own
    output. ``stored`` (id) are the articles from before the stream.
    """
    def process(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = stored().select("id").unionByName(stored_ids(spark, f"{out}/articles", epoch))
        now = F.current_timestamp() if as_of is None else as_of
        run = collect_feeds(batch, sources(), pages(), known, now, work_dir=f"{out}/work/epoch={epoch}")
        path = append_batch(run.created, f"{out}/articles", epoch)
        append_batch(run.errors, f"{out}/errors", epoch)
        append_batch(run.summary, f"{out}/summary", epoch)
        append_batch(article_messages(spark.read.parquet(path)), f"{out}/messages", epoch)
        append_batch(spark.range(1).select(F.lit(epoch).cast("long").alias("epoch")), f"{out}/commits", epoch)

    return _start(feeds, process, checkpoint, scheduled)


def read_output(spark: SparkSession, out: str, output: str) -> DataFrame:
    """One of ``OUTPUTS`` with its ``epoch``, committed epochs only."""
    if output not in OUTPUTS:
        raise ValueError(f"no output {output!r}")
    rows = spark.read.parquet(f"{out}/{output}").withColumnRenamed("batch", "epoch")
    commits = spark.read.parquet(f"{out}/commits").select(F.col("epoch").alias("_epoch"))  # one row per epoch
    return rows.join(commits, F.col("epoch") == F.col("_epoch"), "left_semi")


def due_sources(sources: DataFrame, last_fetch: DataFrame, as_of: Column) -> DataFrame:
    """Active sources whose interval has passed (or that were never fetched), best priority first.

    ``last_fetch(source_id, last_fetch)`` holds each source once.
    """
    joined = sources.filter(F.col("status") == "ACTIVE").join(last_fetch, "source_id", "left")
    minutes = F.make_interval(mins=F.col("fetch_interval"))
    due = F.col("last_fetch").isNull() | (F.col("last_fetch") + minutes <= as_of)
    return joined.filter(due).orderBy("priority", "source_id")
