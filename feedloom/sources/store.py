"""Tables on shared storage: versioned snapshots, idempotent batch appends, bucketed tables.

Parquet has no MERGE, so a mutation writes the next version beside the one it reads and
nothing is overwritten while it is read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_SETTING = "spark.checkpoint.dir"
#: Epochs between two snapshots of a log's state.
COMPACT_EVERY = 16


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder as named by ``spark.checkpoint.dir``.

    Only a local session without that setting, such as a test, gets a temporary folder.
    """
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all machines share")
    local = Path(tempfile.mkdtemp(prefix="feedloom-")).as_uri()
    spark.conf.set(CHECKPOINT_SETTING, local)
    return local


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write a frame once and read it from there, replacing what an earlier run left.

    For results that several later jobs use: they are not computed again, not even after
    the loss of an executor, and each job reads only the columns it needs.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_snapshot(df: DataFrame, root: str, version: int, partition_by: str | None = None) -> str:
    """Write a whole table state as ``root/v=<version>``; an existing version is an error.

    Partition by ``status`` or ``source_id`` so that scans by these prune whole folders.
    Rebalancing gathers each value into few files and splits a value that is too large.
    """
    path = f"{root}/v={version}"
    if partition_by:
        df.hint("rebalance", partition_by).write.mode("error").partitionBy(partition_by).parquet(path)
    else:
        df.write.mode("error").parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str, version: int, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{root}/v={version}")


def append_batch(df: DataFrame, root: str, batch: int) -> str:
    """Add one batch as ``root/batch=<n>``; writing the same batch again replaces it."""
    path = f"{root}/batch={batch}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_batches(
    spark: SparkSession, root: str, schema: T.StructType, before: int | None = None
) -> DataFrame:
    """All appended batches (below ``before``); an empty frame where there is none yet."""
    wide = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    try:
        rows = spark.read.schema(wide).parquet(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    return rows.drop("batch")


def _existing(spark: SparkSession, paths: list[str], schema: T.StructType) -> list[str]:
    """The paths that are there; each is only analysed."""
    found = []
    for path in paths:
        try:
            spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            found.append(path)
    return found


def state_paths(root: str, epoch: int, every: int = COMPACT_EVERY) -> list[str]:
    """Where the rows appended before ``epoch`` stand: the newest snapshot and later batches,
    ``every`` folders at most."""
    last = epoch // every * every
    snapshot = [f"{root}-snapshots/before={last}"] if last else []
    return [*snapshot, *[f"{root}/batch={n}" for n in range(last, epoch)]]


def state_before(
    spark: SparkSession, root: str, schema: T.StructType, epoch: int,
    reduce: Callable[[DataFrame], DataFrame], every: int = COMPACT_EVERY,
) -> DataFrame:
    """What the batches appended before ``epoch`` come to.

    ``reduce`` brings rows in ``schema`` to the rows that count, and may be applied again to
    its own results. Every ``every`` epochs the state is written as a snapshot, so that later
    epochs read this and the batches since. A replayed epoch writes the same snapshot again.
    """
    if epoch and epoch % every == 0:
        paths = state_paths(root, epoch - 1, every) + [f"{root}/batch={epoch - 1}"]
        _rows_of(spark, paths, schema, reduce).write.mode("overwrite").parquet(f"{root}-snapshots/before={epoch}")
    return _rows_of(spark, state_paths(root, epoch, every), schema, reduce)


def _rows_of(spark: SparkSession, paths: list[str], schema: T.StructType, reduce: Callable[[DataFrame], DataFrame]) -> DataFrame:
    present = _existing(spark, paths, schema)
    rows = spark.read.schema(schema).parquet(*present) if present else spark.createDataFrame([], schema)
    return reduce(rows)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Save as a table bucketed by ``key``: joins and anti joins on it do not shuffle it."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
