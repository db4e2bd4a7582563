"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Feeds and pages are wide rows: smaller read splits keep parsing tasks short.
    "spark.sql.files.maxPartitionBytes": "64m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply ``SETTINGS``; the cluster's own master, memory and shuffle sizes stay as they are."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
