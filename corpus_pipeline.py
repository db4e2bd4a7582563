"""A corpus pipeline: raw documents to packed training sequences.

Each stage reads what its predecessor kept, as a table; all but the last give the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import decontaminate, line_dedup, near_dedup, packing, quality
from feedloom.llm.common import staged, table

#: Stages on word shingles take five words and this least similarity.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.accepted(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; so do documents of which nothing is left."""
    cut = line_dedup.drop_repeated_lines(docs)
    changed = F.col("n_deleted_lines") > 0
    left = cut.filter(~(changed & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.representatives(docs, NEAR_PERCENT).select(docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of training sequences with their texts."""
    return packing.pack(docs, texts=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("near duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("packing", packed_sequences),
]
#: Alignment, signatures and fingerprints have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
