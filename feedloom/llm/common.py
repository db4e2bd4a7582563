"""Helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.sources.store import run_dir, stage

#: Words in a shingle.
WINDOW = 5
#: Words are runs of anything but these six characters.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it from there.

    Cuts the lineage, so that later jobs and lost executors read the table again instead of
    repeating the work.
    """
    return stage(df, run_dir(df.sparkSession, name))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it as often as wanted, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def window_hashes(tokens: Column, window: int = WINDOW) -> Column:
    """64-bit hashes of all windows of ``window`` words of the array column ``tokens``."""
    starts = F.sequence(F.lit(0), F.size(tokens) - window)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(window)]))
    return F.when(F.size(tokens) >= window, hashes).otherwise(F.expr("cast(array() as array<bigint>)"))


def gapless_rank(rows: DataFrame, groups: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the column ``name``.

    The rows are written once with their partition and position. Only the counts of each
    (group, partition) are summed up; rows are numbered inside these pairs, whose size is
    that of an input partition at most, so a group that holds a third of all rows still
    spreads over many tasks. ``groups`` have no nulls.
    """
    numbered = staged(rows.withColumn("_row", F.monotonically_increasing_id()), f"rank-{name}")
    numbered = numbered.withColumn("_part", F.shiftright("_row", 33))
    keys = [*groups, "_part"]
    counts = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("_row")) - 1
    placed = numbered.withColumn("_in", inside).join(starts, keys)
    return placed.withColumn(name, F.col("_start") + F.col("_in")).drop("_row", "_part", "_in", "_start")
