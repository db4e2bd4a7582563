"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import staged


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, label) of every node with an edge; label: the component's smallest node.

    Alternates two steps until nothing changes: every node tells the smallest of its
    neighbours to the larger ones, then to the smaller ones. Each keeps the connected
    components and leaves stars in the end, after about log(n) rounds. The edges are written
    after each round; only whether they are stars comes to the driver.
    """
    pairs = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).filter("a <> b")
    now = staged(pairs.distinct(), "edges")
    while not _stars(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Now a > b in every row; the smaller neighbours of each node are told its smallest.
        now = staged(_tell(_tell(both, larger=True), larger=False).distinct(), "edges")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)


def _stars(pairs: DataFrame) -> bool:
    """Whether every ``a`` has one ``b``, and no ``b`` is an ``a``."""
    ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(pairs.select("b", F.lit(0)))
    sides = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return sides.filter("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def _tell(pairs: DataFrame, larger: bool) -> DataFrame:
    """For every node ``a``, link its larger (or all the given) neighbours ``b`` with the least one."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = pairs.join(least, "a")
    if larger:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b")
