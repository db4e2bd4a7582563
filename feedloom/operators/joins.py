"""Joins for hot keys, unchecked dimension sizes and small batches against huge tables.

A source, an article or a URL may own a third of all rows. ``lookup_join`` takes such
keys out of the shuffle: the hot keys (at most ``MAX_HOT_KEYS``, so always broadcastable)
are found by a partial aggregation on the key column alone, their rows are spread evenly
over the shuffle and served by a broadcast of the few matching right rows. All other keys
take the ordinary shuffle join. The result is the same as that of a plain left join.

``dimension_join``, ``batch_join`` and ``probe_join`` broadcast the side that is expected
to be small, but only after counting it (reading at most one row more than allowed), and
fall back to a shuffle join. Both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEY_ROWS = 1_000_000
MAX_HOT_KEYS = 200
MAX_BROADCAST_ROWS = 100_000
MAX_WIDE_BROADCAST_ROWS = 2_000


def hot_keys(
    df: DataFrame, key: str, min_rows: int = HOT_KEY_ROWS, max_keys: int = MAX_HOT_KEYS
) -> DataFrame:
    """The ``max_keys`` most frequent keys with at least ``min_rows`` rows.

    Ties are ordered by the key, so every evaluation gives the same set. A key that is
    left out merely stays in the shuffle join: with 200 keys taken out, each
    remaining one holds less than 0.5 % of the rows.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    top = counts.filter(F.col("_rows") >= min_rows).orderBy(F.desc("_rows"), key).limit(max_keys)
    return top.select(key)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: Column,
    hot: DataFrame | None = None,
    hit: str = "hit",
) -> DataFrame:
    """Left join to a side that is unique per text ``key``; adds its row as struct ``hit``.

    ``spread_by`` is any well-spread expression of the left row. ``hot`` may be passed
    when the hot keys are known from a cheaper table than ``left``; rows whose key is
    null never match and are spread like hot ones.
    """
    hot = hot_keys(left, key) if hot is None else hot
    flagged = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    own_way = F.col("_hot").isNotNull() | F.col(key).isNull()
    keyed = flagged.withColumn("_cold", ~own_way).withColumn(
        "_on", F.when(own_way, F.hash(spread_by).cast("string")).otherwise(F.col(key))
    )

    record = F.struct(*[F.col(c) for c in right.columns])
    cold = right.select(F.col(key).alias("_right_on"), record.alias("_cold_hit"))
    few = right.join(F.broadcast(hot), key, "left_semi").select(key, record.alias("_hot_hit"))

    # One equi key only, so that a right side already partitioned by ``key`` stays in place.
    shuffled = keyed.join(cold, (F.col("_on") == F.col("_right_on")) & F.col("_cold"), "left")
    joined = shuffled.join(F.broadcast(few), key, "left")
    return joined.withColumn(hit, F.coalesce("_hot_hit", "_cold_hit")).select(*left.columns, hit)


def fits_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Count at most ``max_rows + 1`` rows of a supposedly small table."""
    return df.limit(max_rows + 1).count() <= max_rows


def dimension_join(
    facts: DataFrame, dim: DataFrame, key: str, spread_by: Column, how: str = "inner"
) -> DataFrame:
    """Join facts to a table unique per ``key``: broadcast if its counted size allows,
    otherwise a hot-key-safe shuffle join."""
    if fits_broadcast(dim):
        return facts.join(F.broadcast(dim), key, how)
    joined = lookup_join(facts, dim, key, spread_by, hit="_dim")
    if how == "inner":
        joined = joined.filter(F.col("_dim").isNotNull())
    extra = [F.col(f"_dim.{c}").alias(c) for c in dim.columns if c != key]
    return joined.select(*facts.columns, *extra)


def batch_join(
    table: DataFrame, batch: DataFrame, key: str, how: str = "left", max_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Join a table to a batch unique per ``key`` without moving the table if the batch is small."""
    return table.join(F.broadcast(batch) if fits_broadcast(batch, max_rows) else batch, key, how)


def probe(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Table rows whose key is listed; ``keys`` is distinct."""
    return batch_join(table, keys.select(key), key, "left_semi")


def probe_join(
    left: DataFrame, right: DataFrame, key: str, spread_by: Column, hit: str = "hit",
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``lookup_join`` for a left side with few distinct keys: the right table is only
    scanned for these, and its matches (one per key at most) are broadcast."""
    keys = left.select(key).distinct()
    if not fits_broadcast(keys, max_rows):
        return lookup_join(left, right, key, spread_by, hit=hit)
    found = right.join(F.broadcast(keys), key, "left_semi")
    record = F.struct(*[F.col(c) for c in right.columns]).alias(hit)
    return left.join(F.broadcast(found.select(key, record)), key, "left").select(*left.columns, hit)
