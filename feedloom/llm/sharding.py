"""Rendezvous hashing of records onto weighted shards.

Every shard bids for every key: the bid is an exponential variate drawn from the hash of
(key, shard), divided by the shard's weight, and the lowest bid wins. A shard's expected
share is its weight's share. A bid depends on nothing but key, shard and weight, so a new
shard takes rows only into itself, and a shard that goes leaves the others' rows in place.
No shuffle is needed; only the slots are numbered through counts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import gapless_rank

#: Bytes that a record needs besides its text.
HEADER_BYTES = 8


def bid(key: Column, shard: int, weight: float) -> Column:
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(2.0**53)
    return -F.ln(uniform) / F.lit(float(weight))


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard that wins ``key``; a tie goes to the smaller shard number."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("there must be a shard, and each weight must be above 0")
    bids = [F.struct(bid(key, s, w).alias("bid"), F.lit(s).alias("shard")) for s, w in sorted(weights.items())]
    return (F.least(*bids) if len(bids) > 1 else bids[0])["shard"]


def shard_records(
    docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float] | None = None
) -> DataFrame:
    """Shard, slot, size and checksum of every record of ``docs`` (doc_id, text).

    ``grown`` are the weights after a planned change; ``grown_shard`` is the shard then.
    A null text counts as empty: ``HEADER_BYTES`` bytes, checksum 0. Rows with equal ids,
    and all rows with a null id, share a key, hence a shard; each keeps a slot of its own.
    Slots of a shard run from 0 without gaps. Other columns of ``docs`` are left out; an
    empty table gives an empty one.
    """
    text, key = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(HEADER_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"),
        (rendezvous(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    ranked = gapless_rank(rows, ["shard"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard")
