"""Deterministic entity ids.

An id is the full md5 of the natural key, so collecting the same item twice gives
the same id and insert-if-absent makes re-collection idempotent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def article_id(source_id: Column, url: Column) -> Column:
    return F.concat(F.lit("art_"), F.md5(F.concat(source_id, F.lit("~"), url)))


def source_id(url: Column) -> Column:
    return F.concat(F.lit("src_"), F.md5(url))
