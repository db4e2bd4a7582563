"""JSON text helpers for queue bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_json_or(json: Column, schema: str, fallback: Column) -> Column:
    """Typed JSON value, or ``fallback`` when the text is not valid JSON."""
    valid = F.try_parse_json(json).isNotNull()
    return F.when(valid, F.from_json(json, schema)).otherwise(fallback)


def message_article_id(body: Column) -> Column:
    """Queue bodies come as ``{"articleId": …}`` or as the bare id."""
    return F.coalesce(F.get_json_object(body, "$.articleId"), body)


def article_message(id_col: Column) -> Column:
    return F.to_json(F.struct(id_col.alias("articleId")))
