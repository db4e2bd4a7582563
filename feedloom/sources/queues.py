"""Queue and event tables: message sink, message scan, event scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.jsontext import article_message, message_article_id

APPROVED_EVENT = "ArticleApproved"


def article_messages(articles: DataFrame) -> DataFrame:
    """One JSON message per new article."""
    return articles.select(article_message(F.col("id")).alias("value"))


def send_messages(articles: DataFrame, queue_path: str | None) -> None:
    """Write the messages of new articles; without a configured queue nothing is sent."""
    if queue_path:
        article_messages(articles).write.mode("append").text(queue_path)


def read_messages(queue: DataFrame) -> DataFrame:
    """Queue rows with the article id taken from either body form."""
    return queue.withColumn("article_id", message_article_id(F.col("body")))


def approved_events(events: DataFrame) -> DataFrame:
    """Events of the approved type: ``(article_id, ts)``. Works on streams as well."""
    wanted = events.filter(F.col("detail_type") == APPROVED_EVENT)
    return wanted.select(F.get_json_object("detail", "$.articleId").alias("article_id"), "ts")
