"""Entity schemas, closed value sets and default literals of the news model."""

from __future__ import annotations

from pyspark.sql import types as T

# Closed sets, thresholds and defaults every result depends on.
ARTICLE_STATUSES = (
    "RAW", "NORMALIZED", "AI_PROCESSING", "PENDING_REVIEW",
    "APPROVED", "PUBLISHED", "REJECTED", "ARCHIVED",
)
SOURCE_TYPES = ("RSS", "API")
SOURCE_STATUSES = ("ACTIVE", "INACTIVE")
FETCH_STRATEGIES = ("RSS_ONLY", "RSS_PLUS_HTML_FETCH", "AUTO")
USER_ROLES = ("ADMIN", "EDITOR", "VIEWER")
FULL_CONTENT_CHARS = 1000
EXCERPT_CHARS = 160
WORDS_PER_MINUTE = 200
DEFAULT_LANGUAGE = "en"
DEFAULT_PRIORITY = 10
DEFAULT_FETCH_INTERVAL = 60
DEFAULT_PAGE_LIMIT = 20
MAX_PAGE_LIMIT = 100
MAX_RECEIVES = 3
QUEUE_RETENTION_HOURS = 24
DEAD_LETTER_RETENTION_DAYS = 7
KNOWN_ITEM_KEYS = (
    "title", "contentSnippet", "content:encoded", "content", "link",
    "pubDate", "isoDate", "creator", "author", "dc:creator",
    "enclosure", "media:content", "media:thumbnail", "categories", "guid",
)
ERROR_STATUS = {
    "VALIDATION_ERROR": 400,
    "NOT_FOUND": 404,
    "INFRASTRUCTURE_ERROR": 502,
    "CONTENT_FETCH_ERROR": 502,
    "INTERNAL_ERROR": 500,
}


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


ORIGINAL = T.StructType(
    _strings("title", "summary", "content", "url", "published_at", "image", "author")
)

TOKEN_USAGE = T.StructType([T.StructField(n, T.LongType()) for n in ("input", "output", "total")])

AI = T.StructType(
    _strings("title", "summary", "content", "seo_title", "seo_description")
    + [T.StructField("keywords", T.ArrayType(T.StringType()))]
    + _strings("model", "prompt_version", "processed_at")
    + [
        T.StructField("processing_time", T.DoubleType()),
        T.StructField("token_usage", TOKEN_USAGE),
    ]
)

SOURCE = T.StructType(
    _strings("source_id", "name", "type", "url", "status")
    + [T.StructField("priority", T.IntegerType()), T.StructField("fetch_interval", T.IntegerType())]
    + _strings("language", "description", "fetch_strategy")
    + [T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType())]
)

ARTICLE = T.StructType(
    _strings("id", "slug", "source_id", "category_id")
    + [T.StructField("tags", T.ArrayType(T.StringType()))]
    + _strings("language", "author", "cover_image")
    + [T.StructField("original", ORIGINAL), T.StructField("ai", AI)]
    + _strings("status")
    + [T.StructField(n, T.TimestampType()) for n in ("published_at", "created_at", "updated_at")]
)

CATEGORY = T.StructType(
    _strings("id", "name", "slug", "description", "parent_id")
    + [
        T.StructField("is_active", T.BooleanType()),
        T.StructField("order", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

TAG = T.StructType(
    _strings("id", "name", "slug")
    + [
        T.StructField("article_count", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

ITEM_FIELDS = ("title", "summary", "content", "url", "published_at", "author", "image")
FETCHED_FIELDS = (
    "title", "html", "text", "excerpt", "hero_image", "author",
    "published_at", "word_count", "reading_time_minutes",
)
