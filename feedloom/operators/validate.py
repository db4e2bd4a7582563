"""Row validation: every rule adds ``(path, message)`` entries, nothing is thrown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import checks as ck
from feedloom.schemas import (
    ARTICLE_STATUSES, ERROR_STATUS, FETCH_STRATEGIES, SOURCE_STATUSES, SOURCE_TYPES,
)


def article_issues() -> Column:
    """Issues of a new article; ``original.published_at`` and ``language`` may be null."""
    url, date = F.col("original.url"), F.col("original.published_at")
    rules = ck.required(F.col("source_id"), "sourceId", "Source ID is required")
    for name in ("title", "summary", "content"):
        rules += ck.required(F.col(f"original.{name}"), f"original.{name}", f"Original {name} is required")
    rules += ck.web_address(url, "original.url", "Original URL must be valid")
    rules.append(ck.issue(~ck.is_datetime_with_offset(date), "original.publishedAt", ck.BAD_DATETIME))
    rules += ck.short_text(F.col("language"), "language")
    return ck.issues(*rules)


def source_issues() -> Column:
    """Issues of a new source."""
    rules = ck.required(F.col("name"), "name", "Name is required")
    rules += ck.one_of(F.col("type"), "type", SOURCE_TYPES, missing="Type is required")
    rules += ck.web_address(F.col("url"), "url")
    rules.append(ck.issue(F.col("priority") < 1, "priority", "Priority must be >= 1"))
    rules.append(ck.issue(F.col("fetch_interval") <= 0, "fetchInterval", "fetchInterval must be > 0"))
    rules += ck.short_text(F.col("language"), "language")
    rules += ck.one_of(F.col("fetch_strategy"), "fetchStrategy", FETCH_STRATEGIES)
    return ck.issues(*rules)


def _given(field: str) -> Column:
    """True where a patch row sets ``field`` (absent and null are different things)."""
    return F.array_contains("fields", field)


def _not_null(columns: dict[str, str]) -> list[Column]:
    """Set to null although the field takes no null."""
    return [
        ck.issue(_given(c) & F.col(c).isNull(), path, "Expected string, received null")
        for c, path in columns.items()
    ]


def article_patch_issues(has_ai: bool = False) -> Column:
    """Issues of an article patch; only fields listed in ``fields`` are looked at."""
    rules = _not_null({"slug": "slug", "language": "language", "author": "author",
                       "cover_image": "coverImage", "status": "status"})
    rules.append(ck.issue(_given("tags") & F.col("tags").isNull(), "tags", "Expected array, received null"))
    rules.append(ck.issue(_given("slug") & (F.col("slug") == ""), "slug", ck.TOO_SHORT))
    language = F.when(_given("language"), F.col("language"))
    rules += ck.short_text(language, "language")
    rules += ck.one_of(F.when(_given("status"), F.col("status")), "status", ARTICLE_STATUSES)
    if has_ai:
        for part in ("input", "output", "total"):
            used = F.col(f"ai.token_usage.{part}")
            rules.append(ck.issue(_given("ai") & (used < 0), f"ai.tokenUsage.{part}", ck.NEGATIVE))
    return ck.issues(*rules)


def source_patch_issues() -> Column:
    """Issues of a source patch; only fields listed in ``fields`` are looked at."""
    def set_to(c: str) -> Column:
        return F.when(_given(c), F.col(c))

    rules = _not_null({"name": "name", "type": "type", "url": "url", "status": "status",
                       "language": "language", "description": "description",
                       "fetch_strategy": "fetchStrategy"})
    rules.append(ck.issue(set_to("name") == "", "name", "Name is required"))
    rules += ck.one_of(set_to("type"), "type", SOURCE_TYPES)
    rules.append(ck.issue(~ck.is_url(set_to("url")), "url", ck.BAD_URL))
    rules += ck.one_of(set_to("status"), "status", SOURCE_STATUSES)
    rules.append(ck.issue(set_to("priority") < 1, "priority", "Priority must be >= 1"))
    rules.append(ck.issue(set_to("fetch_interval") <= 0, "fetchInterval", "fetchInterval must be > 0"))
    rules += ck.short_text(set_to("language"), "language")
    rules += ck.one_of(set_to("fetch_strategy"), "fetchStrategy", FETCH_STRATEGIES)
    return ck.issues(*rules)


def id_issues(kind: str) -> Column:
    return ck.issues(*ck.required(F.col("id"), "id", f"{kind} ID is required"))


def with_errors(df: DataFrame, issues: Column) -> DataFrame:
    return df.withColumn("errors", issues)


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") == 0).drop("errors")


def rejected_rows(checked: DataFrame) -> DataFrame:
    """Rejected rows with their error code and the path → messages map."""
    bad = checked.filter(F.size("errors") > 0)
    return with_code(bad, "VALIDATION_ERROR").withColumn("details", details_by_path(F.col("errors")))


def details_by_path(errors: Column) -> Column:
    """``map<path, array<message>>`` of one row's issues, in rule order."""
    paths = F.array_distinct(F.transform(errors, lambda e: e["path"]))
    return F.map_from_entries(
        F.transform(
            paths,
            lambda p: F.struct(
                p.alias("path"),
                F.transform(F.filter(errors, lambda e: e["path"] == p), lambda e: e["message"]).alias("messages"),
            ),
        )
    )


def issue_rows(rejected: DataFrame, *keys: str) -> DataFrame:
    """Long form: one row per issue."""
    rows = rejected.select(*keys, "error_code", "status_code", F.explode("errors").alias("e"))
    return rows.select(*keys, "e.path", "e.message", "error_code", "status_code")


def with_code(df: DataFrame, code: str) -> DataFrame:
    """Classify outcome rows: error code and HTTP-like status."""
    return df.withColumn("error_code", F.lit(code)).withColumn("status_code", F.lit(ERROR_STATUS[code]))


def not_found(ids: DataFrame, kind: str, key: str = "id") -> DataFrame:
    """Ids without a row, with the NOT_FOUND outcome."""
    text = F.format_string(f"{kind} with id '%s' not found", F.col(key))
    return with_code(ids.select(key, text.alias("message")), "NOT_FOUND")
