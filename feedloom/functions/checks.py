"""Row checks that build ``errors: array<struct<path,message>>`` columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted shapes and messages.
DATETIME_OFFSET = (
    r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
)
URL_SHAPE = r"^[A-Za-z][A-Za-z0-9+.-]*:.+"
WEB_SCHEME = r"^(?i)(https?|ftp|wss?):"
WEB_URL = r"^[A-Za-z]+:/*[^\s/?#]+([/?#].*)?$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
REQUIRED = "Required"
NOT_EMPTY = "Must not be empty"
TOO_SHORT = "String must contain at least 1 character(s)"
TOO_LONG_10 = "String must contain at most 10 character(s)"
BAD_DATETIME = "Invalid datetime"
BAD_URL = "Must be a valid URL"
BAD_UUID = "Invalid uuid"
NEGATIVE = "Number must be greater than or equal to 0"


def is_datetime_with_offset(c: Column) -> Column:
    """Shape and a real calendar day; null stays null, so null never counts as wrong."""
    real_day = F.substring(c, 1, 10).try_cast("date").isNotNull()
    return F.when(c.isNotNull(), c.rlike(DATETIME_OFFSET) & real_day)


def is_url(c: Column) -> Column:
    return c.rlike(URL_SHAPE) & (~c.rlike(WEB_SCHEME) | c.rlike(WEB_URL))


def is_uuid(c: Column) -> Column:
    return c.rlike(UUID)


def enum_message(values: Sequence[str], received: Column) -> Column:
    expected = " | ".join(f"'{v}'" for v in values)
    return F.concat(F.lit(f"Invalid enum value. Expected {expected}, received '"), received, F.lit("'"))


def issue(when: Column, path: str, message: str | Column) -> Column:
    """One ``(path, message)`` entry where ``when`` holds, else null."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(path).alias("path"), text.alias("message")))


def issues(*entries: Column) -> Column:
    """All entries that apply, in rule order."""
    return F.filter(F.array(*entries), lambda e: e.isNotNull())


def required(c: Column, path: str, message: str = TOO_SHORT) -> list[Column]:
    """Text of at least one character (blanks count); null means the field is absent."""
    return [issue(c.isNull(), path, REQUIRED), issue(c == "", path, message)]


def short_text(c: Column, path: str) -> list[Column]:
    return [issue(c == "", path, TOO_SHORT), issue(F.length(c) > 10, path, TOO_LONG_10)]


def web_address(c: Column, path: str, message: str = BAD_URL) -> list[Column]:
    return [issue(c.isNull(), path, REQUIRED), issue(~is_url(c), path, message)]


def one_of(c: Column, path: str, values: Sequence[str], missing: str | None = None) -> list[Column]:
    checks = [issue(~c.isin(*values), path, enum_message(values, c))]
    return [issue(c.isNull(), path, missing), *checks] if missing else checks


def primitive_checks(uuid: Column, text: Column, moment: Column, url: Column) -> Column:
    """The four stand-alone primitive rules: uuid, non-empty text, ISO date, URL."""
    return issues(
        issue(~is_uuid(uuid), "uuid", BAD_UUID),
        issue(text == "", "text", NOT_EMPTY),
        issue(~is_datetime_with_offset(moment), "date", BAD_DATETIME),
        issue(~is_url(url), "url", BAD_URL),
    )
