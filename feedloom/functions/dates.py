"""Lenient date reading and ISO output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted shapes, zone names of RFC-822 and the output format.
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
_RFC822 = r"^(?:[A-Za-z]{3,9},? )?(\d{1,2} [A-Za-z]{3} \d{4}) (\d{2}:\d{2})(:\d{2})? ?(\S*)$"
_ZONES = {
    "Z": "+0000", "GMT": "+0000", "UTC": "+0000", "UT": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso_utc(ts: Column) -> Column:
    """Timestamp to ``…T…sssZ`` text in UTC, whatever the session zone is."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), ISO_FORMAT)


def _rewrite(c: Column, *rules: tuple[str, str]) -> Column:
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def parse_date(raw: Column) -> Column:
    """ISO date, ISO datetime (no offset means UTC) or RFC-822; otherwise null."""
    text = F.regexp_replace(F.trim(raw), r"\s+", " ")
    iso_text = _rewrite(
        text,
        (r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00Z"),
        (r"([T ]\d{2}:\d{2})(Z|[+-]|$)", "$1:00$2"),
        (r"([+-]\d{2})(\d{2})$", "$1:$2"),
        (r"([T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?)$", "$1Z"),
    )
    rfc_text = _rewrite(
        text,
        (_RFC822, "$1 $2$3 $4"),
        (r"( \d{2}:\d{2}) ", "$1:00 "),
        (r" $", " GMT"),
        (r"([+-]\d{2}):(\d{2})$", "$1$2"),
        *[(f"(?i) {name}$", f" {offset}") for name, offset in _ZONES.items()],
    )
    iso = F.when(text.rlike(_ISO), iso_text.try_cast("timestamp"))
    rfc = F.when(text.rlike(_RFC822), F.try_to_timestamp(rfc_text, F.lit("d MMM yyyy HH:mm:ss xx")))
    return F.coalesce(iso, rfc)


def to_iso(raw: Column) -> Column:
    """Any accepted date text to ISO UTC text; null, '' and unreadable text give null."""
    return iso_utc(parse_date(raw))
