"""String helpers as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.schemas import EXCERPT_CHARS, WORDS_PER_MINUTE

# The whitespace set of ECMAScript and the five XML entities plus nbsp.
WS_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set as a pattern; nesting the rare ranges lets common letters fail at once.
WS_CLASS = r"\s\u00a0[\u1680-\uffff&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]"
WS = f"[{WS_CLASS}]"
# HTML's names of the characters that feeds use most.
NAMED = (
    ("&rsquo;", "\u2019"), ("&lsquo;", "\u2018"), ("&rdquo;", "\u201d"), ("&ldquo;", "\u201c"), ("&ndash;", "\u2013"),
    ("&mdash;", "\u2014"), ("&hellip;", "\u2026"), ("&bull;", "\u2022"), ("&middot;", "\u00b7"), ("&copy;", "\u00a9"),
    ("&reg;", "\u00ae"), ("&trade;", "\u2122"), ("&euro;", "\u20ac"), ("&pound;", "\u00a3"), ("&deg;", "\u00b0"),
    ("&laquo;", "\u00ab"), ("&raquo;", "\u00bb"), ("&eacute;", "\u00e9"), ("&egrave;", "\u00e8"), ("&ecirc;", "\u00ea"),
    ("&agrave;", "\u00e0"), ("&acirc;", "\u00e2"), ("&ccedil;", "\u00e7"), ("&ocirc;", "\u00f4"), ("&ntilde;", "\u00f1"),
    ("&auml;", "\u00e4"), ("&ouml;", "\u00f6"), ("&uuml;", "\u00fc"), ("&szlig;", "\u00df"), ("&aacute;", "\u00e1"),
    ("&iacute;", "\u00ed"), ("&oacute;", "\u00f3"), ("&uacute;", "\u00fa"),
)
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", "\u00a0"), ("&amp;", "&"),
)


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units, so that an emoji counts twice."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def ws_trim(c: Column) -> Column:
    """Trim the wide whitespace set; Spark's plain trim only knows U+0020."""
    return F.btrim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def _replace_closed(c: Column, pattern: str, end: str, by: str = " ") -> Column:
    """Replace up to the last ``end``. No match can begin after it, and leaving
    that part out keeps text with many unclosed openings from taking quadratic time."""
    rest = F.substring_index(c, end, -1)
    closed = F.left(c, F.length(c) - F.length(rest))
    return F.concat(F.regexp_replace(closed, pattern, by), rest)


def strip_html(c: Column) -> Column:
    """Tags, then entities, then whitespace runs become one space each; trimmed.

    The entity pattern takes everything from a bare ``&`` to the next ``;``.
    """
    no_tags = _replace_closed(c, "<[^>]*>", ">")
    return collapse_ws(_replace_closed(no_tags, "&[^;]+;", ";"))


def word_count(c: Column) -> Column:
    return collapsed_word_count(collapse_ws(c))


def collapsed_word_count(c: Column) -> Column:
    """Words of text whose whitespace is collapsed already."""
    spaces = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return ((spaces + 1) * (c != "").cast("int")).cast("long")


def reading_minutes(words: Column) -> Column:
    minutes = F.ceil(words / F.lit(WORDS_PER_MINUTE)).cast("long")
    return F.when(words <= 0, F.lit(0).cast("long")).otherwise(minutes)


def excerpt(c: Column, chars: int = EXCERPT_CHARS) -> Column:
    """First ``chars`` UTF-16 units of the collapsed text, trimmed."""
    return collapsed_excerpt(collapse_ws(c), chars)


def collapsed_excerpt(c: Column, chars: int = EXCERPT_CHARS) -> Column:
    """``excerpt`` of text whose whitespace is collapsed already.

    A surrogate pair that the cut would split is left out as a whole.
    """
    head = F.substring(c, 1, chars)
    units = F.encode(head, "UTF-16BE")
    last = F.hex(F.substring(units, 2 * chars - 1, 1))
    keep = F.when(last.between("D8", "DB"), 2 * chars - 2).otherwise(2 * chars)
    cut = F.decode(units.substr(F.lit(1), keep), "UTF-16BE")
    return F.trim(F.when(utf16_length(head) <= chars, head).otherwise(cut))


def _code_point(entity: Column) -> Column:
    """The character of ``&#8217;`` or ``&#x2019;``; what names no character stays as it is."""
    hexed = F.regexp_extract(entity, r"^&#[xX]([0-9a-fA-F]{1,6});$", 1)
    plain = F.regexp_extract(entity, r"^&#([0-9]{1,7});$", 1)
    code = F.when(hexed != "", F.conv(hexed, 16, 10)).when(plain != "", plain).cast("int")
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(entity)


def _decode_numbers(c: Column) -> Column:
    """Numeric entities: the text is cut at them, and each is put back as its character."""
    entity = r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"
    found = F.transform(F.regexp_extract_all(c, F.lit(entity), F.lit(0)), _code_point)
    joined = F.zip_with(F.split(c, entity, -1), found, lambda piece, char: F.concat(piece, F.coalesce(char, F.lit(""))))
    return F.when(c.contains("&#"), F.array_join(joined, "")).otherwise(c)


def decode_entities(c: Column) -> Column:
    """Named and numeric entities in any text; ``&amp;`` last, so that nothing is decoded twice."""
    c = _decode_numbers(c)
    for entity, char in (*NAMED, *ENTITIES):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def snippet(c: Column) -> Column:
    """Plain-text form of a feed body: tags removed, entities decoded, trimmed."""
    return ws_trim(decode_entities(_replace_closed(c, "<[^>]*>", ">", "")))


def slugify(c: Column) -> Column:
    """Lower case, ASCII word characters only, hyphen separated; edge hyphens stay."""
    kept = F.regexp_replace(F.lower(c), rf"[^A-Za-z0-9_\-{WS_CLASS}]", "")
    return F.regexp_replace(F.regexp_replace(kept, rf"[_{WS_CLASS}]+", "-"), "-+", "-")


def blank_to_null(c: Column) -> Column:
    """'' counts as missing; use only where the rule is "not empty", never for null-only rules."""
    return F.nullif(c, F.lit(""))


def is_filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))
