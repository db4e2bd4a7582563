"""Text functions against a plain Python statement of the rules, over random strings."""

import math
import random
import re

import pytest

from feedloom.functions import text as tx

SPACES = tx.WS_CHARS
SPACE = "[" + "".join(f"\\u{ord(c):04x}" for c in SPACES) + "]"
ALPHABET = list("abZ09_-.&;<>/ ") + [
    "\n", "\t", "\u00a0", "\u3000", "\ufeff", "\u0085", "\u200b", "\u00e9", "\u4e00", "\U0001f600",
]


def units(s):
    return len(s.encode("utf-16-be")) // 2


def trim(s):
    return s.strip(SPACES)


def collapse(s):
    return trim(re.sub(f"{SPACE}+", " ", s))


def strip_html(s):
    return collapse(re.sub("&[^;]+;", " ", re.sub("<[^>]*>", " ", s)))


def words(s):
    return len(re.split(f"{SPACE}+", trim(s))) if trim(s) else 0


def excerpt(s):
    raw = collapse(s).encode("utf-16-be")[: 2 * 20]
    return trim(raw.decode("utf-16-be", errors="ignore"))


def slug(s):
    kept = re.sub(f"[^A-Za-z0-9_{SPACE[1:-1]}-]", "", s.lower())
    return re.sub("-+", "-", re.sub(f"[_{SPACE[1:-1]}]+", "-", kept))


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(7)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(60))) for _ in range(2000)]


@pytest.mark.parametrize("column, plain", [
    (tx.utf16_length, units), (tx.ws_trim, trim), (tx.collapse_ws, collapse), (tx.strip_html, strip_html),
    (tx.word_count, words), (lambda c: tx.excerpt(c, 20), excerpt), (tx.slugify, slug),
], ids=["utf16_length", "trim", "collapse", "strip_html", "words", "excerpt", "slug"])
def test_equals_plain_rule(values, strings, column, plain):
    assert values(column, strings) == [plain(s) for s in strings]


def test_reading_minutes_rounds_up(values):
    counts = list(range(-3, 1000, 7))
    assert values(tx.reading_minutes, counts, "long") == [max(0, math.ceil(n / 200)) for n in counts]
