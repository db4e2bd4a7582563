"""Quality rules as a short-circuit cascade.

Each rule rejects a text. All of them are tried on a sample first: the time that a rule
takes there, and the share it rejects, give its rejections per second, and the rules are
then asked in that order. A later rule is not evaluated for a text that an earlier one
rejects. The order changes what the work costs, never the verdict. Everything is built-in
functions, evaluated in the scan without a shuffle.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import WINDOW, let, staged, window_hashes, words

#: Rows at most on which cost and selectivity are estimated, and the share they are drawn from.
SAMPLE_ROWS = 1000
SAMPLE_SHARE = 0.02
SYMBOLS = "[#*$%&|<>]"
BULLETS = r"^\s*[-*•‣▪●]"


class Rule(NamedTuple):
    """Rejects a text where ``rejects``, over the columns of ``measured``, is true."""

    name: str
    rejects: Column


def rules() -> list[Rule]:
    n, lines = F.col("n_words"), F.size("_lines")
    digits = F.size(F.split("_text", "[0-9]", -1)) - 1
    bullets = F.size(F.filter("_lines", lambda x: x.rlike(BULLETS)))
    cut = F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$")))
    return [
        Rule("short_words", F.col("word_chars") < 2 * n),
        Rule("long_words", F.col("word_chars") > 15 * n),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * lines),
        Rule("digits", 10 * digits > 3 * F.col("word_chars")),
        Rule("bullets", 10 * bullets > 9 * lines),
        Rule("ellipses", 10 * cut > 3 * lines),
    ]


def repeated_words(grams: Column, window: int = WINDOW) -> Column:
    """Words in windows found twice or more, first ones included; ``grams``: the windows' hashes.

    Where no hash is repeated, which is the common case, that alone is found out; else the
    windows are sorted by hash and place, and the places of repeated ones are summed up, so a
    very long text takes n log n time.
    """
    def repeats(s: Column) -> Column:
        marked = F.transform(s, lambda x, k: F.when(
            (x["h"] == F.get(s, k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(s, F.greatest(k - 1, F.lit(0)))["h"])), x["i"],
        ))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def width(at: Column) -> Column:
        gaps = F.transform(at, lambda x, k: F.least(F.coalesce(F.get(at, k + 1) - x, F.lit(window)), F.lit(window)))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    covered = let(ordered, lambda s: let(repeats(s), width))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), covered).otherwise(0)


def measured(docs: DataFrame, carry: str = "doc_id") -> DataFrame:
    """``carry``, the base figures, and ``_text``, ``_words`` and ``_lines`` of each row.

    Arrays that are used more than once are columns of their own, so that they are built once.
    """
    held = docs.select(carry, F.coalesce("text", F.lit("")).alias("_text"))
    held = held.withColumns({"_words": words(F.col("_text")), "_lines": F.split("_text", "\n")})
    filled = F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    held = held.withColumns({"_grams": window_hashes(F.col("_words")), "_filled": filled})
    figures = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.size(F.split("_text", SYMBOLS, -1)) - 1,
        "n_dup_lines": F.size("_filled") - F.size(F.array_distinct("_filled")),
        "n_repeat_words": repeated_words(F.col("_grams")),
    }
    figured = held.withColumns({name: c.cast("long") for name, c in figures.items()}).drop("_grams", "_filled")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return figured.withColumn("base_failed", failed)


def ordered_rules(docs: DataFrame, given: Sequence[Rule], sample_rows: int = SAMPLE_ROWS, share: float = SAMPLE_SHARE) -> list[Rule]:
    """``given``, by rejections per second on a sample of at most ``sample_rows`` rows."""
    sample = staged(measured(docs.select("doc_id", "text").sample(share, seed=7).limit(sample_rows)), "quality-sample")
    row = sample.agg(*[F.avg(F.coalesce(r.rejects, F.lit(False)).cast("double")).alias(r.name) for r in given]).first()
    worth = {}
    for rule in given:
        began = time.perf_counter()
        sample.agg(F.count_if(rule.rejects)).first()
        worth[rule.name] = (row[rule.name] or 0.0) / (time.perf_counter() - began)
    return sorted(given, key=lambda r: (-worth[r.name], r.name))


def judge(docs: DataFrame, given: Sequence[Rule] | None = None) -> DataFrame:
    """Figures and verdict of every row of ``docs`` (doc_id, text).

    A null text has no words; it and an empty one fail the base rules. Every row is judged by
    itself, so repeated rows and null ids keep their rows. Other columns are left out. A text
    that fails the base rules is not kept and not asked further rules.
    """
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return measured(docs).select("doc_id", *figures, cascade(docs, given).alias("kept"))


def cascade(docs: DataFrame, given: Sequence[Rule] | None) -> Column:
    """The verdict over the columns of ``measured``, its rules ordered on a sample of ``docs``."""
    verdict = F.when(F.col("base_failed"), False)
    for rule in ordered_rules(docs, rules() if given is None else given):
        verdict = verdict.when(rule.rejects, False)
    return verdict.otherwise(True)


def accepted(docs: DataFrame, given: Sequence[Rule] | None = None) -> DataFrame:
    """``docs``, all columns, without the rows that ``judge`` doesn't keep."""
    whole = docs.select(F.struct("*").alias("_row"), "text")
    rows = measured(whole, "_row").select("_row", cascade(docs, given).alias("_kept"), F.monotonically_increasing_id().alias("_place"))
    # A filter is not pushed below a column that depends on a row's place; pushed down, this one
    # would evaluate all figures once more for each time that a rule uses them.
    return rows.filter(F.col("_kept") & (F.col("_place") >= 0)).select("_row.*")
