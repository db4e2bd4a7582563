"""Very long texts that meet the repeated parts of the patterns."""

import re
import time

import pytest
from pyspark.sql import functions as F

from feedloom.llm import line_dedup, packing, surrogates


@pytest.mark.parametrize("unit,begin,types", [("Ab-", "Mr ", "name"), ("a.", "x@", "email"), ("1.", "", ""), ("12-", "+1 ", ""), ("Ab'", "Frau ", "name")])
def test_patterns_survive_a_million_repeats(spark, unit, begin, types):
    rows = spark.range(1).select(F.concat(F.lit(begin), F.repeat(F.lit(unit), 1_000_000), F.lit("Cd")).alias("text"))
    found = rows.select(F.regexp_extract_all("text", F.lit(surrogates.ANY), F.lit(0)).alias("m")).select(F.transform("m", F.length).alias("m")).first().m
    if types:
        assert found == [len(begin) + len(unit) * 1_000_000 + 2]
    else:
        assert all(size < 40 for size in found)


def test_long_entities_are_replaced(spark):
    name, mail = "Mr " + "Ab-" * 5_000 + "Cd", "x@" + "a." * 5_000 + "io"
    rows = spark.createDataFrame([(1, f"{name} wrote to {mail}.")], "doc_id bigint, text string")
    out = surrogates.replace_private(rows, "key").first()
    assert out.n_entities == 2 and out.entity_types == "email,surname"
    assert "Ab-Ab" not in out.text and re.fullmatch(r"Mr \S+ wrote to \S+@[a-z.]+\.io\.", out.text)


def test_mailboxes_of_a_small_domain_never_run_out(spark):
    values = spark.createDataFrame([("email", f"_@{chr(97 + i)}.io") for i in range(16)] + [("email", f"{chr(97 + i)}@x.io") for i in range(26)],
                                   "type string, value string")
    rows = surrogates.assign(values, "key").collect()
    assert len(rows) == len({r.surrogate for r in rows}) == 42
    assert all(re.fullmatch(r"[a-z_]+@[a-z]\.io", r.surrogate) for r in rows)


def test_long_blanks_and_long_texts_take_linear_time(spark):
    blanks = spark.createDataFrame([(1, "a" + " " * 400_000 + "b\n" + " " * 400_000)], "doc_id bigint, text string")
    start = time.monotonic()
    assert line_dedup.sequences(blanks).count() == 1 and line_dedup.sequences(blanks).first().sizes == [2, 0]
    words = spark.createDataFrame([(1, "  " + "word next\n" * 200_000)], "doc_id bigint, text string")
    out = packing.pack(words, texts=True).orderBy("chunk").collect()
    assert time.monotonic() - start < 60
    assert "".join(r.text for r in out) == "word next\n" * 200_000
    assert [r.n_tokens for r in out] == [len(r.text.split()) for r in out]
