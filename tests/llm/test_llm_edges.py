"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from feedloom.llm import (
    decontaminate, html_main, line_dedup, near_dedup, packing, quality, secrets, sharding, surrogates, toxicity,
)
from feedloom.sources.store import run_dir

LINE = " ".join(f"Word{i} runs." for i in range(40))
ROWS = [
    (1, "alpha beta\n" + LINE, "en"), (2, "gamma\n" + LINE, "en"), (2, "gamma\n" + LINE, "en"), (2, "another text", None),
    (3, None, "fr"), (4, "", "de"), (5, "  \n\t ", "en"), (None, "alpha beta\n" + LINE, None), (None, None, None),
    (6, "x" * 30_000 + " y" * 3_000, "en"), (7, 'token = "abcdefgh12" mail a.b@c.org', "es"),
]
#: Names that operators use inside.
CLASHING = (
    "blob batch slot _row _part node label bucket hash kept score n_words start n shingles size text_hash _id _hash _doc_id "
    "_blocks _lines pos h w findings leader block"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    return rows.select("*", *[F.lit("other").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, " ".join(LINE.split()[:30])), (2, None), (3, ""), (None, LINE), (4, "too short")]
    return spark.createDataFrame(rows, "item_id bigint, text string").withColumn("n", F.lit(1)).withColumn("h", F.lit(1))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 0, 1), (4, 1, None), (9, 1, 7)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def operators(spark, items, labels):
    return {
        "secrets": lambda d: secrets.digest(secrets.scan_versions(d, run_dir(spark, "ledger"))),
        "lines": line_dedup.drop_repeated_lines,
        "benchmark": lambda d: decontaminate.contaminated(d, items),
        "clean": lambda d: decontaminate.clean(d, items),
        "private": lambda d: surrogates.replace_private(d, "key"),
        "packing": lambda d: packing.pack(d, texts=True),
        "near": near_dedup.groups,
        "representatives": near_dedup.representatives,
        "quality": quality.judge,
        "accepted": quality.accepted,
        "toxicity": lambda d: toxicity.classify(d, labels),
        "shards": lambda d: sharding.shard_records(d, {0: 1.0, 1: 2.0}),
    }


#: Rows that come back; None where it is not one for each row.
ONE_EACH = {"secrets", "lines", "private", "near", "quality", "toxicity", "shards"}
NAMES = ["secrets", "lines", "benchmark", "clean", "private", "packing", "near", "representatives", "quality", "accepted", "toxicity", "shards"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(operators, docs, name):
    rows = operators[name](docs).collect()
    if name in ONE_EACH:
        assert len(rows) == len(ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(operators, docs, name):
    out = operators[name](docs.limit(0))
    assert out.count() == 0


def test_defined_results(operators, docs):
    near = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in operators["near"](docs).collect())
    assert [r for r in near if r[0] == -1] == [(-1, 0, -1, False), (-1, 78, 1, False)]
    assert [r for r in near if r[0] == 2] == [(2, 1, 2, True), (2, 77, 1, False), (2, 77, 1, False)]
    assert [r for r in near if r[0] in (3, 4, 5)] == [(3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)]
    one = [(r.doc_id, r.text) for r in operators["representatives"](docs).collect()]
    assert len(one) == len(set(one)) and (2, "another text") in one and (2, "gamma\n" + LINE) not in one

    lines = {(r.doc_id, r.text) for r in operators["lines"](docs).collect()}
    assert {(2, "gamma"), (1, ROWS[0][1]), (None, ROWS[0][1]), (3, None)} <= lines

    hit = {(r.doc_id, r.item_id) for r in operators["benchmark"](docs).collect()}
    assert hit == {(1, 1), (2, 1), (None, 1)}
    assert sorted(r.doc_id or 0 for r in operators["clean"](docs).collect()) == [0, 2, 3, 4, 5, 6, 7]

    spans = {r.doc_id: r.spans for r in operators["secrets"](docs).collect()}
    assert spans[7] == "assign:0:19" and spans[3] == spans[4] == ""

    packed = operators["packing"](docs)
    assert packed.filter("doc_id in (3, 4, 5)").count() == 0
    assert packed.filter("doc_id = 6").agg(F.sum("n_tokens")).first()[0] == 3001
    assert packed.groupBy("bucket_tokens", "batch", "slot").count().filter("count > 1").count() == 0


def test_odd_pages(spark):
    rows = [
        (1, "http://a.org/x", "<article><p>One  &amp; two<p>Three</article>"), (1, "http://a.org/x", None), (None, None, "<p>free"),
        (2, "b", ""), (3, "http://A.org", "<" * 2000), (4, "http://a.org", "<div>" * 3000 + "deep"), (4, "http://a.org", "<!-- open"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1)).withColumn("template", F.lit(2))
    out = sorted((r.page_id or 0, r.text) for r in html_main.extract(pages).collect())
    assert out == [(0, "free"), (1, ""), (1, "One & two\nThree"), (2, ""), (3, "<" * 2000), (4, ""), (4, "deep")]
    assert html_main.extract(pages.limit(0)).count() == 0
