import pytest
from pyspark.sql import functions as F

from feedloom.operators import reports as rp


def test_quality_uses_the_first_three_in_feed_order(spark):
    rows = [("s", p, p, "x" * n) for p, n in [(3, 9000), (0, 1000), (1, 1000), (2, 1001)]] + [("t", 0, 9, "x" * 1000)]
    out = {r.source_id: r for r in rp.source_quality(spark.createDataFrame(rows, "source_id string, pos long, item_id long, content string")).collect()}
    assert (out["s"].rounded_length, out["s"].contains_full_content, out["s"].strategy) == (1000, True, "RSS_ONLY")
    assert (out["t"].avg_length, out["t"].contains_full_content) == (1000.0, False)


def test_coverage_any_item_but_categories_of_the_first(spark):
    rows = [("s", 0, 0, "", "", "c", "", "", None, []), ("s", 1, 1, "t", "", "c", "", "", "d", ["x"])]
    items = spark.createDataFrame(rows, "source_id string, pos long, item_id long, title string, summary string, content string, "
                                        "author string, image string, published_at string, categories array<string>")
    coverage = rp.field_coverage(items)
    flags = {r.field: r.available for r in rp.flag_rows(coverage, ["title", "summary", "published_at", "categories"]).collect()}
    assert flags == {"title": True, "summary": False, "published_at": True, "categories": False}
    wide = rp.side_by_side(rp.coverage_metrics(coverage, rp.source_quality(items)), "source_id")
    assert dict(wide.collect())["item_count"] == "2" and wide.count() == 9


def test_too_many_columns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(rp, "MAX_REPORT_COLUMNS", 1)
    long = spark.createDataFrame([("a", "m", "1"), ("b", "m", "2")], "source_id string, metric string, value string")
    with pytest.raises(ValueError):
        rp.side_by_side(long, "source_id")
    with pytest.raises(ValueError):
        rp.report_columns(long.filter("source_id = 'a'").select("source_id"), at_least=2)


def test_collection_report_without_items(spark):
    merged = spark.createDataFrame([], "source_id string, pos long, item_id long, strategy string, needs_page boolean, rss_length long, "
                                       "fetched_length long, author string, author_source string, cover_image string, image_source string, "
                                       "original struct<content:string,summary:string>")
    expected = spark.createDataFrame([("s", "RSS_ONLY", False)], "source_id string, expected_strategy string, expected_fetch boolean")
    report = rp.collection_report(merged, expected)
    row = report.first()
    assert (row.strategy, row.author_source, row.rss_length, row.strategy_match, row.fetch_match) == ("N/A", "N/A", 0, False, False)
    assert rp.all_match(report).first() == (False, False)
    assert rp.all_match(report.filter("false")).first() == (True, True)
    metrics = dict(rp.collection_metrics(report).select("metric", "value").collect())
    assert metrics["author"] == "(empty)" and metrics["hero_image"] == "NO"


def test_improvement_texts(spark):
    report = spark.createDataFrame([("a", True, 150, True, True), ("b", True, 10, False, False), ("c", False, 0, False, False),
                                    ("d", True, 5, False, False), ("e", True, 199, False, False), ("f", True, 205, False, False)],
                                   "k string, success boolean, text_length long, has_image boolean, has_author boolean")
    lengths = spark.createDataFrame([("a", 100), ("b", 0), ("c", 7), ("e", 200), ("f", 200)], "k string, rss_length long")
    out = {r.k: r.improvement for r in rp.improvement(report, lengths, "k").collect()}
    assert out == {"a": "50%", "b": "N/A%", "c": "FAILED", "d": "N/A%", "e": "-1%", "f": "3%"}


def test_fetch_report_and_counts(spark):
    fetched = spark.createDataFrame([("u", "<p>ab</p>", "ab", "img", "", None, 1, 1)],
                                    "url string, html string, text string, hero_image string, author string, published_at string, "
                                    "word_count long, reading_time_minutes long")
    report = rp.fetch_report(spark.createDataFrame([(1, "u"), (2, "x")], "k long, url string"), rp.page_sizes(
        fetched.withColumns({"title": F.lit(""), "excerpt": F.lit("")})), "k")
    assert [tuple(r) for r in report.orderBy("k").collect()] == [
        (1, "u", True, 1, 1, 9, 2, True, False, False), (2, "x", False, 0, 0, 0, 0, False, False, False)]
    assert rp.fetch_counts(report).first() == (1, 1)
    assert rp.fetch_metrics(report, "k").filter("metric = 'reading_time' and k = 1").first().value == "1 min"


def test_fallback_choice(spark):
    primary = spark.createDataFrame([("ok", True, 2), ("empty", True, 0), ("broken", False, 0), ("alone", False, 0)],
                                    "source_id string, feed_ok boolean, item_count long")
    fallback = spark.createDataFrame([("ok", "z"), ("empty", "y"), ("broken", "x")], "source_id string, fallback_id string")
    out = {r.source_id: (r.chosen_id, r.used_fallback, r.error) for r in rp.resolve_fallback(primary, fallback).collect()}
    assert out == {"ok": ("ok", False, None), "empty": ("y", True, None), "broken": ("x", True, None),
                   "alone": (None, False, "Failed to fetch alone RSS")}


def test_first_item_and_group_limit_plan(spark):
    items = spark.createDataFrame([("s", 1, 5), ("s", 0, 9)], "source_id string, pos long, item_id long")
    assert rp.first_item(items).first().item_id == 9
    plan = rp.first_items(items)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and F is not None
