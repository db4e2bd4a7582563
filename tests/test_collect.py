import itertools

import pytest
from pyspark.sql import functions as F

from feedloom.operators import collect as co
from feedloom.operators import mutate as mu
from feedloom.operators import joins
from feedloom.operators import validate as va
from feedloom.plans.collection import collect_feeds, settle

ITEM = ("item_id long, source_id string, pos long, title string, summary string, content string, url string, "
        "published_at string, author string, image string")
SOURCE = "source_id string, name string, type string, status string, language string, fetch_strategy string"
NOW = "2026-07-16T06:15:00Z"


def item(i, source="s", title="t", summary="sum", content="c", url=None, date=None, author="", image=""):
    return (i, source, i, title, summary, content, url or f"https://p/{i}", date, author, image)


@pytest.fixture
def sources(spark):
    return spark.createDataFrame([
        ("s", "Source", "RSS", "ACTIVE", "en", "AUTO"), ("only", "Only", "RSS", "ACTIVE", "en", "RSS_ONLY"),
        ("html", "Html", "RSS", "ACTIVE", "vi", "RSS_PLUS_HTML_FETCH"), ("none", "None", "RSS", "ACTIVE", "en", None),
        ("api", "Api", "API", "ACTIVE", "en", "AUTO"), ("off", "Off", "RSS", "INACTIVE", "en", "AUTO"),
    ], SOURCE)


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def test_strategy_threshold_and_reason(spark, sources):
    rows = [item(1, content="x" * 999), item(2, content="x" * 1000), item(3, content="\U0001f600" * 500),
            item(4, "only"), item(5, "html", content="x" * 5000), item(6, "none"), item(7, "api"), item(8, "off")]
    planned = co.plan_fetch(co.join_sources(spark.createDataFrame(rows, ITEM), sources))
    out = {r.item_id: (r.strategy, r.rss_length) for r in planned.collect()}
    assert out == {
        1: ("RSS_PLUS_HTML_FETCH", 999), 2: ("RSS_ONLY", 1000), 3: ("RSS_ONLY", 1000), 4: ("RSS_ONLY", 1),
        5: ("RSS_PLUS_HTML_FETCH", 5000), 6: ("RSS_PLUS_HTML_FETCH", 1)}
    reasons = [r[0] for r in planned.filter("item_id < 3").orderBy("item_id").select(co.content_reason(F.col("content"))).collect()]
    assert reasons == ["Content length 999 < 1000 characters (truncated/excerpt only)",
                       "Content length 1000 >= 1000 characters"]


def merge(row, page):
    """Plain Python statement of the merge rules, for one item and an optional page."""
    page = page or {}
    filled = {k: bool(page.get(k)) for k in ("html", "author", "hero_image", "title")}
    return {
        "title": page["title"] if filled["title"] else row["title"],
        "summary": row["summary"] or (page["excerpt"] if page.get("excerpt") is not None else row["summary"]),
        "content": page["html"] if filled["html"] else row["content"],
        "published_at": page["published_at"] if page.get("published_at") is not None else row["published_at"],
        "author": page["author"] if filled["author"] else (row["author"] or "Source"),
        "author_source": "FETCHER" if filled["author"] else ("RSS" if row["author"] else "SOURCE_DEFAULT"),
        "image": page["hero_image"] if filled["hero_image"] else row["image"],
        "image_source": "FETCHER" if filled["hero_image"] else ("RSS" if row["image"] else "NONE"),
        "content_source": "FETCHER" if filled["html"] else "RSS",
    }


def test_merge_of_every_null_empty_value_combination(spark):
    fields = ("title", "html", "excerpt", "author", "hero_image", "published_at")
    found = [dict(zip(fields, c)) for c in itertools.product(*[(None, "", f"p-{f}") for f in fields])] + [None]
    feeds = [dict(title="t", summary=s, content="c", published_at=d, author=a, image=m)
             for s, d, a, m in itertools.product(("", "s"), (None, "d"), ("", "a"), ("", "m"))]
    page_type = "struct<" + ",".join(f"{f}:string" for f in fields) + ">"
    cases = [(i, *[x[k] for k in ("title", "summary", "content", "published_at", "author", "image")], p)
             for i, (x, p) in enumerate(itertools.product(feeds, found))]
    df = spark.createDataFrame(cases, "i int, title string, summary string, content string, published_at string, "
                                      f"author string, image string, page {page_type}")
    rules = co.merge_records({c: F.col(c) for c in df.columns}, F.col("page"), F.lit("Source"))
    got = df.select("i", *[c.alias(f"m_{n}") for n, c in rules.items()]).orderBy("i").collect()
    for row, (x, p) in zip(got, itertools.product(feeds, found), strict=True):
        assert {k[2:]: v for k, v in row.asDict().items() if k != "i"} == merge(x, p)


def test_failed_fetch_falls_back_and_pages_do_not_multiply_items(spark, sources):
    rows = [item(1, url="https://p/x"), item(2, url="https://p/x"), item(3), item(4, url="not a url"),
            item(5, "only", url="https://p/x")]
    crawl = pages(spark, [("https://p/x", "<article>old</article>"), ("https://p/x", "<article>new</article>"),
                          ("https://p/3", "<div>unreadable</div>"), ("not a url", "<article>never</article>")])
    merged = co.merge_articles(spark.createDataFrame(rows, ITEM), sources, crawl).orderBy("item_id").collect()
    assert [(r.item_id, r.original.content, r.fetched_length, r.needs_page) for r in merged] == [
        (1, "new", 3, True), (2, "new", 3, True), (3, "c", 0, True), (4, "c", 0, True), (5, "c", 0, False)]
    assert merged[0].language == "en" and merged[0].tags == []


def test_only_wanted_pages_reach_the_extractor(spark, sources):
    rows = [item(1, url="https://p/1"), item(2, "only", url="https://p/2"), item(3, url="nope")]
    items = spark.createDataFrame(rows, ITEM)
    planned = co.plan_fetch(co.join_sources(items, sources))
    crawl = pages(spark, [(f"https://p/{i}", "<body>") for i in range(5)])
    assert [r.url for r in co.wanted_pages(planned, crawl).collect()] == ["https://p/1"]


def test_plugged_in_analyzer_and_merger(spark, sources):
    def merger(row, page, name):
        return co.merge_records(row, page, name) | {"title": F.upper(row["title"])}

    out = co.merge_articles(spark.createDataFrame([item(1)], ITEM), sources, pages(spark, [("u", "<body>")]),
                            analyzer=lambda content: F.length(content) > 0, merger=merger).first()
    assert (out.strategy, out.original.title) == ("RSS_ONLY", "T")


def test_lookup_join_with_hot_keys_equals_a_plain_left_join(spark):
    left = spark.createDataFrame(
        [(i, "hot" if i % 3 == 0 else ("gone" if i % 7 == 0 else (None if i % 11 == 0 else f"k{i % 20}"))) for i in range(500)],
        "id long, key string")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 20, 2)], "key string, v long")
    plain = left.join(right, "key", "left").select("id", "key", "v")
    for min_rows in (1, 40, 100, 10_000):
        hot = joins.hot_keys(left, "key", min_rows=min_rows, max_keys=3)
        joined = joins.lookup_join(left, right, "key", F.col("id"), hot)
        assert joined.count() == 500
        assert not joined.select("id", "key", "hit.v").exceptAll(plain).count()
    assert [r.key for r in joins.hot_keys(left, "key", min_rows=100).collect()] == ["hot"]


def test_dimension_join_beyond_the_broadcast_size(spark, monkeypatch):
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z")], "item_id long, key string")
    dim = spark.createDataFrame([("a", "A"), ("b", "B")], "key string, name string")
    small = joins.dimension_join(facts, dim, "key", F.col("item_id"))
    monkeypatch.setattr(joins, "fits_broadcast", lambda df: False)
    large = joins.dimension_join(facts, dim, "key", F.col("item_id"))
    expected = [("a", 1, "A"), ("b", 2, "B")]
    for out in (small, large):
        assert sorted(out.select("key", "item_id", "name").collect()) == expected


def test_collection_run_accounts_for_everything(spark, sources):
    head = '<rss xmlns:content="c"><channel>'
    entry = "<item><title>{0}</title><link>https://p/{0}</link><description>{1}</description></item>"
    feeds = spark.createDataFrame([
        ("s", 0, head + entry.format("a", "x") + entry.format("b", "") + entry.format("a", "x") + "</channel></rss>"),
        ("only", 0, head + entry.format("c", "y")), ("api", 0, "junk"), ("off", 0, "junk"),
        ("none", 0, head + entry.format("d", "z") + "</channel></rss>"),
    ], "source_id string, feed_no long, feed_xml string")
    stored = mu.article_rows(
        spark.createDataFrame([("none", ("d", "", "", "https://p/d", None, "", ""))],
                              "source_id string, original struct<title:string,summary:string,content:string,url:string,"
                              "published_at:string,image:string,author:string>"), F.lit(NOW).cast("timestamp"))
    run = collect_feeds(feeds, sources, pages(spark, [("https://p/b", "<article>hello</article>")]), stored,
                        F.lit(NOW).cast("timestamp"))
    # Item b has no summary in the feed, but its page gives an excerpt.
    assert sorted(r.slug for r in run.created.collect()) == ["a", "b"]
    assert [r.message for r in run.errors.collect()] == ["Source only (Only): Feed could not be parsed"]
    assert run.summary.first().asDict() == {
        "collected_sources": 4, "articles_created": 2, "failed_sources": 1, "error_count": 1}
    assert run.messages.count() == 2
    assert run.log.filter("html_fetch = 'YES'").count() == 4


def test_rejected_items_keep_the_rest_of_their_source(spark, sources):
    rows = [item(1), item(2, title="", date="yesterday"), item(3, url="nope")]
    merged = co.merge_articles(spark.createDataFrame(rows, ITEM), sources, pages(spark, [("u", "<body>")]))
    run = settle(merged, sources, spark.createDataFrame([], "id string"), F.lit(NOW).cast("timestamp"))
    assert run.created.count() == 1
    details = {r.item_id: r.details for r in run.rejected.collect()}
    assert details == {
        2: {"original.title": ["Original title is required"], "original.publishedAt": ["Invalid datetime"]},
        3: {"original.url": ["Original URL must be valid"]}}
    assert sorted(r.message for r in run.errors.collect()) == ['Item "": Validation failed', 'Item "t": Validation failed']
    assert run.rejected.select("error_code", "status_code").distinct().collect() == [("VALIDATION_ERROR", 400)]
    assert va.issue_rows(run.rejected, "item_id").count() == 3
