from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedloom import schemas as sc
from feedloom.operators import duplicates as du
from feedloom.operators import listing as ls
from feedloom.operators import mutate as mu

OLD = datetime(2026, 1, 1)


def now():
    return F.lit("2026-07-16T06:15:00Z").cast("timestamp")


@pytest.fixture
def article(spark):
    inputs = spark.createDataFrame(
        [("s", ("My Title", "sum", "text", "https://a.b", None, None, None))],
        "source_id string, original " + sc.ORIGINAL.simpleString())
    return mu.article_rows(inputs, F.lit(OLD))


def test_new_article_defaults(article):
    r = article.first()
    assert r.id.startswith("art_") and len(r.id) == 36
    assert (r.slug, r.category_id, r.tags, r.language, r.status, r.published_at) == ("my-title", None, [], "en", "RAW", None)
    assert (r.original.image, r.original.author, r.author, r.cover_image) == ("", "", None, None)
    assert r.ai.asDict() == {f.name: [] if f.name == "keywords" else None for f in sc.AI}
    assert r.created_at == r.updated_at
    assert article.select(*sc.ARTICLE.names).schema.simpleString() == sc.ARTICLE.simpleString()


def test_new_source_defaults(spark):
    r = mu.source_rows(spark.createDataFrame([("n", "RSS", "https://f")], "name string, type string, url string"), now()).first()
    assert (r.status, r.priority, r.fetch_interval, r.language, r.description, r.fetch_strategy) == (
        "ACTIVE", 10, 60, "en", "", "AUTO")
    assert mu.source_rows(spark.createDataFrame([("n", "RSS", "https://f")], "name string, type string, url string"),
                          now()).schema.simpleString() == sc.SOURCE.simpleString()


def test_public_columns(spark, article):
    stored = article.withColumns({"PK": F.lit("x"), "EntityType": F.lit("ARTICLE")})
    assert mu.read_articles(stored).columns == list(sc.ARTICLE.names)
    source = spark.createDataFrame([("s", None, "x"), ("t", "RSS_ONLY", "x")], "source_id string, fetch_strategy string, SK string")
    assert sorted(mu.read_sources(source).collect()) == [("s", "AUTO"), ("t", "RSS_ONLY")]


def test_insert_if_absent_by_probing(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "id string, pos int")
    stored = spark.createDataFrame([("b",), ("c",)], "id string")
    for small in (True, False):
        assert mu.insert_if_absent(rows, stored, "id", "pos", small_batch=small).collect() == [("a", 1)]


def test_insert_if_absent_takes_the_first_of_the_batch(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 1, "x"), ("c", 1, "y")], "id string, pos int, v string")
    out = mu.insert_if_absent(rows, spark.createDataFrame([("c",)], "id string"), "id", "pos")
    assert sorted(out.select("id", "v").collect()) == [("a", "early"), ("b", "x")]


def test_patches_absent_null_and_order(spark):
    table = spark.createDataFrame(
        [("a", "s1", "cat", ["x"], OLD), ("b", "s2", "cat", ["y"], OLD)],
        "id string, slug string, category_id string, tags array<string>, updated_at timestamp")
    patches = spark.createDataFrame([
        (1, "a", ["slug", "category_id"], "one", None, None), (2, "a", ["slug"], "two", "ignored", ["ignored"]),
        (3, "zzz", ["slug"], "never", None, None)],
        "seq long, id string, fields array<string>, slug string, category_id string, tags array<string>")
    out = {r.id: r for r in mu.patch_articles(table, patches, now()).collect()}
    assert sorted(out) == ["a", "b"]
    assert (out["a"].slug, out["a"].category_id, out["a"].tags) == ("two", None, ["x"])
    assert out["a"].updated_at > OLD and out["b"].updated_at == OLD


def test_source_patch_writes_the_fetch_strategy(spark):
    table = spark.createDataFrame([("s", "AUTO")], "source_id string, fetch_strategy string")
    patch = spark.createDataFrame([(1, "s", ["fetch_strategy"], "RSS_ONLY")],
                                  "seq int, source_id string, fields array<string>, fetch_strategy string")
    assert mu.patch_sources(table, patch, now()).first().fetch_strategy == "RSS_ONLY"


def test_ai_patch_modes(spark, article):
    def patch(title, model, fields):
        row = tuple({"title": title, "model": model, "keywords": ["k"]}.get(n) for n in sc.AI.names)
        return spark.createDataFrame([(article.first().id, row, fields)], f"id string, ai {sc.AI.simpleString()}, ai_fields array<string>")

    first = mu.patch_ai(article, patch("T", "m1", ["title", "model", "keywords"]), now())
    merged = mu.patch_ai(first, patch(None, "m2", ["model"]), now(), mode="merge").first()
    assert (merged.ai.title, merged.ai.model, merged.ai.keywords) == ("T", "m2", ["k"])
    replaced = mu.patch_ai(first, patch(None, "m2", ["model"]), now(), mode="replace").first()
    assert (replaced.ai.title, replaced.ai.model, replaced.ai.keywords) == (None, "m2", [])
    nulled = mu.patch_ai(first, patch(None, None, ["title"]), now()).first()
    assert (nulled.ai.title, nulled.ai.model) == (None, "m1")
    steps = [patch("A", "m8", ["title", "model"]), patch("B", None, ["title"]), patch("C", "m9", ["model"])]
    log = steps[0].withColumn("seq", F.lit(1)).union(steps[1].withColumn("seq", F.lit(2))).union(steps[2].withColumn("seq", F.lit(3)))
    [both] = mu.patch_ai(first, log, now()).collect()
    assert (both.ai.title, both.ai.model, both.ai.keywords) == ("B", "m9", ["k"])
    [last] = mu.patch_ai(first, log, now(), mode="replace").collect()
    assert (last.ai.title, last.ai.model, last.ai.keywords) == (None, "m9", [])
    with pytest.raises(ValueError):
        mu.patch_ai(article, patch("T", "m", []), now(), mode="other")


def test_delete_and_missing(spark):
    table = spark.createDataFrame([("a",), ("b",)], "id string")
    batch = spark.createDataFrame([("a",), ("a",), ("x",)], "id string")
    assert mu.delete_rows(table, batch, "id").collect() == [("b",)]
    assert mu.missing_keys(batch, table, "id").collect() == [("x",)]


def test_toggle(spark):
    table = spark.createDataFrame([("a", "ACTIVE"), ("b", "INACTIVE"), ("c", "BROKEN"), ("d", "ACTIVE"), ("e", "BROKEN")],
                                  "source_id string, status string")
    batch = spark.createDataFrame([(x,) for x in "abcddee"], "source_id string")
    out = dict(mu.toggle_sources(table, batch, now()).collect())
    assert out == {"a": "INACTIVE", "b": "ACTIVE", "c": "ACTIVE", "d": "ACTIVE", "e": "INACTIVE"}


@pytest.fixture
def listing(spark):
    rows = [("1", "b", "s1", "c1", ["t"], "RAW", None, datetime(2026, 1, 3)),
            ("2", "B", "s1", None, ["u"], "RAW", datetime(2026, 2, 1), datetime(2026, 1, 2)),
            ("3", "a-b", "s2", "c1", ["t", "u"], "DONE", datetime(2026, 2, 2), datetime(2026, 1, 1)),
            ("4", "a", "s2", "c1", [], "RAW", None, datetime(2026, 1, 4))]
    return spark.createDataFrame(rows, "id string, slug string, source_id string, category_id string, tags array<string>, "
                                       "status string, published_at timestamp, created_at timestamp")


def ids(df):
    return "".join(r.id for r in df.collect())


def test_orders(listing):
    def run(field, direction):
        return ids(ls.list_articles(listing, order_field=field, direction=direction))

    assert run("createdAt", "DESC") == "4123"
    assert run("createdAt", "ASC") == "3214"
    assert run("publishedAt", "ASC") == "1423"
    assert run("publishedAt", "DESC") == "3214"
    assert run("title", "ASC") == "4312"
    assert run("title", "DESC") == "2134"


def test_filters_pages_and_compat(spark, listing):
    assert ids(ls.list_articles(listing, status="RAW", category_id="c1")) == "41"
    assert ids(ls.list_articles(listing, tag="t")) == "13"
    assert ids(ls.list_articles(listing, status="NOPE")) == ""
    assert ids(ls.list_articles(listing, limit=2, offset=1)) == "12"
    assert ids(ls.list_articles(listing, limit=0, offset=3)) == "3"
    assert ids(ls.list_articles(listing, status="RAW", category_id="c1", compat=True)) == "214"
    assert ids(ls.list_articles(listing, source_id="s1", tag="t", compat=True)) == "21"
    assert ids(ls.find_by_status(listing, "RAW", limit=1, offset=1)) == "1"
    assert ids(ls.find_by_source(listing, "s2")) == "34"
    assert ls.count_articles(listing, status="RAW", category_id="c1", compat=True).first().total == 3
    assert ls.count_articles(listing, category_id="c1").first().total == 3
    assert ls.count_articles(listing, category_id="c1", compat=True).first().total == 4
    page = ls.article_page(listing, status="RAW", limit=1).collect()
    assert [(r.id, r.total, r.limit, r.offset) for r in page] == [("4", 3, 1, 0)]
    assert dict(ls.count_by(listing, "status").collect()) == {"RAW": 3, "DONE": 1}
    many = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.col("id").alias("n"))
    deep = ls.deep_page(many.repartition(7), [F.desc("n")], 30, 4000).collect()
    assert [r.n for r in deep] == list(range(999, 969, -1))
    assert ls.page(many, [F.col("n")], 10, 10**9).collect() == [] and ls.deep_page(many, [F.col("n")], 10, 4995).count() == 5
    answer = ls.article_answer(listing, status="RAW", limit=2, order_field="title", direction="ASC").first()
    rows = ls.list_articles(listing, status="RAW", limit=2, order_field="title", direction="ASC")
    assert (answer.total, [r.id for r in answer["items"]]) == (3, list(ids(rows)))
    past = ls.article_answer(listing, status="RAW", limit=2, offset=9).first()
    assert (past.total, past.limit, past.offset, past["items"]) == (3, 2, 9, [])
    assert ls.article_answer(listing, status="NOPE").first().total == 0


def test_lookups(spark, listing):
    wanted = spark.createDataFrame([("1",), ("1",), ("9",)], "id string")
    assert sorted((r.id, r.found, r.slug) for r in ls.find_ids(listing, wanted).collect()) == [("1", True, "b"), ("9", False, None)]
    twins = listing.withColumn("slug", F.lit("same"))
    assert ids(ls.find_by_slug(twins, "same")) == "3" and ids(ls.find_by_slug(twins, "none")) == ""
    assert ids(ls.first_per_slug(twins)) == "3"


def test_duplicates_with_large_groups(spark, monkeypatch):
    rows = [(i, f" Same\n text {'' if i % 3 else i}") for i in range(60)]
    articles = spark.createDataFrame(rows, "id long, content string")
    plain = {r.id: (r.original_id, r.copies) for r in du.mark_duplicates(articles, du.text_key(F.col("content")), "id").collect()}
    monkeypatch.setattr(du, "HOT_KEY_ROWS", 10)
    hot = {r.id: (r.original_id, r.copies) for r in du.mark_duplicates(articles, du.text_key(F.col("content")), "id").collect()}
    assert plain == hot == {i: (1, 40) if i % 3 else (i, 1) for i in range(60)}


def test_tags_and_categories(spark, listing):
    tags = spark.createDataFrame([("t", "T", 99), ("x", "X", 5)], "slug string, name string, article_count long")
    assert sorted((r.slug, r.article_count) for r in du.tag_dimension(tags, listing).collect()) == [("t", 2), ("x", 0)]
    categories = spark.createDataFrame([("c1", "One", "one", True), ("c2", "Two", "two", True), ("c3", "Three", "three", False)],
                                       "id string, name string, slug string, is_active boolean")
    assert sorted((r.id, r.n_articles) for r in du.category_counts(categories, listing).collect()) == [("c1", 3), ("c2", 0)]
    named = {r.id: r.category_name for r in du.article_categories(listing, categories).collect()}
    assert named == {"1": "One", "2": None, "3": "One", "4": "One"}
    assert du.category_by_slug(categories, "two").first().id == "c2"
