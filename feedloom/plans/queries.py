"""Registered queries: one callable ``(spark, folder) -> DataFrame`` per operator group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.functions import checks as ck
from feedloom.functions.dates import iso_utc
from feedloom.functions.jsontext import parse_json_or
from feedloom.operators import collect as co
from feedloom.operators import duplicates as du
from feedloom.operators import lifecycle as li
from feedloom.operators import listing as ls
from feedloom.operators import mutate as mu
from feedloom.operators import reports as rp
from feedloom.operators import validate as va
from feedloom.plans.collection import collect_feeds, settle
from feedloom.plans.corpus import Corpus
from feedloom.sources import feeds as fd
from feedloom.schemas import AI
from feedloom.sources.pages import extract_pages, latest_per_url
from feedloom.sources.store import run_dir
from feedloom.streaming import collection as sc
from feedloom.streaming import lifecycle as sl
from feedloom.streaming import publish as pb
from feedloom.streaming import queue as qs
from feedloom.streaming import refetch as rf

AS_OF = "2026-07-16T06:15:00Z"
DUE_AT = "2024-01-30T12:00:00Z"
#: Triggers of a stream of feed documents.
ARRIVALS = 3

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, folder: fn(Corpus(spark, folder))
    return fn


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def _joined(name: str, sep: str = ",") -> Column:
    return F.array_join(name, sep).alias(name)


# Feeds


def _parsed_items(c: Corpus) -> DataFrame:
    return fd.explode_items(fd.parse_feeds(c.feeds))


@query
def feed_items(c: Corpus) -> DataFrame:
    items = fd.normalise_items(_parsed_items(c), keep_raw=True)
    return items.select(
        "source_id", "feed_no", "pos", F.col("raw.guid").cast("long").alias("item_id"), "feed_title",
        "title", "summary", F.md5("content").alias("content_md5"), "url", "published_at", "author", "image",
    )


@query
def feed_fallback(c: Corpus) -> DataFrame:
    primary = fd.parse_feeds(c.arrived_feeds).groupBy("source_id").agg(
        F.bool_and("feed_ok").alias("feed_ok"),
        F.sum(F.coalesce(F.size("raw_items"), F.lit(0))).cast("long").alias("item_count"),
    )
    return rp.resolve_fallback(primary, c.fallback_map)


@query
def item_keys(c: Corpus) -> DataFrame:
    return rp.key_profile(_parsed_items(c))


@query
def item_extra_keys(c: Corpus) -> DataFrame:
    return rp.extra_keys(_parsed_items(c)).select("source_id", _joined("extra_keys"))


@query
def image_coverage(c: Corpus) -> DataFrame:
    return rp.image_coverage(_parsed_items(c))


@query
def first_item_categories(c: Corpus) -> DataFrame:
    lead = rp.first_item(c.items.select("source_id", "pos", "item_id", "title", "categories"))
    return lead.select(
        "source_id", "item_id", "title",
        F.coalesce(F.size("categories"), F.lit(0)).cast("long").alias("n_categories"),
        ls.first_elements(F.col("categories")).alias("first_categories"),
    )


# Collection


@query
def active_sources(c: Corpus) -> DataFrame:
    read = mu.read_sources(co.active_sources(c.sources))
    return read.withColumns({
        "collectable": F.col("type") == "RSS", "priority": F.col("priority").cast("long"),
        "fetch_interval": F.col("fetch_interval").cast("long"),
    })


@query
def sources_by_type(c: Corpus) -> DataFrame:
    return co.sources_of_type(c.sources, "API").select("source_id", "name", "status")


@query
def fetch_strategy(c: Corpus) -> DataFrame:
    planned = co.plan_fetch(co.join_sources(c.items, c.sources))
    return planned.select(
        "item_id", "source_id", "rss_length", "strategy",
        rp.yes_no(F.col("needs_page")).alias("html_fetch"), co.content_reason(F.col("content")).alias("reason"),
    )


@query
def page_extract(c: Corpus) -> DataFrame:
    return extract_pages(c.crawl).select(
        "page_id", "url", "title", F.md5("html").alias("html_md5"), F.md5("text").alias("text_md5"), "excerpt",
        "hero_image", "author", "published_at", "word_count", "reading_time_minutes",
    )


def _merged(c: Corpus) -> DataFrame:
    return co.merge_articles(c.items, c.sources, c.crawl)


@query
def merge_articles(c: Corpus) -> DataFrame:
    o = F.col("original")
    return _merged(c).select(
        "item_id", "source_id", o["title"].alias("title"), o["summary"].alias("summary"),
        F.md5(o["content"]).alias("content_md5"), o["url"].alias("url"), o["published_at"].alias("published_at"),
        "author", "cover_image", "language", "strategy", "rss_length", "fetched_length",
        "author_source", "image_source", "content_source",
    )


@query
def collect_log(c: Corpus) -> DataFrame:
    return co.collect_log(_merged(c))


@query
def rejected_items(c: Corpus) -> DataFrame:
    checked = va.with_errors(_merged(c), va.article_issues())
    issues = va.issue_rows(va.rejected_rows(checked), "item_id")
    return issues.select("item_id", "path", "message", "error_code", *_long("status_code"))


@query
def rejected_details(c: Corpus) -> DataFrame:
    """The messages of each rejected item by path."""
    checked = va.with_errors(_merged(c), va.article_issues())
    rows = va.rejected_rows(checked).select("item_id", F.explode("details").alias("path", "messages"))
    return rows.select("item_id", "path", F.array_join(F.sort_array("messages"), "; ").alias("messages"))


@query
def primitive_checks(c: Corpus) -> DataFrame:
    digest = F.md5(F.col("item_id").cast("string"))
    uuid = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    some_uuid = F.when(F.col("item_id") % 2 == 0, uuid).otherwise(digest)
    issues = ck.primitive_checks(some_uuid, F.col("title"), F.col("published_at"), F.col("url"))
    rows = c.items.select("item_id", F.explode(issues).alias("e"))
    return rows.select("item_id", "e.path", "e.message")


def _settled(c: Corpus):
    return settle(_merged(c), c.sources, c.stored, as_of())


def _article_columns(rows: DataFrame) -> DataFrame:
    o = F.col("original")
    return rows.select(
        "id", "slug", "source_id", "category_id", F.size("tags").cast("long").alias("n_tags"), "language",
        "author", "cover_image", o["title"].alias("title"), F.md5(o["content"]).alias("content_md5"),
        o["url"].alias("url"), o["published_at"].alias("original_published_at"), F.col("ai.title").alias("ai_title"),
        F.size("ai.keywords").cast("long").alias("n_keywords"), "status",
        iso_utc(F.col("published_at")).alias("published_at"), iso_utc(F.col("created_at")).alias("created_at"),
        iso_utc(F.col("updated_at")).alias("updated_at"),
    )


@query
def new_articles(c: Corpus) -> DataFrame:
    return _article_columns(_settled(c).created)


@query
def article_messages(c: Corpus) -> DataFrame:
    return _settled(c).messages


def _run(c: Corpus):
    return collect_feeds(c.arrived_feeds, c.sources, c.crawl, c.stored, as_of())


@query
def collect_summary(c: Corpus) -> DataFrame:
    return _run(c).summary


@query
def collect_errors(c: Corpus) -> DataFrame:
    return _run(c).errors


@query
def collect_error_counts(c: Corpus) -> DataFrame:
    return co.error_counts(_run(c).errors)


def _checked_sources(c: Corpus) -> DataFrame:
    return va.with_errors(c.source_candidates, va.source_issues())


@query
def new_sources(c: Corpus) -> DataFrame:
    rows = mu.source_rows(va.valid_rows(_checked_sources(c)), as_of())
    fresh = mu.insert_if_absent(rows, c.sources, "source_id", "url")
    return fresh.select(
        "source_id", "name", "type", "url", "status", *_long("priority", "fetch_interval"), "language",
        "description", "fetch_strategy", iso_utc(F.col("created_at")).alias("created_at"),
    )


@query
def rejected_sources(c: Corpus) -> DataFrame:
    issues = va.issue_rows(va.rejected_rows(_checked_sources(c)), "page_id")
    return issues.select("page_id", "path", "message", "error_code", *_long("status_code"))


# Listing and lookup


def _card(articles: DataFrame) -> DataFrame:
    """The narrow columns of a listing."""
    return articles.select(
        "id", "slug", "source_id", "category_id", "tags", "language", "status", "published_at", "created_at"
    )


def _shown(page: DataFrame, *more: str) -> DataFrame:
    return page.select(
        "id", "slug", "source_id", "category_id", _joined("tags"), "language", "status",
        iso_utc(F.col("published_at")).alias("published_at"), iso_utc(F.col("created_at")).alias("created_at"), *more,
    )


@query
def articles_by_status(c: Corpus) -> DataFrame:
    return _shown(ls.find_by_status(_card(c.articles), "PUBLISHED"))


@query
def articles_by_status_page(c: Corpus) -> DataFrame:
    return _shown(ls.find_by_status(_card(c.articles), "RAW", limit=20, offset=20))


@query
def articles_by_source(c: Corpus) -> DataFrame:
    return _shown(ls.find_by_source(_card(c.articles), "src_3"))


@query
def list_articles(c: Corpus) -> DataFrame:
    return _shown(ls.article_page(_card(c.articles), category_id="cat_2"), "total", "limit", "offset")


@query
def article_details(c: Corpus) -> DataFrame:
    page = ls.list_articles(_card(c.articles), status="PENDING_REVIEW")
    wide = c.items.withColumn("id", F.concat(F.lit("art_"), "item_id"))
    return ls.page_details(page, wide).select("id", "title", "url", F.md5("content").alias("content_md5"))


@query
def list_articles_by_title(c: Corpus) -> DataFrame:
    page = ls.list_articles(_card(c.articles), tag="tag_2", order_field="title", direction="ASC", limit=50, offset=10)
    return _shown(page)


@query
def list_articles_by_publication(c: Corpus) -> DataFrame:
    return _shown(ls.list_articles(_card(c.articles), order_field="publishedAt", limit=100))


@query
def list_articles_compat(c: Corpus) -> DataFrame:
    page = ls.list_articles(_card(c.articles), status="APPROVED", category_id="cat_4", compat=True, limit=None)
    return _shown(page)


@query
def article_totals(c: Corpus) -> DataFrame:
    return ls.count_articles(c.articles)


@query
def status_totals(c: Corpus) -> DataFrame:
    return ls.count_by(c.articles, "status")


@query
def source_totals(c: Corpus) -> DataFrame:
    return ls.count_by(c.articles, "source_id")


@query
def lookup_ids(c: Corpus) -> DataFrame:
    found = ls.find_ids(_card(c.articles), c.commands.select(F.col("article_id").alias("id")))
    return found.select("id", "found", "slug", "status")


@query
def lookup_sources(c: Corpus) -> DataFrame:
    wanted = c.fallback_map.select(F.col("fallback_id").alias("source_id"))
    return ls.find_ids(c.sources, wanted, "source_id").select("source_id", "found", "name", "status")


def _answer(answer: DataFrame) -> DataFrame:
    return answer.select("total", "limit", "offset", F.array_join(F.col("items.id"), ",").alias("ids"))


@query
def list_answer(c: Corpus) -> DataFrame:
    """A page as one row with its total."""
    return _answer(ls.article_answer(_card(c.articles), category_id="cat_2", offset=5))


@query
def list_answer_past_end(c: Corpus) -> DataFrame:
    """A page past the end, which has no item but the total."""
    return _answer(ls.article_answer(_card(c.articles), category_id="cat_2", offset=1_000_000_000))


@query
def lookup_missing(c: Corpus) -> DataFrame:
    ids = c.commands.select(F.col("article_id").alias("id"))
    rows = va.not_found(mu.missing_keys(ids, c.articles, "id"), "Article")
    return rows.select("id", "message", "error_code", *_long("status_code"))


@query
def lookup_slug(c: Corpus) -> DataFrame:
    return _shown(ls.find_by_slug(_card(c.articles), "slug-17"))


@query
def first_by_slug(c: Corpus) -> DataFrame:
    return _shown(ls.first_per_slug(_card(c.articles)))


# Updates, deletes, lifecycle


@query
def patch_articles(c: Corpus) -> DataFrame:
    valid = va.valid_rows(va.with_errors(_article_patches(c), va.article_patch_issues()))
    rows = mu.patch_articles(c.articles, valid, as_of())
    return _shown(rows.withColumn("updated", iso_utc(F.col("updated_at"))), "updated")


def _article_patches(c: Corpus) -> DataFrame:
    return c.patches.withColumns({n: F.lit(None).cast("string") for n in ("author", "cover_image")})


def _with_ai(c: Corpus, mode: str) -> DataFrame:
    """Articles whose ``ai`` record gets its model and title patched by the last purchase."""
    filled = {
        "title": F.col("slug"), "keywords": F.array("language"), "model": F.lit("m0"),
        "token_usage": F.struct(F.lit(1).alias("input"), F.lit(2).alias("output"), F.lit(3).alias("total")),
    }
    ai = mu.empty_ai()
    for name, value in filled.items():
        ai = ai.withField(name, value.cast(AI[name].dataType))
    last = c.commands.filter(F.col("command") == "publish").groupBy(F.col("article_id").alias("id"))
    last = last.agg(F.max("seq").alias("seq"))
    model = F.concat(F.lit("m"), F.col("seq"))
    patches = last.select(
        "id",
        mu.empty_ai().withField("model", model).alias("ai"),
        F.when(F.col("seq") % 2 == 0, F.array(F.lit("model"))).otherwise(
            F.array(F.lit("model"), F.lit("title"))).alias("ai_fields"),
    )
    rows = mu.patch_ai(c.articles.withColumn("ai", ai), patches, as_of(), mode)
    return rows.select(
        "id", F.col("ai.title").alias("ai_title"), F.col("ai.model").alias("ai_model"),
        F.array_join("ai.keywords", ",").alias("ai_keywords"), F.col("ai.token_usage.total").alias("ai_tokens"),
        iso_utc(F.col("updated_at")).alias("updated_at"),
    )


@query
def patch_ai_merge(c: Corpus) -> DataFrame:
    return _with_ai(c, "merge")


@query
def patch_ai_replace(c: Corpus) -> DataFrame:
    return _with_ai(c, "replace")


@query
def rejected_patches(c: Corpus) -> DataFrame:
    checked = va.with_errors(_article_patches(c), va.article_patch_issues())
    issues = va.issue_rows(va.rejected_rows(checked), "seq")
    return issues.select("seq", "path", "message", "error_code", *_long("status_code"))


def _source_patches(c: Corpus) -> DataFrame:
    empty = {n: F.lit(None).cast("string") for n in ("type", "language", "description")}
    return va.with_errors(c.source_patches.withColumns(empty), va.source_patch_issues())


@query
def patch_sources(c: Corpus) -> DataFrame:
    table = c.sources.withColumn("updated_at", F.lit(None).cast("timestamp"))
    rows = mu.patch_sources(table, va.valid_rows(_source_patches(c)), as_of())
    return rows.select(
        "source_id", "name", "type", "url", "status", *_long("priority", "fetch_interval"), "language",
        "fetch_strategy", iso_utc(F.col("updated_at")).alias("updated_at"),
    )


@query
def rejected_source_patches(c: Corpus) -> DataFrame:
    issues = va.issue_rows(va.rejected_rows(_source_patches(c)), "seq")
    return issues.select("seq", "path", "message", "error_code", *_long("status_code"))


@query
def delete_articles(c: Corpus) -> DataFrame:
    return _shown(mu.delete_rows(_card(c.articles), c.delete_ids, "id"))


@query
def delete_missing(c: Corpus) -> DataFrame:
    rows = va.not_found(mu.missing_keys(c.delete_ids, c.articles, "id"), "Article")
    return rows.select("id", "message", "error_code", *_long("status_code"))


@query
def toggle_sources(c: Corpus) -> DataFrame:
    clicks = c.events.filter(F.col("event_type") == "click")
    batch = clicks.select(F.concat(F.lit("src_"), F.col("user_id")).alias("source_id"))
    return mu.toggle_sources(c.sources, batch, as_of()).select("source_id", "status")


@query
def lifecycle_step(c: Corpus) -> DataFrame:
    outcomes = li.step(c.articles, li.latest_command(c.commands), as_of())
    return outcomes.select(
        "article_id", "seq", "command", "status", "new_status",
        iso_utc(F.col("published_at")).alias("published_at"), "error",
    )


@query
def lifecycle_apply(c: Corpus) -> DataFrame:
    outcomes = li.step(c.articles, li.latest_command(c.commands), as_of())
    rows = li.apply_outcomes(c.articles, outcomes, as_of())
    return _shown(rows.withColumn("updated", iso_utc(F.col("updated_at"))), "updated")


@query
def lifecycle_replay(c: Corpus) -> DataFrame:
    rows = li.replay(c.articles, c.commands)
    return rows.select("seq", "article_id", "command", "status_before", "status_after", "error")


@query
def lifecycle_final(c: Corpus) -> DataFrame:
    ends = li.final_statuses(c.articles, li.replay(c.articles, c.commands))
    return ends.select("id", "status", iso_utc(F.col("published_at")).alias("published_at"))


# Reports


@query
def source_quality(c: Corpus) -> DataFrame:
    return rp.source_quality(c.items)


@query
def field_coverage(c: Corpus) -> DataFrame:
    fields = ["title", "summary", "content", "author", "image", "published_at", "categories"]
    return rp.flag_rows(rp.field_coverage(c.items), fields)


def _report_columns(c: Corpus) -> list[str]:
    """Names of the compared sources, from the small source table."""
    return rp.report_columns(c.sources.select("source_id"), at_least=2)


@query
def coverage_report(c: Corpus) -> DataFrame:
    long = rp.coverage_metrics(rp.field_coverage(c.items), rp.source_quality(c.items))
    return rp.side_by_side(long, "source_id", _report_columns(c))


def _expected(c: Corpus) -> DataFrame:
    full = F.col("fetch_strategy") == "RSS_ONLY"
    return c.sources.select(
        "source_id",
        F.when(full, "RSS_ONLY").otherwise("RSS_PLUS_HTML_FETCH").alias("expected_strategy"),
        F.coalesce(~full, F.lit(True)).alias("expected_fetch"),
    )


@query
def collection_report(c: Corpus) -> DataFrame:
    return rp.collection_report(_merged(c), _expected(c))


@query
def collection_side_by_side(c: Corpus) -> DataFrame:
    long = rp.collection_metrics(rp.collection_report(_merged(c), _expected(c)))
    return rp.side_by_side(long, "source_id", _report_columns(c))


@query
def collection_verdict(c: Corpus) -> DataFrame:
    return rp.all_match(rp.collection_report(_merged(c), _expected(c)))


def _fetches(c: Corpus) -> DataFrame:
    sizes = latest_per_url(rp.page_sizes(extract_pages(c.crawl)), "page_id", rp.SIZE_FIELDS)
    return rp.fetch_report(c.items.select("item_id", "url"), sizes, "item_id")


@query
def fetch_report(c: Corpus) -> DataFrame:
    return _fetches(c).drop("url")


@query
def fetch_metrics(c: Corpus) -> DataFrame:
    return rp.fetch_metrics(_fetches(c), "item_id")


@query
def fetch_counts(c: Corpus) -> DataFrame:
    return rp.fetch_counts(_fetches(c))


@query
def fetch_improvement(c: Corpus) -> DataFrame:
    lengths = c.items.select("item_id", co.utf16_length(F.col("content")).cast("long").alias("rss_length"))
    return rp.improvement(_fetches(c), lengths, "item_id")


# Queues, events, schedules


@query
def json_bodies(c: Corpus) -> DataFrame:
    bare = F.struct(F.col("body").alias("articleId"))
    parsed = c.queue.select("message_id", parse_json_or(F.col("body"), "articleId string", bare).alias("b"))
    return parsed.select("message_id", F.col("b.articleId").alias("article_id"))


def _last_sent(c: Corpus) -> Column:
    return c.queue.agg(F.max("sent_at")).scalar()


def _routed(c: Corpus) -> DataFrame:
    return qs.route_messages(c.queue, c.articles, _last_sent(c))


def _routing(rows: DataFrame) -> DataFrame:
    return rows.select("message_id", "article_id", "article_status", *_long("receive_count"), "outcome")


@query
def queue_process(c: Corpus) -> DataFrame:
    return _routing(_routed(c))


@query
def queue_retry(c: Corpus) -> DataFrame:
    return qs.retry_messages(_routed(c)).select("message_id", "body", *_long("receive_count"))


@query
def queue_dead_letters(c: Corpus) -> DataFrame:
    dead = qs.with_outcome(_routed(c), "DEAD_LETTER")
    return _routing(qs.live_dead_letters(dead, _last_sent(c)))


@query
def queue_outcomes(c: Corpus) -> DataFrame:
    return _routed(c).groupBy("outcome").agg(F.count(F.lit(1)).alias("n_messages"))


def _stream(c: Corpus, table: str) -> DataFrame:
    """The rows of a table as they arrive; the table is one file or a folder of files."""
    files = c.spark.readStream.schema(c.spark.read.parquet(f"{c.folder}/{table}.parquet").schema)
    # The braces match the table alone; a stream takes a single file only by such a pattern.
    return Corpus.typed(files.parquet(f"{c.folder}/{{{table}}}.parquet"))


def _drain(c: Corpus, name: str, start: Callable) -> DataFrame:
    """Run a stream to the end of its input and return what it wrote."""
    root = run_dir(c.spark, name)
    start(f"{root}/out", f"{root}/state").awaitTermination()
    return c.spark.read.parquet(f"{root}/out").drop("batch")


@query
def queue_stream(c: Corpus) -> DataFrame:
    messages = c.derive("queue", events=_stream(c, "events"))
    now = _last_sent(c)
    return _routing(_drain(c, "queue", lambda out, state: qs.run_queue(messages, lambda: c.articles, out, state, now)))


@query
def approved_events(c: Corpus) -> DataFrame:
    outcomes = pb.publish_approved(c.bus, c.articles, as_of())
    return outcomes.select(
        "article_id", "status", "new_status", iso_utc(F.col("published_at")).alias("published_at"), "error"
    )


@query
def lifecycle_stream(c: Corpus) -> DataFrame:
    commands = c.derive("commands", events=_stream(c, "events"))
    rows = _drain(c, "commands", lambda out, state: sl.run_lifecycle(
        commands, lambda: c.articles, out, f"{out}-statuses", state))
    return rows.select("seq", "article_id", "command", "status_before", "status_after", "error")


@query
def approved_stream(c: Corpus) -> DataFrame:
    events = c.derive("bus", events=_stream(c, "events"))
    rows = _drain(c, "bus", lambda out, state: pb.run_publish(events, lambda: c.articles, out, state, as_of()))
    return rows.select("article_id", "status", "new_status", iso_utc(F.col("published_at")).alias("published_at"), "error")


@query
def scheduled_collect(c: Corpus) -> DataFrame:
    def collect(batch: DataFrame) -> DataFrame:
        now = Corpus(batch.sparkSession, c.folder)
        merged = co.merge_articles(now.derive("items", documents=batch), now.sources, now.crawl)
        return settle(merged, now.sources, now.stored, as_of()).created

    arrivals = _stream(c, "documents")
    return _article_columns(_drain(c, "collect", lambda out, state: sc.run_collection(arrivals, collect, out, state)))


def _feed_stream(c: Corpus) -> str:
    """Collect the feed documents as they arrive, a third of the sources after the other.

    A source's documents arrive together, in as many files as the rendering has tasks.
    """
    root = run_dir(c.spark, "feed-stream")
    for arrival in range(ARRIVALS):
        arrived = F.pmod(F.hash("source_id"), F.lit(ARRIVALS)) == arrival
        c.arrived_feeds.filter(arrived).write.mode("append").parquet(f"{root}/feeds")
        feeds = c.spark.readStream.schema("source_id string, feed_no long, feed_xml string").parquet(f"{root}/feeds")
        stream = sc.run_feed_collection(
            feeds, lambda: c.sources, lambda: c.crawl, lambda: c.stored, f"{root}/out", f"{root}/state", as_of())
        stream.awaitTermination()
    return f"{root}/out"


@query
def feed_stream_articles(c: Corpus) -> DataFrame:
    return _article_columns(sc.read_output(c.spark, _feed_stream(c), "articles"))


@query
def feed_stream_errors(c: Corpus) -> DataFrame:
    return sc.read_output(c.spark, _feed_stream(c), "errors").drop("epoch")


@query
def feed_stream_counters(c: Corpus) -> DataFrame:
    counters = sc.read_output(c.spark, _feed_stream(c), "summary")
    return counters.agg(*[F.sum(n).alias(n) for n in ("articles_created", "failed_sources", "error_count")])


@query
def url_refetch_24h(c: Corpus) -> DataFrame:
    return rf.first_requests(c.requests).select("url", iso_utc(F.col("fetch_at")).alias("fetch_at"))


@query
def url_refetch_stream(c: Corpus) -> DataFrame:
    requests = rf.first_requests_stream(c.derive("requests", events=_stream(c, "events")))

    def start(out: str, state: str) -> StreamingQuery:
        writer = requests.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        return writer.trigger(availableNow=True).start()

    return _drain(c, "refetch", start).select("url", iso_utc(F.col("fetch_at")).alias("fetch_at"))


@query
def due_sources(c: Corpus) -> DataFrame:
    due = sc.due_sources(c.sources, c.last_fetch, F.lit(DUE_AT).cast("timestamp"))
    return due.select("source_id", *_long("priority"), iso_utc(F.col("last_fetch")).alias("last_fetch"))


# Duplicates and dimensions


@query
def duplicate_texts(c: Corpus) -> DataFrame:
    rows = du.mark_duplicates(c.items, du.text_key(F.col("content")), "item_id")
    return rows.select("item_id", "original_id", "copies")


@query
def duplicate_urls(c: Corpus) -> DataFrame:
    rows = du.mark_duplicates(c.items.select("item_id", "url"), F.col("url"), "item_id")
    return rows.select("item_id", "original_id", "copies")


@query
def tag_counts(c: Corpus) -> DataFrame:
    return du.tag_dimension(c.tags, c.articles).select("slug", "name", "article_count")


@query
def category_counts(c: Corpus) -> DataFrame:
    return du.category_counts(c.categories, c.articles)


@query
def article_categories(c: Corpus) -> DataFrame:
    return du.article_categories(c.articles.select("id", "category_id"), c.categories)
