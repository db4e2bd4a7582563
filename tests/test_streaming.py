import random
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from feedloom.operators import lifecycle as li
from feedloom.operators import mutate as mu
from feedloom.plans import queries
from feedloom.plans.collection import collect_feeds
from feedloom.plans.corpus import Corpus
from feedloom.sources import queues as qu
from feedloom.sources import store
from feedloom.sources.store import append_batch
from feedloom.streaming import collection as sc
from feedloom.streaming import lifecycle as sl
from feedloom.streaming import publish as pb
from feedloom.streaming import queue as qs
from feedloom.streaming import refetch as rf

QUEUE = "message_id long, body string, receive_count int, sent_at timestamp"
DAY = datetime(2026, 1, 2)


def articles(spark):
    return spark.createDataFrame([("a", "RAW"), ("b", "APPROVED")], "id string, status string")


def test_routing(spark):
    fresh, old = DAY - timedelta(hours=24), DAY - timedelta(hours=24, seconds=1)
    rows = [(1, '{"articleId":"a"}', 1, fresh), (2, "b", 3, fresh), (3, "a", 4, fresh), (4, "x", 1, fresh),
            (5, "x", 3, fresh), (6, "x", 1, old), (7, "a", 9, old)]
    routed = qs.route_messages(spark.createDataFrame(rows, QUEUE), articles(spark), F.lit(DAY))
    out = {r.message_id: (r.article_status, r.outcome) for r in routed.collect()}
    assert out == {1: ("RAW", "PROCESSED"), 2: ("APPROVED", "PROCESSED"), 3: ("RAW", "DEAD_LETTER"), 4: (None, "RETRY"),
                   5: (None, "DEAD_LETTER"), 6: (None, "EXPIRED"), 7: ("RAW", "EXPIRED")}
    assert [(r.message_id, r.receive_count) for r in qs.retry_messages(routed).collect()] == [(4, 2)]
    assert qs.live_dead_letters(routed, F.lit(DAY + timedelta(days=7))).count() == 0


def test_retries_come_back_until_they_are_dead_letters(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    first = spark.createDataFrame([(1, "a", 1, DAY), (2, "missing", 1, DAY)], QUEUE)
    append_batch(first, inbox, 1000)
    for _ in range(4):
        # The retry batches land in the inbox under their epoch number, below the first file's.
        stream = spark.readStream.schema(QUEUE).option("recursiveFileLookup", True).parquet(inbox)
        qs.run_queue(stream, lambda: articles(spark), out, state, F.lit(DAY), retry_to=inbox).awaitTermination()
    rows = spark.read.parquet(out).select("message_id", "receive_count", "outcome").collect()
    assert sorted(map(tuple, rows)) == [(1, 1, "PROCESSED"), (2, 1, "RETRY"), (2, 2, "RETRY"), (2, 3, "DEAD_LETTER")]


def test_approved_events_publish_once(spark):
    rows = [("ArticleApproved", '{"articleId":"b"}', DAY), ("ArticleApproved", '{"articleId":"b"}', DAY),
            ("ArticleApproved", '{"articleId":"a"}', DAY), ("Other", '{"articleId":"b"}', DAY)]
    events = spark.createDataFrame(rows, "detail_type string, detail string, ts timestamp")
    table = articles(spark).withColumn("published_at", F.lit(None).cast("timestamp"))
    out = {r.article_id: (r.new_status, r.error) for r in pb.publish_approved(events, table, F.lit(DAY)).collect()}
    assert out == {"b": ("PUBLISHED", None), "a": ("RAW", "Cannot publish article in status RAW. Must be APPROVED.")}


def test_collection_is_idempotent_over_several_triggers(spark, tmp_path):
    arrivals, out, state, queue = (str(tmp_path / n) for n in ("arrivals", "out", "state", "queue"))
    schema = "source_id string, pos long, title string, url string"

    def collect(batch):
        original = F.struct("title", F.lit("s").alias("summary"), F.lit("c").alias("content"), "url",
                            F.lit(None).cast("string").alias("published_at"), F.lit("").alias("image"), F.lit("").alias("author"))
        return mu.article_rows(batch.select("source_id", "pos", original.alias("original")), F.lit(DAY))

    for rows in ([("s", 0, "one", "u1"), ("s", 1, "copy", "u1")], [("s", 0, "again", "u1"), ("s", 1, "two", "u2")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(schema).parquet(arrivals)
        sc.run_collection(stream, collect, out, state, queue).awaitTermination()
    assert sorted(r.slug for r in spark.read.parquet(out).collect()) == ["one", "two"]
    assert spark.read.parquet(queue).count() == 2


def test_command_stream_equals_one_replay(spark, tmp_path):
    inbox, out, statuses, state = (str(tmp_path / n) for n in ("inbox", "out", "statuses", "state"))
    schema = "seq long, article_id string, command string, ts timestamp"
    names = ("submit", "approve", "publish", "archive", "reject", "publish")
    log = [(i, "a" if i % 3 else ("b" if i % 2 else "x"), names[i * 7 % 6], DAY + timedelta(minutes=i)) for i in range(60)]
    table = articles(spark).withColumn("published_at", F.lit(None).cast("timestamp"))
    for part in range(3):
        spark.createDataFrame(log[part * 20:part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        sl.run_lifecycle(stream, lambda: table, out, statuses, state).awaitTermination()
    whole = li.replay(table, spark.createDataFrame(log, schema))
    columns = ["seq", "status_before", "status_after", "error"]
    assert sorted(spark.read.parquet(out).select(*columns).collect(), key=str) == sorted(whole.select(*columns).collect(), key=str)
    changes = spark.read.parquet(statuses)
    assert sorted(sl.current_statuses(table, changes).collect()) == sorted(li.final_statuses(table, whole).collect())


def test_messages_are_written_only_to_a_configured_queue(spark, tmp_path):
    qu.send_messages(articles(spark), None)
    qu.send_messages(articles(spark), str(tmp_path / "q"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "q")).collect()) == ['{"articleId":"a"}', '{"articleId":"b"}']


def fetch_hours(rows):
    return sorted((r.url, (r.fetch_at - DAY) / timedelta(hours=1)) for r in rows)


def test_refetch_batch_form(spark):
    # Requests in between (0.5, 23, 47.5) do not put off the next fetch.
    hours = [0, 0.5, 23, 24, 47.5, 48, 71.9, 96, 120.5, 144]
    rows = [("u", DAY + timedelta(hours=h)) for h in hours] + [("v", DAY), ("v", DAY), (None, DAY), ("w", None)]
    out = rf.first_requests(spark.createDataFrame(rows, "url string, ts timestamp")).collect()
    assert fetch_hours(out) == [("u", 0), ("u", 24), ("u", 48), ("u", 96), ("u", 120.5), ("v", 0)]


def follow(rows):
    out, free = [], {}
    for at, url in sorted({(at, url) for url, at in rows}):
        if url not in free or at >= free[url]:
            out.append((url, (at - DAY) / timedelta(hours=1)))
            free[url] = at + timedelta(hours=24)
    return sorted(out)


@pytest.mark.parametrize("n", [40, 400, 20_000])
def test_refetch_equals_one_by_one(spark, n):
    rng = random.Random(n)
    # Few requests, and so many that every minute has some: steps inside, to the end of, and over a minute.
    rows = [(f"u{min(3, int(rng.expovariate(1)))}", DAY + timedelta(microseconds=rng.randrange(6 * 24 * 3600 * 10**6))) for _ in range(n)]
    rows += [(f"d{k}", DAY + timedelta(hours=24 * d, seconds=rng.randrange(120), microseconds=rng.randrange(3))) for k in range(30) for d in range(5)]
    out = rf.first_requests(spark.createDataFrame(rows, "url string, ts timestamp")).collect()
    assert fetch_hours(out) == follow(rows)


def test_refetch_of_nothing(spark):
    assert rf.first_requests(spark.createDataFrame([], "url string, ts timestamp")).count() == 0


def test_refetch_stream_equals_batch_and_forgets(spark, tmp_path):
    inbox, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    schema, rows = "url string, ts timestamp", []
    for day in range(6):
        today = [("u", DAY + timedelta(days=day, hours=h)) for h in (0, 1, 23)] + [(f"only{day}", DAY + timedelta(days=day))]
        rows += today
        spark.createDataFrame(today, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = rf.first_requests_stream(spark.readStream.schema(schema).parquet(inbox))
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        writer.trigger(availableNow=True).start().awaitTermination()
    got = fetch_hours(spark.read.parquet(out).collect())
    assert got == fetch_hours(rf.first_requests(spark.createDataFrame(rows, schema)).collect()) == follow(rows)
    assert len(spark.read.format("statestore").load(state).collect()) < 6  # of seven URLs


def test_due_sources(spark):
    sources = spark.createDataFrame([("a", "ACTIVE", 2, 60), ("b", "ACTIVE", 1, 60), ("c", "ACTIVE", 1, 61), ("d", "INACTIVE", 1, 1)],
                                    "source_id string, status string, priority int, fetch_interval int")
    fetched = spark.createDataFrame([("b", DAY - timedelta(hours=1)), ("c", DAY - timedelta(hours=1))], "source_id string, last_fetch timestamp")
    assert [r.source_id for r in sc.due_sources(sources, fetched, F.lit(DAY)).collect()] == ["b", "a"]


def test_an_event_that_comes_again_publishes_nothing(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    events = spark.createDataFrame([("ArticleApproved", '{"articleId":"b"}', DAY)], "detail_type string, detail string, ts timestamp")
    table = articles(spark).withColumn("published_at", F.lit(None).cast("timestamp"))
    for k in range(2):
        append_batch(events, inbox, k)
        stream = spark.readStream.schema(events.schema).parquet(inbox)
        pb.run_publish(stream, lambda: table, out, state, F.lit(DAY)).awaitTermination()
    rows = spark.read.parquet(out).orderBy("batch").collect()
    assert [(r.article_id, r.status, r.new_status) for r in rows] == [("b", "APPROVED", "PUBLISHED"), ("b", "PUBLISHED", "PUBLISHED")]
    assert [r.error is None for r in rows] == [True, False]


def test_state_reads_few_folders_after_many_epochs(spark, tmp_path):
    root, schema = str(tmp_path / "log"), "id string, status string, published_at timestamp, epoch long"
    kind = spark.createDataFrame([], schema).schema
    for epoch in range(100):
        store.state_before(spark, root, kind, epoch, sl.newest, every=8)  # what each batch does first
        rows = [(f"a{epoch % 7}", f"S{epoch}", None, epoch), (f"only{epoch}", "S", None, epoch)]
        append_batch(spark.createDataFrame(rows, kind).coalesce(1), root, epoch)
    assert max(len(store.state_paths(root, epoch, 8)) for epoch in range(101)) <= 8
    state = store.state_before(spark, root, kind, 100, sl.newest, every=8)
    assert {f.split("/")[-2] for f in state.inputFiles()} == {"before=96", "batch=96", "batch=97", "batch=98", "batch=99"}
    got = {r.id: r.status for r in state.collect()}
    assert got == {f"a{e % 7}": f"S{e}" for e in range(100)} | {f"only{e}": "S" for e in range(100)}
    # A replayed epoch sees what it saw, and writes its snapshot again.
    again = {r.id: r.status for r in store.state_before(spark, root, kind, 96, sl.newest, every=8).collect()}
    assert again == {f"a{e % 7}": f"S{e}" for e in range(96)} | {f"only{e}": "S" for e in range(96)}


def test_feed_collection_commits_outputs_together_and_replays(spark, tmp_path):
    from feedloom.plans.corpus import Corpus

    c, out, inbox = Corpus(spark, "/root/testdata/sf0.001"), str(tmp_path / "out"), str(tmp_path / "feeds")
    schema = "source_id string, feed_no long, feed_xml string"
    c.arrived_feeds.repartition(2, "source_id").write.parquet(inbox)

    def run(state):
        feeds = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        sc.run_feed_collection(feeds, lambda: c.sources, lambda: c.crawl, lambda: c.stored, out, str(tmp_path / state), F.lit(DAY)).awaitTermination()
        return {o: sorted(map(str, sc.read_output(spark, out, o).collect())) for o in sc.OUTPUTS}

    first = run("state")
    assert len(first["articles"]) == len(first["messages"]) > 0 and len(first["summary"]) == 2
    assert sum("could not be parsed" in e for e in first["errors"]) == 2
    # The same epochs again, as after the loss of the checkpoint's commits: nothing changes.
    assert run("state-2") == first
    # An epoch without its commit is not shown.
    append_batch(spark.read.parquet(f"{out}/articles/batch=0"), f"{out}/articles", 9)
    assert sorted(map(str, sc.read_output(spark, out, "articles").collect())) == first["articles"]


def test_streams_read_tables_of_one_and_of_several_files(spark, tmp_path):
    rows = spark.createDataFrame([(n, DAY) for n in range(10)], "n long, ts timestamp_ntz")
    pq.write_table(rows.toArrow(), tmp_path / "one.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "several.parquet"))
    for table in ("one", "several"):
        stream = queries._stream(Corpus(spark, str(tmp_path)), table)
        drained = queries._drain(Corpus(spark, str(tmp_path)), table, lambda out, state: stream.writeStream.foreachBatch(
            lambda batch, epoch: append_batch(batch, out, epoch) and None).option("checkpointLocation", state).trigger(availableNow=True).start())
        assert sorted(r.n for r in drained.collect()) == list(range(10))


def test_documents_of_one_source_arrive_together_in_several_files(spark, tmp_path, monkeypatch):
    # Ranges of positions of one source, and a few documents of others; pages 1 and 1996 have the same address.
    rows = [(k, f"Title {k}. Rest\nof it", "en", "src1", 20) for k in range(1, 4000, 13)] + [(k, f"Of {k}. Text", "en", f"src{k % 7}", 10) for k in range(2, 60, 13)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, f"https://p.example.org/{k % 1995}", "<p>x</p>") for k in (1, 14, 1996)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    events = spark.createDataFrame([(1, DAY, 27, "view", 1.0, "")], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(queries, "run_dir", lambda spark, name: str(tmp_path / name))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    kept = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        got = queries.QUERIES["feed_stream_articles"](spark, str(tmp_path)).collect()
        c = Corpus(spark, str(tmp_path))
        whole = collect_feeds(c.arrived_feeds, c.sources, c.crawl, c.stored, queries.as_of()).created.collect()
    finally:
        spark.conf.set(coalesce, kept)
    assert len(got) > 100 and sorted((r.id, r.slug) for r in got) == sorted((r.id, r.slug) for r in whole)
    root = str(tmp_path / "feed-stream")
    sizes = [r.n for r in spark.read.parquet(f"{root}/feeds").groupBy(F.input_file_name(), "source_id").agg(F.count(F.lit(1)).alias("n")).filter("source_id = 'src_1'").collect()]
    assert sum(sizes) == 8 and len(sizes) > 1
    epochs = sc.read_output(spark, f"{root}/out", "articles").groupBy("source_id").agg(F.count_distinct("epoch").alias("n"))
    assert epochs.filter("n > 1").count() == 0
