import pandas as pd
from pyspark.sql import functions as F

from feedloom.operators import reports as rp
from feedloom.sources import feeds as fd
from feedloom.sources import pages as pg
from feedloom.sources import store

HEAD = ('<?xml version="1.0"?><rss version="2.0" xmlns:media="m" xmlns:dc="d" xmlns:content="c">'
        "<channel>")
TAIL = "</channel></rss>"


def feed(spark, *bodies):
    rows = [(f"s{i}", b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "source_id string, feed_xml string")


def items(spark, *bodies):
    return fd.read_items(feed(spark, *bodies)).orderBy("source_id", "pos").collect()


def test_absent_keys_fall_through_but_empty_ones_do_not(spark):
    body = HEAD + "<title>T</title>" + "".join([
        "<item><title></title><description>&lt;p&gt;Hi &amp;amp; you&lt;/p&gt;</description></item>",
        "<item><description>d</description><content:encoded></content:encoded><dc:creator></dc:creator>"
        "<author>a</author></item>",
        "<item><pubDate>Thu, 16 Jul 2026 06:00:00 GMT</pubDate><author>a</author></item>",
        "<item><pubDate>some day</pubDate></item>",
    ]) + TAIL
    a, b, c, d = items(spark, body)
    assert (a.title, a.summary, a.content, a.url, a.published_at) == ("", "Hi & you", "<p>Hi &amp; you</p>", "", None)
    assert (b.content, b.author) == ("", "")
    assert (c.published_at, c.author, c.summary) == ("2026-07-16T06:00:00.000Z", "a", "")
    assert d.published_at == "some day"
    assert [r.pos for r in (a, b, c, d)] == [0, 1, 2, 3]


def test_image_order_and_repeated_media(spark):
    media = '<media:content url="{}"/>'
    thumb, enclosure = '<media:thumbnail url="t"/>', '<enclosure url="e"/>'
    body = HEAD + "".join(f"<item>{x}</item>" for x in [
        media.format("one") + media.format("two") + thumb,
        media.format("") + thumb + enclosure,
        "<media:content/>" + enclosure,
        "",
    ]) + TAIL
    assert [r.image for r in items(spark, body)] == ["one", "t", "e", ""]


def test_malformed_empty_and_untitled_feeds(spark):
    parsed = fd.parse_feeds(feed(spark, HEAD + "<item>", HEAD + TAIL, "junk", None, HEAD + "<title>X</title>" + TAIL))
    rows = {r.source_id: r for r in parsed.collect()}
    assert [rows[f"s{i}"].feed_ok for i in range(5)] == [False, True, False, False, True]
    assert (rows["s1"].feed_title, rows["s4"].feed_title) == ("Unknown Feed", "X")
    assert fd.explode_items(parsed).count() == 0


def test_atom_and_rss1_feeds(spark):
    atom = ('<feed xmlns="http://www.w3.org/2005/Atom"><title type="html">Atom &amp; co</title><id>f</id>'
            '<entry><title type="text">One</title><link rel="self" href="no"/><link rel="alternate" href="https://a/1"/>'
            '<id>e1</id><updated>2026-07-16T06:00:00+07:00</updated><author><name>Ann</name></author>'
            '<content type="html">&lt;p&gt;Body&lt;/p&gt;</content><category term="x"/></entry>'
            '<entry><title>Two</title><link href="https://a/2"/><published>2026-07-01</published>'
            "<summary>short</summary></entry></feed>")
    rdf = ('<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><channel><title>Rdf</title></channel><item><title>Three</title>'
           "<link>https://a/3</link><dc:date>2026-07-02T00:00:00Z</dc:date><dc:creator>Bob</dc:creator></item></rdf:RDF>")
    empty = '<feed xmlns="http://www.w3.org/2005/Atom"><id>f</id></feed>'
    one, two, three = items(spark, atom, rdf, empty, "<html><body/></html>")
    assert (one.feed_title, one.title, one.url, one.author, one.published_at, one.content, one.summary) == (
        "Atom & co", "One", "https://a/1", "Ann", "2026-07-15T23:00:00.000Z", "<p>Body</p>", "Body")
    assert (two.url, two.published_at, two.summary, two.content) == ("https://a/2", "2026-07-01T00:00:00.000Z", "", "")
    assert (three.feed_title, three.author, three.published_at) == ("Rdf", "Bob", "2026-07-02T00:00:00.000Z")
    ok = {r.source_id: r.feed_ok for r in fd.parse_feeds(feed(spark, empty, "<html><body/></html>")).collect()}
    assert ok == {"s0": True, "s1": False}


def test_attributes_do_not_hide_text(spark):
    body = HEAD + '<item><guid isPermaLink="false">g1</guid><category domain="d">c1</category></item>' + TAIL
    raw = fd.explode_items(fd.parse_feeds(feed(spark, body))).first().raw
    assert (raw.guid, raw.categories) == ("g1", ["c1"])


def test_feed_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(HEAD + "<item><title>one</title></item>" + TAIL)
    (tmp_path / "b.xml").write_text("broken")
    parsed = fd.parse_feeds(fd.read_feed_files(spark, str(tmp_path)))
    assert sorted((r.path[-5:], r.feed_ok) for r in parsed.collect()) == [("a.xml", True), ("b.xml", False)]


def test_key_profile_extra_keys_and_image_coverage(spark):
    body = HEAD + ('<item><title>a</title><comments>c</comments><media:content url="u" width="5"/></item>'
                   "<item><title>b</title><media:group>g</media:group></item>") + TAIL
    raw = fd.explode_items(fd.parse_feeds(feed(spark, body)))
    profile = {r.key: (r.n_items, r.is_known) for r in rp.key_profile(raw).collect()}
    assert profile == {"title": (2, True), "comments": (1, False), "media:content": (1, True), "media:group": (1, False)}
    assert rp.extra_keys(raw).first().extra_keys == ["comments", "media:group"]
    cover = rp.image_coverage(raw).first()
    assert (cover.n_items, cover.media_content, cover.media_content_url, cover.media_content_width,
            cover.media_content_height, cover.media_group, cover.enclosure) == (2, 1, 1, 1, 0, 1, 0)


def page(spark, *htmls):
    rows = [(i, f"https://p/{i}", h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_page_fields(spark):
    full = ('<html><head><title>A &amp; B</title><meta name="author" content="Ann">'
            "<meta content='d' name='description'><meta property='og:image' content='og.png'>"
            '<meta property="article:published_time" content="2026-07-15">'
            "</head><body><nav>x</nav><article class='c'><p>one two</p></article></body></html>")
    bare = ('<body><script>var a="<p>";</script><nav>menu</nav><p>only &nbsp; text</p><!-- no -->'
            '<img alt="x" src="first.png"><time datetime="2026-07-14T01:00:00Z">d</time><footer>f</footer></body>')
    blank = "<head><title>t</title><meta name='description' content=''></head><article></article><body> </body>"
    rows = {r.page_id: r for r in pg.extract_pages(page(spark, full, bare, "<div>no</div>", blank, None)).collect()}
    assert sorted(rows) == [0, 1, 3]
    a, b, c = rows[0], rows[1], rows[3]
    assert (a.title, a.html, a.text, a.excerpt, a.hero_image, a.author, a.published_at) == (
        "A & B", "<p>one two</p>", "one two", "d", "og.png", "Ann", "2026-07-15T00:00:00.000Z")
    assert (a.word_count, a.reading_time_minutes) == (2, 1)
    assert (b.title, b.text, b.excerpt, b.hero_image, b.author, b.published_at) == (
        "", "only text d", "only text d", "first.png", "", "2026-07-14T01:00:00.000Z")
    assert (c.text, c.excerpt, c.word_count, c.reading_time_minutes, c.published_at) == ("", "", 0, 0, None)


def test_latest_record_per_url(spark):
    pages = page(spark, "<article>old</article>", "<article>new</article>").withColumn("url", F.lit("u"))
    assert [r.text for r in pg.latest_per_url(pg.extract_pages(pages), "page_id").collect()] == ["new"]


def test_pandas_extractor(spark):
    schema = ("url string, title string, html string, text string, excerpt string, hero_image string, author string, "
              "published_at string, word_count long, reading_time_minutes long")

    def read(frame: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"url": frame["url"], "title": "", "html": frame["html"], "text": frame["html"].str.upper()})
        return out.assign(excerpt="", hero_image="", author="", published_at=None, word_count=1, reading_time_minutes=1)

    out = pg.pandas_extractor(read, schema)(page(spark, "abc"))
    assert out.first().text == "ABC"


def test_snapshots_batches_and_buckets(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", "RAW"), ("b", "PUBLISHED")], "id string, status string")
    store.write_snapshot(rows, root, 1, partition_by="status")
    store.write_snapshot(rows.filter("id = 'a'"), root, 2)
    assert store.read_snapshot(spark, root, 1).filter("status = 'RAW'").count() == 1
    assert store.read_snapshot(spark, root, 2).count() == 1

    log = str(tmp_path / "log")
    assert store.read_batches(spark, log, rows.schema).count() == 0
    store.append_batch(rows, log, 0)
    store.append_batch(rows, log, 1)
    store.append_batch(rows, log, 1)
    assert store.read_batches(spark, log, rows.schema).count() == 4
    assert store.read_batches(spark, log, rows.schema, before=1).count() == 2

    store.write_bucketed(rows, "bucketed_articles", "id", 4)
    joined = rows.repartition(4, "id").join(spark.table("bucketed_articles").hint("merge"), "id", "left_anti")
    assert joined.count() == 0


def test_shared_dir_is_the_configured_one(spark):
    assert store.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
