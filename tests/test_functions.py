from pyspark.sql import functions as F

from feedloom.functions import checks as ck
from feedloom.functions import dates, jsontext
from feedloom.functions import text as tx

WIDE = "\u00a0\ufeff\u2028\u3000\t"


def test_length_counts_utf16_units(values):
    assert values(tx.utf16_length, ["a\U0001f600b", "", "é", None]) == [4, 0, 1, None]


def test_trim_knows_the_wide_whitespace_set_only(values):
    assert values(tx.ws_trim, [f"{WIDE}a b{WIDE}", "\u0085x\u200b"]) == ["a b", "\u0085x\u200b"]


def test_every_wide_space_separates_words(values):
    texts = [f"a{c}b" for c in tx.WS_CHARS] + ["", "  ", "one", " a  b\u00a0c "]
    assert values(tx.word_count, texts) == [2] * len(tx.WS_CHARS) + [0, 0, 1, 3]


def test_strip_html_eats_from_ampersand_to_semicolon(values):
    cases = ["<p>a&amp;b</p>", "fish & chips; salad", "a & b", "x &; y", "a<br>b<", "&&&", "1 < 2 > 0"]
    assert values(tx.strip_html, cases) == ["a b", "fish salad", "a & b", "x &; y", "a b<", "&&&", "1 0"]


def test_strip_html_is_linear_in_unclosed_openings(values):
    text = "& < " * 100_000
    assert values(tx.strip_html, [text]) == [text.strip()]


def test_reading_minutes(values):
    assert values(tx.reading_minutes, [-1, 0, 1, 200, 201], "long") == [0, 0, 1, 1, 2]


def test_excerpt_cuts_at_160_units_and_never_splits_a_pair(values):
    cases = ["a " * 200, "x" * 159 + "\U0001f600y", "\U0001f600" * 100, "short"]
    out = values(tx.excerpt, cases)
    assert out == [("a " * 80).strip(), "x" * 159, "\U0001f600" * 80, "short"]


def test_slug_keeps_ascii_words_and_edge_hyphens(values):
    cases = ["Été à Paris", " Hello,  World_x -- y ", "a\u00a0b\ufeffc", "---", "日本", "A&B"]
    assert values(tx.slugify, cases) == ["t-paris", "-hello-world-x-y-", "a-b-c", "-", "", "ab"]


def test_entities_decode_once(values):
    assert values(tx.decode_entities, ["&lt;b&gt; &amp;lt; &quot;&#39;"]) == ["<b> &lt; \"'"]


def test_dates(values):
    cases = {
        "2026-07-16": "2026-07-16T00:00:00.000Z",
        "2026-07-16T06:00Z": "2026-07-16T06:00:00.000Z",
        "2026-07-16T06:00:00": "2026-07-16T06:00:00.000Z",
        "2026-07-16T06:00:00.5+07:00": "2026-07-15T23:00:00.500Z",
        "2026-07-16T06:00:00+0700": "2026-07-15T23:00:00.000Z",
        "Thu, 16 Jul 2026 06:00:00 GMT": "2026-07-16T06:00:00.000Z",
        "16 Jul 2026 06:00 +0700": "2026-07-15T23:00:00.000Z",
        "Thu, 16 Jul 2026 06:00:00 EST": "2026-07-16T11:00:00.000Z",
        "Thu,  6 Aug 2026 06:00:00 PDT": "2026-08-06T13:00:00.000Z",
        "16 Jul 2026 06:00:00": "2026-07-16T06:00:00.000Z",
        "2026-02-30": None, "soon": None, "": None, None: None, "16 Jul 2026 06:00:00 XYZ": None,
    }
    assert values(dates.to_iso, list(cases)) == list(cases.values())


def test_dates_do_not_depend_on_the_session_zone(spark, values):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert values(dates.to_iso, ["2026-07-16", "16 Jul 2026 06:00:00 GMT"]) == [
            "2026-07-16T00:00:00.000Z", "2026-07-16T06:00:00.000Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_datetime_with_offset(values):
    cases = ["2026-07-16T06:00:00Z", "2026-07-16T06:00+07:00", "2026-07-16T06:00:00.123+0700",
             "2026-07-16T06:00:00", "2026-02-30T06:00:00Z", "2026-07-16T24:00:00Z", "2026-07-16", None]
    assert values(ck.is_datetime_with_offset, cases) == [True, True, True, False, False, False, False, None]


def test_urls(values):
    cases = ["https://a.b/c d", "mailto:x@y", "http://", "https:///?q", "nope", "", "HTTP:host", "ftp://?x", "a b:c"]
    assert values(ck.is_url, cases) == [True, True, False, False, False, False, True, False, False]


def test_uuid(values):
    ok = "123e4567-e89b-12d3-a456-426614174000"
    assert values(ck.is_uuid, [ok, ok.upper(), ok.replace("-", ""), "x"]) == [True, True, False, False]


def test_json_fallback_and_message_bodies(values):
    parsed = values(
        lambda c: jsontext.parse_json_or(c, "a int", F.struct(F.lit(-1).alias("a")))["a"],
        ['{"a": 1}', "not json", '{"b": 2}'],
    )
    assert parsed == [1, -1, None]
    assert values(jsontext.message_article_id, ['{"articleId":"art_1"}', "art_2"]) == ["art_1", "art_2"]
    assert values(jsontext.article_message, ["art_1"]) == ['{"articleId":"art_1"}']


def test_numeric_and_named_entities(values):
    texts = ["It&#8217;s caf&eacute; &#x1F600;!", "&#0; &#xD800; &#1114112; &#;", "a &amp;#65; b", "plain", None, "&ldquo;x&rdquo;"]
    assert values(tx.decode_entities, texts) == ["It’s café 😀!", "&#0; &#xD800; &#1114112; &#;", "a &#65; b", "plain", None, "“x”"]


def test_snippet_of_many_open_tags(values):
    assert values(tx.snippet, ["<" * 100_000, "<p>a</p> <b"]) == ["<" * 100_000, "a <b"]
