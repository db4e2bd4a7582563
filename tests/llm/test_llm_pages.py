"""Site template removal: hand-made hosts, and a plain counter over all pages."""

import re
from collections import defaultdict

import pytest

from feedloom.llm import html_main
from feedloom.llm.html_main import BLOCK, Node, parse, regions

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "page_id bigint, url string, html string"


def texts(spark, rows, **options):
    return {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def shape(node):
    """A subtree as nested tuples."""
    return (node.tag, node.names, *[" ".join(c.split()) if isinstance(c, str) else shape(c) for c in node.children])


def all_shapes(node, inside, top=True):
    out = set()
    if not top and html_main._may_be_template(node, inside):
        out.add((inside, shape(node)))
    for child in node.children:
        if isinstance(child, Node) and not child.aside and not (child.tag == "header" and not inside):
            out |= all_shapes(child, inside, False)
    return out


def render(node, inside, template, top=True):
    """Text with marks for line breaks; what is deleted leaves nothing."""
    if isinstance(node, str):
        return re.sub(r"\s+", " ", html_main.unescape(node))
    if not top and (node.aside or (node.tag == "header" and not inside)):
        return " "
    if not top and (inside, shape(node)) in template and html_main._may_be_template(node, inside):
        return "\n" if node.tag in BLOCK else ""
    body = "".join(render(child, inside, template, False) for child in node.children)
    return "\n" + body + "\n" if node.tag in BLOCK else " " + body if node.tag == "br" else body


def brute_force(rows):
    """Whole trees per page, counted host by host."""
    pages, by_host = {}, defaultdict(dict)
    for page_id, url, html in rows:
        root = parse(html or "")
        html_main._settle_names(root)
        starts = [(start, start.content and start.tag != "main") for start in regions(root)]
        shapes = set().union(*[all_shapes(s, inside) for s, inside in starts])
        whole = "".join("\n" + render(s, inside, set()) for s, inside in starts)
        whole = "\n".join(x.strip() for x in re.sub(" +", " ", whole).split("\n") if x.strip())
        host = (re.match(r"[a-zA-Z][\w+.-]*://([^/?#]*)", url or "") or ["", ""])[1].lower()
        pages[page_id] = (host, starts)
        by_host[host][whole] = shapes
    template = {}
    for host, different in by_host.items():
        counts = defaultdict(int)
        for shapes in different.values():
            for one in shapes:
                counts[one] += 1
        template[host] = {
            one for one, n in counts.items()
            if n >= html_main.LEAST_PAGES and n >= len(different) * (html_main.ARTICLE_SHARE if one[0] else html_main.LEAST_SHARE)
        }
    out = {}
    for page_id, (host, starts) in pages.items():
        text = "".join("\n" + render(s, inside, template[host]) + "\n" for s, inside in starts)
        out[page_id] = "\n".join(x.strip() for x in re.sub(" +", " ", text).split("\n") if x.strip())
    return out


def hosts():
    """Hosts with and without articles, with wrappers, notices inside, and pages that come twice."""
    rows = []
    for i in range(24):
        box = '<div class="x1"><p>Get our letter every week.</p><a href="/s">Yes please</a></div>'
        article = f'<article><div class="entry-header"><h1>Title {i}</h1></div><p>First {i}.</p>{box}<p>Second {i % 5} <b>and</b> more {i}.</p></article>'
        rows += [
            (100 + i, f"https://a.example/{i}", f'<body><div class="layout has-sidebar">{article}<div class="sidebar">Side {i}</div></div></body>'),
            (200 + i, f"https://b.example/{i}", f'<body><p class="c">Our site</p><div><p>Text {i} of the page {i}.</p><p>Part {i % 3}</p></div><ul><li>One<li>Two</ul>'),
            (300 + i, f"https://c.example/{i}", f"<body><article><p>Same for all.</p><h2>Heading</h2>{'x ' * (i % 2)}</article></body>"),
            (400 + i, "https://d.example/", f"<body><main><div>Word {i // 4}</div><span>tail</span> after {i // 4}</main></body>"),
        ]
    return rows


def test_hand_made_hosts_equal_brute_force(spark):
    rows = hosts()
    got, want = texts(spark, rows), brute_force(rows)
    assert got == want
    # The box goes though it stands in an article, the title and the text stay.
    assert got[103] == "Title 3\nFirst 3.\nSecond 3 and more 3."
    assert got[203] == "Text 3 of the page 3."  # "Part 0" stands on a third of the pages
    # Two different pages only: too few for a template.
    assert got[300] == "Same for all.\nHeading"


@pytest.mark.parametrize("least_pages", [2, 5])
def test_all_pages_equal_brute_force(spark, least_pages, monkeypatch):
    monkeypatch.setattr(html_main, "LEAST_PAGES", least_pages)
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url", "html").collect()]
    assert texts(spark, rows, least_pages=least_pages) == brute_force(rows)


CASES = [
    ('<body><article><p title="' + "a > b " * 2000 + '">Long value.</p></article>', "Long value."),
    ('<div class="layout has-sidebar"><article><p>In a wrapper.</p></article></div><div id="page-header-fixed">Top</div>', "In a wrapper."),
    ('<article><div class="entry-header"><h1>The title</h1></div><p>Text.</p></article>', "The title\nText."),
    ('<article><p class="market-share">Ten percent.</p></article>', "Ten percent."),
    ("<article><p>One.</p></article><article><p>Two.</p></article>", "One.\nTwo."),
    ('<div class="related-posts"><article><p>Other story</p></article></div><article><p>This story is longer than that.</p></article>', "This story is longer than that."),
    ('<article><p>Text.</p><div class="comments"><article class="comment">Me too</article></div></article>', "Text."),
    ('<article><div class="ad">Buy</div><div class="cookie-notice">Cookies</div><p>Text &amp; more\n here.</p><aside>x</aside></article>', "Text & more here."),
    ('<body><div class="content promo"><p>All the words of the page are in here.</p></div><div class="promo">Buy</div></body>', "All the words of the page are in here."),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ("<article><p>a" + "<b> </b>" * 20_000 + "b</p></article>", "a b"),
    ("<p>no article</p>", "no article"), ("", ""), (None, ""), ("<article><p", ""), ("<article>a < b</article>", "a < b"),
]


def test_cases(spark):
    rows = [(i, f"https://{i}.example/", html) for i, (html, _) in enumerate(CASES)]
    assert texts(spark, rows) == {i: text for i, (_, text) in enumerate(CASES)}


@pytest.mark.parametrize("token,aside", [
    ("ad", True), ("cookie-notice", True), ("sidebar-left", True), ("social_share", True), ("comment-list", True),
    ("has-sidebar", False), ("entry-header", False), ("market-share", False), ("no-ads", False), ("content", False), ("list", False), ("-", False),
])
def test_whole_names_only(token, aside):
    assert html_main.names_aside(f"first {token}") is aside
