"""Main text of web pages by site template removal.

1. Each page is parsed once. Its text comes out as pieces, each with the hashes of the element
   subtrees (tags, classes, words) that it stands in, so that pages travel as text and not as
   html from then on. The parts that HTML itself names as something else (menus, headers,
   footers, sidebars, forms, scripts), or whose class or id does, give no pieces. Where a page
   has articles, only they give pieces.
2. Spark counts on how many different pages of a host each hash stands. A subtree that recurs
   on many of them is the site's template, inside an article only if at least half of the
   host's pages have it.
3. The pieces that stand in a template subtree of their host are deleted, the others joined.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from feedloom.llm.common import staged

#: Different pages of a host on which a subtree recurs at least, and their share of the host's
#: pages, outside and inside an article.
LEAST_PAGES, LEAST_SHARE, ARTICLE_SHARE = 5, 0.1, 0.5

# HTML's element names by their part in the layout.
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_TEXT = frozenset(
    "script style noscript iframe template head nav aside form footer button select textarea dialog menu svg math "
    "object audio video canvas map datalist noembed noframes title".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
#: What an opening tag closes, up to the nearest of the elements in the second place.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
# Words in a class or id that name what isn't main text.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "disclaimer footer header menu modal nav navbar navigation newsletter notice notices popup promo promoted related share "
    "sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that say nothing more when they stand beside one of these, as in ``sidebar-left``.
LAYOUT_WORDS = frozenset(
    "area bar block bottom box button buttons container content group inner items left line link links list main outer page panel "
    "post posts right row section site strip top wrap wrapper".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())

TAG_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
TAG_REST = re.compile(r"""(?:[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+>""")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements inside an article that may be template: not its headings, cells, list items or words.
ARTICLE_PARTS = frozenset("address blockquote div dl figure hr ol p pre section table ul".split())
SPACE = re.compile(r"\s+")
SPACES_ONLY = re.compile(" +")


def names_aside(names: str) -> bool:
    """A class or id that names, as a whole, what isn't main text: ``ad``, ``cookie-notice``,
    ``sidebar-left``, but not ``has-sidebar``, ``entry-header`` or ``market-share``."""
    for token in names.split():
        words = set(token.replace("_", "-").split("-")) - {""}
        if words & ASIDE_WORDS and words <= ASIDE_WORDS | LAYOUT_WORDS:
            return True
    return False


class Node:
    __slots__ = ("aside", "children", "content", "digest", "in_prose", "linked", "named", "names", "tag", "words")

    def __init__(self, tag: str, attributes: str) -> None:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        self.tag, self.names = tag, f"{found.get('class', '')} {found.get('id', '')}".strip().lower()
        self.children: list[Node | str] = []
        self.digest = self.words = self.linked = 0
        self.in_prose = False  # an inline element beside text: a word of a sentence, never template
        self.aside = tag in NOT_TEXT or "hidden" in found or found.get("role", "").lower() in ROLES
        self.named = tag not in ("html", "body") and names_aside(self.names)
        comment = self.named and {"comment", "comments"} & set(re.split(r"[\s_-]+", self.names))
        self.content = not comment and (tag in ("article", "main") or "articlebody" in found.get("itemprop", "").lower())
        if self.content:
            self.named = False


def parse(html: str) -> Node:
    """The tree of a page, however broken: unknown ends are ignored, missing ones implied."""
    root = Node("html", "")
    stack, opened = [root], Counter()  # opened: tags on the stack, so that no vain search walks it

    def close_from(k: int) -> None:
        opened.subtract(node.tag for node in stack[k:])
        del stack[k:]

    at, size = 0, len(html)
    while at < size:
        open_at = html.find("<", at)
        if open_at == -1:
            open_at = size
        if open_at > at:
            stack[-1].children.append(html[at:open_at])
        if open_at == size:
            break
        if html.startswith("<!--", open_at):
            end = html.find("-->", open_at + 4)
            at = size if end == -1 else end + 3
            continue
        named = TAG_NAME.match(html, open_at + 1)
        if not named:
            end = html.find(">", open_at) if html[open_at + 1:open_at + 2] in ("!", "?", "/") else -1
            if end == -1:
                stack[-1].children.append("<")
                at = open_at + 1
            else:
                at = end + 1
            continue
        rest = TAG_REST.match(html, named.end())
        if not rest:
            break  # a tag that is cut off at the end of the page
        end = rest.end() - 1
        tag, at = named[1].lower(), end + 1
        if html[open_at + 1] == "/":
            for k in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[k].tag == tag:
                    close_from(k)
                    break
            continue
        if tag in ("html", "body"):
            if tag == "body":
                close_from(1)
            continue
        closing, limit = CLOSES.get(tag, ({"p"}, {"td", "th", "li", "article", "section", "div", "body", "table"}) if tag in CLOSES_P else ((), ()))
        for k in range(len(stack) - 1, 0, -1) if any(opened[x] > 0 for x in closing) else ():
            if stack[k].tag in limit:
                break
            if stack[k].tag in closing:
                close_from(k)
                break
        node = Node(tag, html[named.end():end])
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            at = size if close is None else close.start()
            if close is None:
                break
            stack.append(node)
            opened[tag] += 1
        elif tag not in VOID and html[end - 1] != "/":
            stack.append(node)
            opened[tag] += 1
    _measure(root)
    return root


def _in_order(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out = [root]
    for node in out:
        out += [child for child in node.children if isinstance(child, Node)]
    return out


def _measure(root: Node) -> None:
    """Hash and word counts of every subtree, leaves first, without recursion."""
    for node in reversed(_in_order(root)):
        parts = [node.tag, node.names]
        prose = any(isinstance(child, str) and child.strip() for child in node.children)
        for child in node.children:
            if isinstance(child, str):
                words = child.split()
                node.words += len(words)
                parts.append(" ".join(words))
            else:
                child.in_prose = prose and child.tag not in BLOCK
                node.words += child.words
                node.linked += child.linked
                parts.append(str(child.digest))
        if node.tag == "a":
            node.linked = node.words
        node.digest = xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "replace"))


def _settle_names(root: Node) -> None:
    """Let a class or id count only where it can: an element with all of the page's articles, or on
    a page without one most of the words that aren't links, is its layout."""
    order, own_words, articles = [], {}, {}
    todo = [root]
    for node in todo:
        if not node.aside:
            order.append(node)
            todo += [child for child in node.children if isinstance(child, Node)]
    for node in reversed(order):
        below = [child for child in node.children if isinstance(child, Node) and not child.aside]
        linked = node.tag == "a"
        text = 0 if linked else sum(len(child.split()) for child in node.children if isinstance(child, str))
        own_words[id(node)] = 0 if linked else text + sum(own_words[id(child)] for child in below)
        articles[id(node)] = (node.tag == "article" and node.content) + sum(articles[id(child)] for child in below)
    for node in order:
        if node.named:
            if articles[id(root)]:
                layout = articles[id(node)] == articles[id(root)]
            else:
                layout = own_words[id(node)] * 2 > own_words[id(root)]
            node.aside = not layout


def regions(root: Node) -> list[Node]:
    """The page's outermost articles; without one its largest main element, else the page."""
    articles, mains, todo = [], [], [root]
    while todo:
        node = todo.pop()
        if node.aside and node is not root:
            continue
        if node.content and node.tag != "main":
            articles.append(node)
            continue
        if node.tag == "main":
            mains.append(node)
        todo += [child for child in reversed(node.children) if isinstance(child, Node)]
    tagged = [node for node in articles if node.tag == "article"]
    return tagged or articles or [max(mains, key=lambda node: node.words, default=root)]


def _signed(digest: int, inside: bool) -> int:
    """A hash as a 64-bit number whose lowest bit says whether it stands inside an article."""
    value = digest & ~1 | inside
    return value - (1 << 64) if value >> 63 else value


def _may_be_template(node: Node, inside: bool) -> bool:
    return bool(node.words) and not node.in_prose and (node.tag in ARTICLE_PARTS if inside else node.tag not in HEADINGS)


class Pieces:
    """The text of a page in order, cut wherever a subtree that may be template begins or ends."""

    def __init__(self) -> None:
        self.parts: list[list[str]] = []
        self.spans: list[list[int]] = []  # hash, first piece, piece after the last
        self.waiting: list[int] = []  # spans that have no text yet
        self.cut = self.broken = True

    def text(self, text: str) -> None:
        if self.broken:
            # The line break stands before the subtrees that begin here.
            self._put("\n")
            self.broken = False
        if self.waiting:
            for span in self.waiting:
                self.spans[span][1] = len(self.parts)
            self.waiting.clear()
            self.cut = True
        self._put(text)

    def _put(self, text: str) -> None:
        if self.cut:
            self.parts.append([])
            self.cut = False
        self.parts[-1].append(text)

    def begin(self, digest: int) -> int:
        self.waiting.append(len(self.spans))
        self.spans.append([digest, -1, -1])
        return len(self.spans) - 1

    def end(self, span: int) -> None:
        if self.waiting and self.waiting[-1] == span:
            self.waiting.pop()  # it has no text of its own
        self.spans[span][2] = len(self.parts)
        self.cut = True


def text_pieces(root: Node) -> Pieces:
    """The main text of a page; white space is one blank, a line break stands between blocks."""
    _settle_names(root)
    out = Pieces()
    for start in regions(root):
        inside = start.content and start.tag != "main"
        out.broken = True
        # A number ends a span; None ends a block.
        todo: list[Node | str | int | None] = [start]
        while todo:
            node = todo.pop()
            if node is None:
                out.broken = True
            elif isinstance(node, int):
                out.end(node)
            elif isinstance(node, str):
                if node:
                    text = SPACE.sub(" ", unescape(node))
                    if text != " " or not out.broken:
                        out.text(text)
            elif node is not start and (node.aside or (node.tag == "header" and not inside)):
                if not out.broken:
                    out.text(" ")
            else:
                if node.tag == "br" and not out.broken:
                    out.text(" ")
                if node is not start and _may_be_template(node, inside):
                    todo.append(out.begin(_signed(node.digest, inside)))
                if node.tag in BLOCK:
                    out.broken = True
                    todo.append(None)
                todo += reversed(node.children)
    out.spans = [span for span in out.spans if 0 <= span[1] < span[2]]
    return out


def kept_text(pieces: list[str], spans: Iterable[tuple[int, int, int]], template: set[int]) -> str:
    """The pieces that stand in no span of a template hash, one line for each block."""
    out, at = [], 0
    for digest, first, end in spans:  # by their begin
        if first >= at and digest in template:
            out += pieces[at:first]
            at = end
    lines = SPACES_ONLY.sub(" ", "".join(out + pieces[at:])).split("\n")
    return "\n".join(line for line in map(str.strip, lines) if line)


PARSED = (
    "row_id bigint, page_id bigint, url string, host string, content bigint, subtrees array<bigint>, "
    "firsts array<int>, ends array<int>, pieces array<string>"
)


def _parse_pages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row_id = TaskContext.get().partitionId() << 33
    for batch in batches:
        spans, pieces = [], []
        for html in batch.column("html"):
            found = text_pieces(parse(html.as_py() or ""))
            spans.append(found.spans)
            pieces.append(["".join(part).encode("utf-8", "replace").decode() for part in found.parts])
        contents = [_signed(xxh3_64_intdigest("".join(p)), False) for p in pieces]
        yield pa.RecordBatch.from_pydict({
            "row_id": pa.array(range(row_id, row_id + batch.num_rows), pa.int64()),
            "page_id": batch.column("page_id"), "url": batch.column("url"), "host": batch.column("host"),
            "content": pa.array(contents, pa.int64()),
            "subtrees": pa.array([[s[0] for s in of_page] for of_page in spans], pa.list_(pa.int64())),
            "firsts": pa.array([[s[1] for s in of_page] for of_page in spans], pa.list_(pa.int32())),
            "ends": pa.array([[s[2] for s in of_page] for of_page in spans], pa.list_(pa.int32())),
            "pieces": pa.array(pieces, pa.list_(pa.string())),
        })
        row_id += batch.num_rows


def _keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("pieces", "subtrees", "firsts", "ends", "template")]
        texts = [
            kept_text(pieces, zip(subtrees, firsts, ends, strict=True), set(template or ()))
            for pieces, subtrees, firsts, ends, template in zip(*columns, strict=True)
        ]
        yield pa.RecordBatch.from_pydict({
            "page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()),
            "n_chars": pa.array([len(text) for text in texts], pa.int64()),
        })


def template_subtrees(parsed: DataFrame, least_pages: int, least_share: float, article_share: float) -> DataFrame:
    """(host, subtree) of the subtrees that recur on enough different pages of their host."""
    once = parsed.select("host", "content", F.explode("subtrees").alias("subtree")).distinct()
    sizes = parsed.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    counts = once.groupBy("host", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    share = F.when(F.col("subtree").bitwiseAND(1) == 1, article_share).otherwise(least_share)
    return counts.join(sizes, "host").filter(F.col("n") >= F.col("pages") * share).select("host", "subtree")


def extract(
    pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, article_share: float = ARTICLE_SHARE
) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    A null page is empty and gives an empty text. Pages with a null url share the empty host.
    Each row is a page of its own; pages of a host with equal text pieces count once for the
    template. Other columns are left out; an empty table gives an empty one.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    parsed = staged(held.mapInArrow(_parse_pages, PARSED), "page-pieces")
    # Both are written before they are joined, so that a subtree or host with very many pages can be split.
    template = staged(template_subtrees(parsed, least_pages, least_share, article_share), "template")
    above = parsed.select("row_id", "host", F.explode(F.array_distinct("subtrees")).alias("subtree"))
    of_page = staged(above.join(template, ["host", "subtree"]).groupBy("row_id").agg(F.collect_list("subtree").alias("template")), "page-template")
    out = parsed.drop("host", "content").join(of_page, "row_id", "left")
    return out.mapInArrow(_keep, "page_id bigint, url string, text string, n_chars bigint")
