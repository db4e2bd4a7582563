"""Article queries: filters, ordering, paging, counts and lookups.

Pages are ordered on narrow rows: project away ``original`` and ``ai`` first and get the
wide records of the page with ``page_details``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.joins import MAX_WIDE_BROADCAST_ROWS, probe_join
from feedloom.schemas import DEFAULT_PAGE_LIMIT
from feedloom.sources.store import run_dir, stage

DEEP_PAGE_ROWS = 100_000

ORDER_COLUMNS = {"createdAt": "created_at", "publishedAt": "published_at", "title": "slug"}


def filter_articles(
    articles: DataFrame,
    status: str | None = None,
    source_id: str | None = None,
    category_id: str | None = None,
    tag: str | None = None,
    compat: bool = False,
) -> DataFrame:
    """All given filters together. ``compat`` keeps the older precedence: a status filter
    alone decides, then a source filter alone, and only then category and tag."""
    if compat and status:
        source_id = category_id = tag = None
    elif compat and source_id:
        category_id = tag = None
    if status:
        articles = articles.filter(F.col("status") == status)
    if source_id:
        articles = articles.filter(F.col("source_id") == source_id)
    if category_id:
        articles = articles.filter(F.col("category_id") == category_id)
    if tag:
        articles = articles.filter(F.array_contains("tags", tag))
    return articles


def order_by(field: str, direction: str = "ASC") -> list[Column]:
    """Sort columns. A missing publication date sorts as '' would; title sorts by slug in
    Unicode order; the id makes the order total."""
    name = ORDER_COLUMNS[field]
    key = F.collate(F.col(name), "UNICODE") if name == "slug" else F.col(name)
    first = key.desc_nulls_last() if direction == "DESC" else key.asc_nulls_first()
    return [first, F.col("id").asc()]


def page(df: DataFrame, order: list[Column], limit: int | None, offset: int = 0) -> DataFrame:
    """Ordered slice; no limit or limit 0 means everything after the offset.

    Up to ``DEEP_PAGE_ROWS`` each task keeps its first rows in memory; a deeper page is cut
    from a sorted table by the row counts of its ranges.
    """
    if limit and offset + limit > DEEP_PAGE_ROWS:
        return deep_page(df, order, limit, offset)
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit else out


def deep_page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """Ordered slice at any offset: the rows are sorted in ranges and written once; the counts of
    the ranges, one row each, give every row its position."""
    numbered = df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id())
    numbered = stage(numbered, run_dir(df.sparkSession, "page")).withColumn("_range", F.shiftright("_row", 33))
    counts = numbered.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.col("_row") - F.shiftleft("_range", 33)
    placed = numbered.join(F.broadcast(starts), "_range").withColumn("_position", F.col("_start") + inside)
    wanted = placed.filter((F.col("_position") >= offset) & (F.col("_position") < offset + limit))
    return wanted.orderBy("_position").select(*df.columns)


def list_articles(
    articles: DataFrame,
    *,
    status: str | None = None,
    source_id: str | None = None,
    category_id: str | None = None,
    tag: str | None = None,
    order_field: str = "createdAt",
    direction: str = "DESC",
    limit: int | None = DEFAULT_PAGE_LIMIT,
    offset: int = 0,
    compat: bool = False,
) -> DataFrame:
    """One page of articles. In ``compat`` mode status and source listings come in
    creation order whatever order is asked for."""
    rows = filter_articles(articles, status, source_id, category_id, tag, compat)
    if compat and (status or source_id):
        order_field, direction = "createdAt", "ASC"
    return page(rows, order_by(order_field, direction), limit, offset)


def count_articles(
    articles: DataFrame,
    status: str | None = None,
    source_id: str | None = None,
    category_id: str | None = None,
    tag: str | None = None,
    compat: bool = False,
) -> DataFrame:
    """Number of matching articles; in ``compat`` mode category and tag do not count."""
    if compat:
        category_id = tag = None
    rows = filter_articles(articles, status, source_id, category_id, tag, compat)
    return rows.agg(F.count(F.lit(1)).alias("total"))


def article_page(articles: DataFrame, *, limit: int = DEFAULT_PAGE_LIMIT, offset: int = 0, **options) -> DataFrame:
    """A page whose rows also carry ``total``, ``limit`` and ``offset``."""
    filters = {k: v for k, v in options.items() if k not in ("order_field", "direction")}
    total = count_articles(articles, **filters).scalar()
    rows = list_articles(articles, limit=limit, offset=offset, **options)
    return rows.withColumns({
        "total": total,
        "limit": F.lit(limit).cast("long"),
        "offset": F.lit(offset).cast("long"),
    })


def article_answer(articles: DataFrame, *, limit: int = DEFAULT_PAGE_LIMIT, offset: int = 0, **options) -> DataFrame:
    """One row ``(total, limit, offset, items)``: the page as an array in its order.

    A page past the end, and a listing without a match, give an empty array and the total.
    Needs a limit, which bounds the array.
    """
    if limit < 1:
        raise ValueError("an answer needs a limit")
    rows = list_articles(articles, limit=limit, offset=offset, **options)
    placed = rows.select(F.monotonically_increasing_id().alias("_place"), F.struct(*articles.columns).alias("_item"))
    items = F.transform(F.sort_array(F.collect_list(F.struct("_place", "_item"))), lambda x: x["_item"])
    filters = {k: v for k, v in options.items() if k not in ("order_field", "direction")}
    return placed.agg(items.alias("items")).select(
        count_articles(articles, **filters).scalar().alias("total"),
        F.lit(limit).cast("long").alias("limit"),
        F.lit(offset).cast("long").alias("offset"),
        "items",
    )


def find_by_status(articles: DataFrame, status: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    return page(filter_articles(articles, status=status), order_by("createdAt"), limit, offset)


def find_by_source(articles: DataFrame, source_id: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    return page(filter_articles(articles, source_id=source_id), order_by("createdAt"), limit, offset)


def count_by(articles: DataFrame, column: str) -> DataFrame:
    """Articles per status or per source in one pass."""
    return articles.groupBy(column).agg(F.count(F.lit(1)).alias("total"))


def find_ids(table: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """The wanted ids with their rows; an unknown id keeps a row of nulls (``found`` false)."""
    ids = wanted.select(key).distinct()
    joined = probe_join(ids, table, key, F.col(key), max_rows=MAX_WIDE_BROADCAST_ROWS)
    rest = [F.col(f"hit.{c}").alias(c) for c in table.columns if c != key]
    return joined.select(key, *rest, F.col("hit").isNotNull().alias("found"))


def page_details(page_rows: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Wide rows of one page of any length: a semi join with its keys, so that the wide rows
    themselves are never sorted."""
    return table.join(page_rows.select(key).distinct(), key, "left_semi")


def find_by_slug(articles: DataFrame, slug: str) -> DataFrame:
    """Earliest article of a slug: zero or one row."""
    first = F.min_by(F.struct(*articles.columns), F.struct("created_at", "id"))
    hit = articles.filter(F.col("slug") == slug).agg(first.alias("_a"))
    return hit.filter(F.col("_a").isNotNull()).select("_a.*")


def first_per_slug(articles: DataFrame) -> DataFrame:
    """Earliest article of every slug; slugs are not unique."""
    keys = articles.select("slug", "created_at", "id")
    first = keys.groupBy("slug").agg(F.min(F.struct("created_at", "id")).alias("_a")).select("slug", "_a.id")
    mine = articles["slug"].eqNullSafe(first["slug"]) & (articles["id"] == first["id"])
    return articles.join(first, mine, "left_semi")


def first_elements(c: Column, n: int = 5) -> Column:
    """First ``n`` array elements as comma separated text; null gives ''."""
    return F.array_join(F.coalesce(F.slice(c, 1, n), F.array().cast("array<string>")), ", ")
