"""DuckDB SQL per registered query, over the same views and whole tables.

The texts are written from the rules, not from the Spark plans: page metadata is taken
from the page number instead of the HTML, the command log is replayed with windows
instead of composed functions, and so on.
"""

from __future__ import annotations

from feedloom.plans.corpus import oracle_views
from feedloom.plans.queries import AS_OF, DUE_AT

ORACLES: dict[str, str] = {}


def _iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


_NOW = AS_OF.replace("Z", ".000Z")
_DATETIME = r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
_URL = "^[A-Za-z][A-Za-z0-9+.-]*:.+"
_SOURCES = [f"src_{n}" for n in range(20)]
_CARD = f"""id, slug, source_id, category_id, array_to_string(tags, ',') as tags, language, status,
  {_iso('published_at')} as published_at, {_iso('created_at')} as created_at"""


def _slug(title: str) -> str:
    kept = rf"regexp_replace(lower({title}), '[^A-Za-z0-9_\s-]', '', 'g')"
    return rf"regexp_replace(regexp_replace({kept}, '[\s_]+', '-', 'g'), '-+', '-', 'g')"


def _add(name: str, views: str, body: str, *ctes: str) -> None:
    ORACLES[name] = ",\n".join([oracle_views(*views.split()), *ctes]) + "\n" + body


# Shared steps

_FEED_ITEMS = """feed_items as (
  select item_id, source_id, pos, title, trim(summary) as summary, content, url,
    case when published_at is not null then '2026-07-16T06:00:00.000Z' end as published_at, author, image,
    categories
  from items)"""


def _planned(items: str = "items") -> str:
    return f"""planned as (
  select i.*, s.name as source_name, s.language, cast(length(i.content) as bigint) as rss_length,
    case when s.fetch_strategy in ('RSS_ONLY', 'RSS_PLUS_HTML_FETCH') then s.fetch_strategy
      when length(i.content) >= 1000 then 'RSS_ONLY' else 'RSS_PLUS_HTML_FETCH' end as strategy
  from {items} i join sources s on s.source_id = i.source_id where s.status = 'ACTIVE' and s.type = 'RSS')"""


_FETCHED = r"""page_html as (
  select page_id, url,
    replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') as title,
    regexp_extract(html, '(?s)<article>(.*)</article>', 1) as html
  from pages),
page_text as (
  select *, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'),
    '&[^;]+;', ' ', 'g'), '\s+', ' ', 'g')) as text
  from page_html),
page_words as (
  select *, cast(case when text = '' then 0 else len(string_split(text, ' ')) end as bigint) as word_count
  from page_text),
fetched as (
  select page_id, url, title, html, text, word_count,
    cast(ceil(word_count / 200.0) as bigint) as reading_time_minutes,
    case page_id % 10 when 0 then '' when 1 then trim(substr(text, 1, 160))
      else concat('About page ', page_id) end as excerpt,
    case when page_id % 2 = 0 then concat('page author ', page_id) else '' end as author,
    case when page_id % 3 = 0 then concat('https://img.example.org/hero/', page_id, '.jpg') else '' end
      as hero_image,
    case when page_id % 5 = 0 then null else '2026-07-15T12:00:00.000Z' end as published_at
  from page_words)"""

_MERGED = """merged as (
  select p.item_id, p.source_id, p.pos, p.title as item_title, p.url, p.language, p.strategy, p.rss_length,
    case when f.title <> '' then f.title else p.title end as title,
    case when p.summary <> '' then p.summary else coalesce(f.excerpt, '') end as summary,
    case when f.html <> '' then f.html else p.content end as content,
    coalesce(f.published_at, p.published_at) as published_at,
    case when f.author <> '' then f.author when p.author <> '' then p.author else p.source_name end as author,
    case when f.hero_image <> '' then f.hero_image else p.image end as cover_image,
    cast(coalesce(length(f.html), 0) as bigint) as fetched_length,
    case when f.author <> '' then 'FETCHER' when p.author <> '' then 'RSS' else 'SOURCE_DEFAULT' end
      as author_source,
    case when f.hero_image <> '' then 'FETCHER' when p.image <> '' then 'RSS' else 'NONE' end as image_source,
    case when f.html <> '' then 'FETCHER' else 'RSS' end as content_source
  from planned p left join fetched f on f.url = p.url and p.strategy = 'RSS_PLUS_HTML_FETCH')"""

_ISSUES = f"""issues as (
  select item_id, item_title, 'original.title' as path, 'Original title is required' as message
    from merged where title = ''
  union all select item_id, item_title, 'original.summary', 'Original summary is required'
    from merged where summary = ''
  union all select item_id, item_title, 'original.content', 'Original content is required'
    from merged where content = ''
  union all select item_id, item_title, 'original.url', 'Original URL must be valid'
    from merged where not regexp_matches(url, '{_URL}')
  union all select item_id, item_title, 'original.publishedAt', 'Invalid datetime'
    from merged where not regexp_matches(published_at, '{_DATETIME}'))"""

_CREATED = """created as (
  select *, concat('art_', md5(concat(source_id, '~', url))) as id from merged
  where item_id not in (select item_id from issues)
    and concat('art_', md5(concat(source_id, '~', url))) not in (select id from stored))"""

_CHAIN = (_planned(), _FETCHED, _MERGED)

# Feeds

_add("feed_items", "items", r"""select source_id, item_id // 500 as feed_no,
  row_number() over (partition by source_id, item_id // 500 order by item_id) - 1 as pos, item_id,
  concat('Feed of ', source_id) as feed_title, title, summary, md5(content) as content_md5, url, published_at,
  author, image from feed_items""", _FEED_ITEMS)

_add("feed_fallback", "items sources fallback_map", """select s.source_id, coalesce(n.n, 0) as item_count,
  case when works then s.source_id else m.fallback_id end as chosen_id,
  not works and m.fallback_id is not null as used_fallback,
  case when not works and m.fallback_id is null then concat('Failed to fetch ', s.source_id, ' RSS') end as error
from (select distinct source_id, source_id not in ('src_8', 'src_18') as works from items) s
left join (select source_id, count(*) as n from feed_items group by 1) n on n.source_id = s.source_id
left join fallback_map m on m.source_id = s.source_id""", _FEED_ITEMS)

_KEYS = """keyed as (
  select source_id, unnest([
    'title', 'content:encoded', 'link', 'guid',
    case when summary <> '' then 'content' end, case when summary <> '' then 'contentSnippet' end,
    case when published_at is not null then 'pubDate' end, case when published_at is not null then 'isoDate' end,
    case when author <> '' and item_id % 2 = 0 then 'creator' end,
    case when author <> '' and item_id % 2 = 0 then 'dc:creator' end,
    case when author <> '' and item_id % 2 = 1 then 'author' end,
    case when categories is not null then 'categories' end,
    case when item_id % 6 = 1 then 'media:content' end, case when item_id % 6 = 3 then 'media:thumbnail' end,
    case when item_id % 6 = 5 then 'enclosure' end, case when item_id % 10 = 3 then 'comments' end]) as key
  from feed_items)"""
_add("item_keys", "items", """select source_id, key, count(*) as n_items, key <> 'comments' as is_known
from keyed where key is not null group by source_id, key""", _FEED_ITEMS, _KEYS)
_add("item_extra_keys", "items", """select distinct source_id, 'comments' as extra_keys
from feed_items where item_id % 10 = 3""", _FEED_ITEMS)
_add("image_coverage", "items", """select source_id, count(*) as n_items,
  count(*) filter (item_id % 6 = 1) as media_content, count(*) filter (item_id % 6 = 1) as media_content_url,
  count(*) filter (item_id % 6 = 1) as media_content_width, 0::bigint as media_content_height,
  count(*) filter (item_id % 6 = 1) as media_content_type, 0::bigint as media_content_medium,
  count(*) filter (item_id % 6 = 3) as media_thumbnail, count(*) filter (item_id % 6 = 3) as media_thumbnail_url,
  count(*) filter (item_id % 6 = 3) as media_thumbnail_width,
  count(*) filter (item_id % 6 = 3) as media_thumbnail_height,
  count(*) filter (item_id % 6 = 5) as enclosure, count(*) filter (item_id % 6 = 5) as enclosure_url,
  count(*) filter (item_id % 6 = 5) as enclosure_type, count(*) filter (item_id % 6 = 5) as enclosure_length,
  0::bigint as media_group
from feed_items group by source_id""", _FEED_ITEMS)
_add("first_item_categories", "items", """select source_id, item_id, title,
  cast(coalesce(len(categories), 0) as bigint) as n_categories,
  coalesce(array_to_string(categories[1:5], ', '), '') as first_categories
from items qualify row_number() over (partition by source_id order by pos) = 1""")

# Collection

_add("active_sources", "sources", """select source_id, name, type, url, status, cast(priority as bigint) as priority,
  cast(fetch_interval as bigint) as fetch_interval, language, description,
  coalesce(fetch_strategy, 'AUTO') as fetch_strategy, type = 'RSS' as collectable
from sources where status = 'ACTIVE'""")
_add("sources_by_type", "sources", "select source_id, name, status from sources where type = 'API'")
_add("fetch_strategy", "items sources", """select item_id, source_id, rss_length, strategy,
  case when strategy = 'RSS_PLUS_HTML_FETCH' then 'YES' else 'NO' end as html_fetch,
  case when rss_length >= 1000 then concat('Content length ', rss_length, ' >= 1000 characters')
    else concat('Content length ', rss_length, ' < 1000 characters (truncated/excerpt only)') end as reason
from planned""", _planned())
_add("page_extract", "pages", """select page_id, url, title, md5(html) as html_md5, md5(text) as text_md5, excerpt,
  hero_image, author, published_at, word_count, reading_time_minutes from fetched""",
     "nothing as (select 1)", _FETCHED)
ORACLES["page_extract"] = f"with {_FETCHED}\n" + ORACLES["page_extract"].split(_FETCHED)[1]
_add("merge_articles", "items sources", """select item_id, source_id, title, summary, md5(content) as content_md5, url,
  published_at, author, cover_image, language, strategy, rss_length, fetched_length, author_source, image_source,
  content_source from merged""", *_CHAIN)
_add("collect_log", "items sources", """select item_title as title, strategy,
  case when strategy = 'RSS_PLUS_HTML_FETCH' then 'YES' else 'NO' end as html_fetch, rss_length, fetched_length,
  author_source, image_source, content_source from merged""", *_CHAIN)
_add("rejected_items", "items sources", """select item_id, path, message, 'VALIDATION_ERROR' as error_code,
  400::bigint as status_code from issues""", *_CHAIN, _ISSUES)
_add("rejected_details", "items sources", """select item_id, path, string_agg(message, '; ' order by message) as messages
  from issues group by item_id, path""", *_CHAIN, _ISSUES)
_add("primitive_checks", "items", f"""select item_id, 'uuid' as path, 'Invalid uuid' as message
  from items where item_id % 2 = 1
union all select item_id, 'text', 'Must not be empty' from items where title = ''
union all select item_id, 'date', 'Invalid datetime' from items where not regexp_matches(published_at, '{_DATETIME}')
union all select item_id, 'url', 'Must be a valid URL' from items where not regexp_matches(url, '{_URL}')""")
_ARTICLE = f"""select id, {_slug('title')} as slug, source_id, null::varchar as category_id, 0::bigint as n_tags,
  language, author, cover_image, title, md5(content) as content_md5, url, published_at as original_published_at,
  null::varchar as ai_title, 0::bigint as n_keywords, 'RAW' as status, null::varchar as published_at,
  '{_NOW}' as created_at, '{_NOW}' as updated_at from created"""
_add("new_articles", "items sources stored", _ARTICLE, *_CHAIN, _ISSUES, _CREATED)
_add("scheduled_collect", "items sources stored", _ARTICLE, *_CHAIN, _ISSUES, _CREATED)
_add("article_messages", "items sources stored",
     "select concat(chr(123), '\"articleId\":\"', id, '\"', chr(125)) as value from created",
     *_CHAIN, _ISSUES, _CREATED)

_RUN = (_FEED_ITEMS, _planned("feed_items"), _FETCHED, _MERGED, _ISSUES, _CREATED, """errors as (
  select 'source' as kind, source_id as id, concat('Source ', source_id, ' (', name, '): Feed could not be parsed')
      as message
    from sources where status = 'ACTIVE' and type = 'RSS' and source_id in ('src_8', 'src_18')
  union all
  select distinct 'item', cast(item_id as varchar), concat('Item "', item_title, '": Validation failed') from issues)""")
_add("collect_summary", "items sources stored", """select
  (select count(*) from sources where status = 'ACTIVE') - (select count(*) from errors where kind = 'source')
    as collected_sources,
  (select count(*) from created) as articles_created,
  (select count(*) from errors where kind = 'source') as failed_sources,
  (select count(*) from errors) as error_count""", *_RUN)
_add("collect_errors", "items sources stored", "select kind, id, message from errors", *_RUN)
_add("collect_error_counts", "items sources stored",
     "select kind, count(*) as n_errors from errors group by kind", *_RUN)

_add("feed_stream_articles", "items sources stored", _ARTICLE, *_RUN)
ORACLES["feed_stream_errors"] = ORACLES["collect_errors"]
_add("feed_stream_counters", "items sources stored", """select
  (select count(*) from created) as articles_created,
  (select count(*) from errors where kind = 'source') as failed_sources, (select count(*) from errors) as error_count""", *_RUN)

_SOURCE_ISSUES = f"""source_issues as (
  select page_id, 'name' as path, 'Name is required' as message from source_candidates where name = ''
  union all select page_id, 'type', 'Type is required' from source_candidates where type is null
  union all select page_id, 'type', 'Invalid enum value. Expected ''RSS'' | ''API'', received ''ATOM'''
    from source_candidates where type = 'ATOM'
  union all select page_id, 'url', 'Must be a valid URL' from source_candidates
    where not regexp_matches(url, '{_URL}')
  union all select page_id, 'priority', 'Priority must be >= 1' from source_candidates where priority < 1
  union all select page_id, 'fetchInterval', 'fetchInterval must be > 0' from source_candidates
    where fetch_interval <= 0
  union all select page_id, 'language', 'String must contain at least 1 character(s)' from source_candidates
    where language = ''
  union all select page_id, 'language', 'String must contain at most 10 character(s)' from source_candidates
    where length(language) > 10
  union all select page_id, 'fetchStrategy',
    'Invalid enum value. Expected ''RSS_ONLY'' | ''RSS_PLUS_HTML_FETCH'' | ''AUTO'', received ''SOMETIMES'''
    from source_candidates where fetch_strategy = 'SOMETIMES')"""
_add("new_sources", "source_candidates", f"""select concat('src_', md5(url)) as source_id, name, type, url,
  'ACTIVE' as status, cast(priority as bigint) as priority, cast(coalesce(fetch_interval, 60) as bigint)
    as fetch_interval, language, '' as description, coalesce(fetch_strategy, 'AUTO') as fetch_strategy,
  '{_NOW}' as created_at
from source_candidates where page_id not in (select page_id from source_issues)""", _SOURCE_ISSUES)
_add("rejected_sources", "source_candidates", """select page_id, path, message, 'VALIDATION_ERROR' as error_code,
  400::bigint as status_code from source_issues""", _SOURCE_ISSUES)

# Listing and lookup

_add("articles_by_status", "articles", f"select {_CARD} from articles where status = 'PUBLISHED'")
_add("articles_by_status_page", "articles", f"""select * from (select {_CARD} from articles where status = 'RAW'
order by articles.created_at, id limit 20 offset 20)""")
_add("articles_by_source", "articles", f"select {_CARD} from articles where source_id = 'src_3'")
_add("list_articles", "articles", f"""select * from (select {_CARD}, count(*) over () as total,
  20::bigint as "limit", 0::bigint as "offset" from articles where category_id = 'cat_2'
order by articles.created_at desc, id limit 20)""")
_add("article_details", "articles items", """select a.id, i.title, i.url, md5(i.content) as content_md5
from (select id from articles where status = 'PENDING_REVIEW' order by created_at desc, id limit 20) a
join items i on concat('art_', i.item_id) = a.id""")
_add("list_articles_by_title", "articles", f"""select * from (select {_CARD} from articles
where list_contains(articles.tags, 'tag_2') order by slug, id limit 50 offset 10)""")
_add("list_articles_by_publication", "articles", f"""select * from (select {_CARD} from articles
order by articles.published_at desc nulls last, id limit 100)""")
_add("list_articles_compat", "articles", f"select {_CARD} from articles where status = 'APPROVED'")
_add("article_totals", "articles", "select count(*) as total from articles")
_add("status_totals", "articles", "select status, count(*) as total from articles group by status")
_add("source_totals", "articles", "select source_id, count(*) as total from articles group by source_id")
_add("lookup_ids", "articles commands", """select c.id, a.id is not null as found, a.slug, a.status
from (select distinct article_id as id from commands) c left join articles a on a.id = c.id""")
_add("lookup_sources", "sources fallback_map", """select w.source_id, s.source_id is not null as found, s.name, s.status
from (select distinct fallback_id as source_id from fallback_map) w left join sources s on s.source_id = w.source_id""")


def _answer(offset: int) -> str:
    return f"""select (select count(*) from articles where category_id = 'cat_2') as total, 20::bigint as "limit",
  {offset}::bigint as "offset", coalesce(string_agg(id, ',' order by created_at desc, id), '') as ids
from (select id, created_at from articles where category_id = 'cat_2' order by created_at desc, id limit 20 offset {offset})"""


_add("list_answer", "articles", _answer(5))
_add("list_answer_past_end", "articles", _answer(1_000_000_000))
_NOT_FOUND = """concat('Article with id ''', id, ''' not found') as message, 'NOT_FOUND' as error_code,
  404::bigint as status_code"""
_add("lookup_missing", "articles commands", f"""select id, {_NOT_FOUND}
from (select distinct article_id as id from commands) c where id not in (select id from articles)""")
_FIRST = f"""select * from (select {_CARD} from articles
qualify row_number() over (partition by slug order by articles.created_at, id) = 1)"""
_add("lookup_slug", "articles", _FIRST + " where slug = 'slug-17'")
_add("first_by_slug", "articles", _FIRST)

# Updates, deletes, lifecycle

_PATCH_ISSUES = """patch_issues as (
  select seq, 'slug' as path, 'String must contain at least 1 character(s)' as message from patches where slug = ''
  union all select seq, 'language', 'String must contain at most 10 character(s)' from patches
    where length(language) > 10
  union all select seq, 'status', 'Invalid enum value. Expected ''RAW'' | ''NORMALIZED'' | ''AI_PROCESSING'' | '
    || '''PENDING_REVIEW'' | ''APPROVED'' | ''PUBLISHED'' | ''REJECTED'' | ''ARCHIVED'', received ''PENDING'''
    from patches where status = 'PENDING')"""


def _last(field: str) -> str:
    return f"arg_max({{'v': {field}}}, seq) filter (list_contains(fields, '{field}')) as {field}"


def _patched(field: str) -> str:
    return f"case when p.{field} is not null then p.{field}.v else t.{field} end"


_add("patch_articles", "articles patches", f"""select t.id, {_patched('slug')} as slug, t.source_id,
  {_patched('category_id')} as category_id, array_to_string({_patched('tags')}, ',') as tags,
  {_patched('language')} as language, {_patched('status')} as status, {_iso('t.published_at')} as published_at,
  {_iso('t.created_at')} as created_at,
  case when p.id is not null then '{_NOW}' else {_iso('t.updated_at')} end as updated
from articles t left join combined p on p.id = t.id""", _PATCH_ISSUES, f"""combined as (
  select id, {', '.join(_last(f) for f in ('slug', 'category_id', 'tags', 'language', 'status'))}
  from patches where seq not in (select seq from patch_issues) group by id)""")


def _patched_ai(unnamed_title: str, keywords: str, tokens: str) -> str:
    return f"""select a.id, case when p.seq is null then a.slug when p.seq % 2 = 1 then null else {unnamed_title} end
    as ai_title,
  case when p.seq is null then 'm0' else concat('m', p.seq) end as ai_model,
  case when p.seq is null then a.language else {keywords} end as ai_keywords,
  cast(case when p.seq is null then 3 else {tokens} end as bigint) as ai_tokens,
  case when p.seq is null then {_iso('a.updated_at')} else '{_NOW}' end as updated_at
from articles a left join (select article_id, max(seq) as seq from commands where command = 'publish'
  group by article_id) p on p.article_id = a.id"""


_add("patch_ai_merge", "articles commands", _patched_ai("a.slug", "a.language", "3"))
_add("patch_ai_replace", "articles commands", _patched_ai("null", "''", "null"))
_add("rejected_patches", "patches", """select seq, path, message, 'VALIDATION_ERROR' as error_code,
  400::bigint as status_code from patch_issues""", _PATCH_ISSUES)
_SOURCE_PATCH_ISSUES = f"""patch_issues as (
  select seq, 'name' as path, 'Name is required' as message from source_patches where name = ''
  union all select seq, 'url', 'Must be a valid URL' from source_patches where not regexp_matches(url, '{_URL}')
  union all select seq, 'status', 'Invalid enum value. Expected ''ACTIVE'' | ''INACTIVE'', received ''PAUSED'''
    from source_patches where status = 'PAUSED'
  union all select seq, 'priority', 'Priority must be >= 1' from source_patches where priority < 1
  union all select seq, 'fetchInterval', 'fetchInterval must be > 0' from source_patches where fetch_interval <= 0)"""
_SOURCE_FIELDS = ("name", "url", "status", "priority", "fetch_interval", "fetch_strategy")
_add("patch_sources", "sources source_patches", f"""select t.source_id, {_patched('name')} as name, t.type,
  {_patched('url')} as url, {_patched('status')} as status, cast({_patched('priority')} as bigint) as priority,
  cast({_patched('fetch_interval')} as bigint) as fetch_interval, t.language,
  {_patched('fetch_strategy')} as fetch_strategy,
  case when p.source_id is not null then '{_NOW}' end as updated_at
from sources t left join combined p on p.source_id = t.source_id""", _SOURCE_PATCH_ISSUES, f"""combined as (
  select source_id, {', '.join(_last(f) for f in _SOURCE_FIELDS)}
  from source_patches where seq not in (select seq from patch_issues) group by source_id)""")
_add("rejected_source_patches", "source_patches", """select seq, path, message, 'VALIDATION_ERROR' as error_code,
  400::bigint as status_code from patch_issues""", _SOURCE_PATCH_ISSUES)
_add("delete_articles", "articles delete_ids",
     f"select {_CARD} from articles where id not in (select id from delete_ids)")
_add("delete_missing", "articles delete_ids",
     f"select id, {_NOT_FOUND} from delete_ids where id not in (select id from articles)")
_add("toggle_sources", "sources", """select s.source_id,
  case when coalesce(n, 0) % 2 = 0 then status when status = 'ACTIVE' then 'INACTIVE' else 'ACTIVE' end as status
from sources s left join (select concat('src_', user_id) as source_id, count(*) as n from events
  where event_type = 'click' group by 1) c on c.source_id = s.source_id""")


def _refusal(status: str, command: str, found: str, key: str) -> str:
    return f"""case when not ({found}) then concat('Article with id ''', {key}, ''' not found')
    when {command} = 'publish' and {status} <> 'APPROVED'
      then concat('Cannot publish article in status ', {status}, '. Must be APPROVED.')
    when {command} in ('approve', 'reject') and {status} <> 'PENDING_REVIEW'
      then concat('Cannot ', {command}, ' article in status ', {status}, '. Must be PENDING_REVIEW.')
    when {command} = 'archive' and {status} = 'ARCHIVED' then 'Article is already archived.' end"""


_add("lifecycle_step", "articles commands", "select * from stepped", f"""stepped as (
  select c.article_id, c.seq, c.command, a.status,
    case when a.id is null then null when c.command = 'archive' then 'ARCHIVED'
      when c.command = 'submit' then 'PENDING_REVIEW'
      when c.command = 'publish' and a.status = 'APPROVED' then 'PUBLISHED'
      when c.command = 'approve' and a.status = 'PENDING_REVIEW' then 'APPROVED'
      when c.command = 'reject' and a.status = 'PENDING_REVIEW' then 'REJECTED' else a.status end as new_status,
    case when c.command = 'publish' and a.status = 'APPROVED' then '{_NOW}' else {_iso('a.published_at')} end
      as published_at,
    {_refusal('a.status', 'c.command', 'a.id is not null', 'c.article_id')} as error
  from (select * from commands
    qualify row_number() over (partition by article_id order by ts desc, seq desc) = 1) c
  left join articles a on a.id = c.article_id)""")
ORACLES["lifecycle_apply"] = ORACLES["lifecycle_step"].removesuffix("select * from stepped") + f"""
select a.id, a.slug, a.source_id, a.category_id, array_to_string(a.tags, ',') as tags, a.language,
  coalesce(s.new_status, a.status) as status,
  case when s.article_id is null then {_iso('a.published_at')} else s.published_at end as published_at,
  {_iso('a.created_at')} as created_at,
  case when s.article_id is null then {_iso('a.updated_at')} else '{_NOW}' end as updated
from articles a left join stepped s on s.article_id = a.id and s.error is null"""

# A submit or archive fixes the status whatever came before, so the log falls into
# segments; inside one only the first decision and the first publish after it count.
_REPLAY = ("""numbered as (
  select c.*, a.status as base, row_number() over w as rn,
    count(*) filter (command in ('submit', 'archive')) over w as seg
  from commands c left join articles a on a.id = c.article_id
  window w as (partition by article_id order by ts, seq rows unbounded preceding)),
segmented as (
  select *, case when seg = 0 then base
      when first_value(command) over (partition by article_id, seg order by rn) = 'submit' then 'PENDING_REVIEW'
      else 'ARCHIVED' end as start,
    min(rn) filter (command in ('approve', 'reject')) over (partition by article_id, seg) as decided,
    first_value(command) over (partition by article_id, seg
      order by case when command in ('approve', 'reject') then 0 else 1 end, rn) as decision
  from numbered),
dated as (
  select *, min(case when command = 'publish' and (start = 'APPROVED'
      or (start = 'PENDING_REVIEW' and decision = 'approve' and rn > decided)) then rn end)
      over (partition by article_id, seg) as published_rn
  from segmented),
settled as (
  select *, case when base is null then null
      when rn >= published_rn then 'PUBLISHED'
      when start = 'PENDING_REVIEW' and rn >= decided
        then case when decision = 'approve' then 'APPROVED' else 'REJECTED' end
      else start end as status_after
  from dated)""", """replayed as (
  select *, coalesce(lag(status_after) over (partition by article_id order by rn), base) as status_before
  from settled)""")
_add("lifecycle_replay", "articles commands", f"""select seq, article_id, command, status_before, status_after,
  {_refusal('status_before', 'command', 'base is not null', 'article_id')} as error from replayed""", *_REPLAY)
ORACLES["lifecycle_stream"] = ORACLES["lifecycle_replay"]
_add("lifecycle_final", "articles commands", f"""select a.id, coalesce(r.status, a.status) as status,
  coalesce({_iso('r.published')}, {_iso('a.published_at')}) as published_at
from articles a left join (
  select article_id, arg_max(status_after, rn) as status,
    max(ts) filter (command = 'publish' and status_before = 'APPROVED') as published
  from replayed where base is not null group by article_id) r on r.article_id = a.id""", *_REPLAY)

# Reports

_QUALITY = """quality as (
  select source_id, avg(length(content)) as avg_length from (
    select * from items qualify row_number() over (partition by source_id order by pos) <= 3) group by source_id)"""
_add("source_quality", "items", """select source_id, avg_length, cast(floor(avg_length + 0.5) as bigint)
    as rounded_length, avg_length > 1000 as contains_full_content,
  case when avg_length > 1000 then 'RSS_ONLY' else 'RSS_PLUS_HTML_FETCH' end as strategy,
  case when avg_length > 1000 then 'RSS already contains full article' else 'RSS only contains excerpt' end
    as reason from quality""", _QUALITY)
_COVERAGE = """coverage as (
  select source_id, count(*) as item_count, bool_or(title <> '') as title, bool_or(summary <> '') as summary,
    bool_or(content <> '') as content, bool_or(author <> '') as author, bool_or(image <> '') as image,
    bool_or(published_at is not null) as published_at,
    coalesce(len(arg_min({'c': categories}, pos).c), 0) > 0 as categories
  from items group by source_id)"""
_FIELDS = ("title", "summary", "content", "author", "image", "published_at", "categories")
_add("field_coverage", "items", "\nunion all ".join(
    f"select source_id, '{f}' as field, {f} as available from coverage" for f in _FIELDS), _COVERAGE)


def _side_by_side(long: str) -> str:
    columns = ", ".join(f"max(case when source_id = '{s}' then value end) as {s}" for s in _SOURCES)
    return f"select metric, {columns} from ({long}) m group by metric"


def _metrics(table: str, values: dict[str, str], key: str = "source_id") -> str:
    return "\nunion all ".join(
        f"select {key}, '{m}' as metric, cast({v} as varchar) as value from {table}" for m, v in values.items()
    )


def _yes(flag: str) -> str:
    return f"case when {flag} then 'YES' else 'NO' end"


_add("coverage_report", "items", _side_by_side(_metrics(
    "(coverage join quality using (source_id))",
    {f: _yes(f) for f in _FIELDS} | {"full_content": _yes("avg_length > 1000"), "item_count": "item_count"},
)), _COVERAGE, _QUALITY)
_REPORT = """report as (
  select s.source_id, coalesce(m.strategy, 'N/A') as strategy,
    coalesce(m.strategy = 'RSS_PLUS_HTML_FETCH', false) as html_fetch,
    coalesce(m.rss_length, 0) as rss_length, coalesce(m.fetched_length, 0) as fetched_length,
    cast(coalesce(length(m.content), 0) as bigint) as final_length,
    cast(coalesce(length(m.summary), 0) as bigint) as final_summary_length,
    coalesce(m.author, '') as author, coalesce(m.author_source, 'N/A') as author_source,
    coalesce(m.cover_image <> '', false) as has_image, coalesce(m.image_source, 'N/A') as image_source,
    coalesce((m.strategy = 'RSS_ONLY') = (coalesce(s.fetch_strategy, '') = 'RSS_ONLY'), false) as strategy_match,
    coalesce((m.strategy = 'RSS_ONLY') = (coalesce(s.fetch_strategy, '') = 'RSS_ONLY'), false) as fetch_match
  from sources s left join (
    select * from merged qualify row_number() over (partition by source_id order by pos) = 1) m
  on m.source_id = s.source_id)"""
_add("collection_report", "items sources", "select * from report", *_CHAIN, _REPORT)
_add("collection_side_by_side", "items sources", _side_by_side(_metrics("report", {
    "strategy": "strategy", "html_fetch": _yes("html_fetch"), "rss_length": "rss_length",
    "fetched_length": "fetched_length", "final_length": "final_length",
    "author": "case when author = '' then '(empty)' else author end", "author_source": "author_source",
    "hero_image": _yes("has_image"), "image_source": "image_source", "strategy_match": _yes("strategy_match"),
    "fetch_match": _yes("fetch_match"),
})), *_CHAIN, _REPORT)
_add("collection_verdict", "items sources", """select bool_and(strategy_match) as all_strategy_match,
  bool_and(fetch_match) as all_fetch_match from report""", *_CHAIN, _REPORT)
_FETCHES = """fetches as (
  select i.item_id, f.url is not null as success, coalesce(f.word_count, 0) as word_count,
    coalesce(f.reading_time_minutes, 0) as reading_time_minutes,
    cast(coalesce(length(f.html), 0) as bigint) as html_length,
    cast(coalesce(length(f.text), 0) as bigint) as text_length,
    coalesce(f.hero_image <> '', false) as has_image, coalesce(f.author <> '', false) as has_author,
    f.published_at is not null as has_date, length(i.content) as rss_length
  from items i left join fetched f on f.url = i.url)"""
_add("fetch_report", "items", "select * exclude (rss_length) from fetches", _FETCHED, _FETCHES)
_add("fetch_metrics", "items", _metrics("fetches", {
    "status": _yes("success"), "word_count": "word_count", "reading_time": "concat(reading_time_minutes, ' min')",
    "html_length": "html_length", "text_length": "text_length", "hero_image": _yes("has_image"),
    "author": _yes("has_author"), "published": _yes("has_date"),
}, "item_id"), _FETCHED, _FETCHES)
_add("fetch_counts", "items", """select count(*) filter (success) as succeeded, count(*) filter (not success) as failed
from fetches""", _FETCHED, _FETCHES)
_add("fetch_improvement", "items", """select item_id, cast(rss_length as bigint) as rss_length,
  text_length as fetched_length,
  case when not success then 'FAILED' when rss_length = 0 then 'N/A%'
    else concat(case when text_length < rss_length and round((text_length - rss_length) / rss_length * 100.0) = 0
      then '-' else '' end,
      cast(round((text_length - rss_length) / rss_length * 100.0) as bigint), '%') end as improvement,
  has_image, has_author from fetches""", _FETCHED, _FETCHES)

# Queues, events, schedules

_add("json_bodies", "queue", """select message_id, concat('art_', message_id % 11 * 1000 + message_id % 97) as article_id from queue""")
_ROUTED = """routed as (
  select q.message_id, concat('art_', q.message_id % 11 * 1000 + message_id % 97) as article_id, q.body, a.status as article_status,
    cast(q.receive_count as bigint) as receive_count, q.sent_at,
    case when q.sent_at < (select max(ts) from events) - interval '24' hour then 'EXPIRED'
      when q.receive_count > 3 or (a.id is null and q.receive_count = 3) then 'DEAD_LETTER'
      when a.id is null then 'RETRY' else 'PROCESSED' end as outcome
  from queue q left join articles a on a.id = concat('art_', q.message_id % 11 * 1000 + message_id % 97))"""
_ROUTING = "select message_id, article_id, article_status, receive_count, outcome from routed"
_add("queue_process", "queue articles", _ROUTING, _ROUTED)
_add("queue_stream", "queue articles", _ROUTING, _ROUTED)
_add("queue_retry", "queue articles", """select message_id, body, receive_count + 1 as receive_count
from routed where outcome = 'RETRY'""", _ROUTED)
_add("queue_dead_letters", "queue articles", _ROUTING + """ where outcome = 'DEAD_LETTER'
  and sent_at >= (select max(ts) from events) - interval '7' day""", _ROUTED)
_add("queue_outcomes", "queue articles",
     "select outcome, count(*) as n_messages from routed group by outcome", _ROUTED)
_APPROVED = f"""select c.article_id, a.status,
  case when a.status = 'APPROVED' then 'PUBLISHED' else a.status end as new_status,
  case when a.status = 'APPROVED' then '{_NOW}' else {_iso('a.published_at')} end as published_at,
  {_refusal('a.status', "'publish'", 'a.id is not null', 'c.article_id')} as error
from (select distinct concat('art_', user_id * 7) as article_id from events where event_type = 'purchase') c
left join articles a on a.id = c.article_id"""
_add("approved_events", "articles", _APPROVED)
_add("approved_stream", "articles", _APPROVED)
_REFETCH = f"select url, {_iso('ts')} as fetch_at from fetches"
_FETCHES = """fetches as (
  select url, min(ts) as ts from requests where url is not null and ts is not null group by url
  union all
  select f.url, min(r.ts) as ts from fetches f join requests r on r.url = f.url and r.ts >= f.ts + interval '24' hour group by f.url)"""
for _name in ("url_refetch_24h", "url_refetch_stream"):
    _add(_name, "requests", _REFETCH, _FETCHES)
    ORACLES[_name] = ORACLES[_name].replace("with ", "with recursive ", 1)
_add("due_sources", "sources last_fetch", f"""select s.source_id, cast(s.priority as bigint) as priority,
  {_iso('f.last_fetch')} as last_fetch
from sources s left join last_fetch f on f.source_id = s.source_id
where s.status = 'ACTIVE' and (f.last_fetch is null
  or f.last_fetch + to_minutes(s.fetch_interval) <= timestamp '{DUE_AT.replace('T', ' ').replace('Z', '')}')""")

# Duplicates and dimensions


def _duplicates(key: str) -> str:
    return f"""select item_id, min(item_id) over (partition by k) as original_id, count(*) over (partition by k)
    as copies from (select item_id, {key} as k from items) i"""


_add("duplicate_texts", "items", _duplicates(r"trim(regexp_replace(lower(content), '\s+', ' ', 'g'))"))
_add("duplicate_urls", "items", _duplicates("url"))
_add("tag_counts", "articles tags", """select t.slug, t.name, coalesce(n.n, 0) as article_count
from tags t left join (select tag, count(*) as n from (
  select distinct id, unnest(tags) as tag from articles) x group by tag) n on n.tag = t.slug""")
_add("category_counts", "articles categories", """select c.id, c.name, c.slug, c.is_active,
  (select count(*) from articles a where a.category_id = c.id) as n_articles from categories c where c.is_active""")
_add("article_categories", "articles categories", """select a.id, a.category_id, c.name as category_name
from articles a left join categories c on c.id = a.category_id and c.is_active""")
