"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from feedloom.llm import orchard, secrets

TEXTS = "select doc_id, coalesce(text, '') as t from documents"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(rank: int, rule: secrets.Rule) -> str:
    pattern = _quoted(rule.pattern)
    return (
        f"select doc_id, {rank} as rank, '{rule.kind}' as kind, {rule.base} as base, {rule.least} as least, "
        f"regexp_split_to_array(t, {pattern}) as pieces, regexp_extract_all(t, {pattern}, 0) as wholes, "
        f"regexp_extract_all(t, {pattern}, {rule.group}) as bodies from texts"
    )


SECRETS = f"""with texts as ({TEXTS}),
matches as ({' union all '.join(_matches(rank, rule) for rank, rule in enumerate(secrets.RULES))}),
placed as (
  select m.*, k.k, list_sum(list_transform(pieces[1:k.k], lambda x: length(x))) + coalesce(list_sum(list_transform(wholes[1:k.k - 1], lambda x: length(x))), 0) as start
  from matches m, lateral (select unnest(range(1, len(m.wholes) + 1)) as k) k where len(m.wholes) > 0
),
spans as (
  select doc_id, rank, kind, base, start, concat(kind, ':', cast(start as bigint), ':', cast(start + length(wholes[k]) as bigint)) as span
  from placed where length(bodies[k]) >= least
),
lists as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
    count(*) filter (kind = 'hex') as n_hex, string_agg(span, ',' order by start, rank) as spans,
    string_agg(span, ',' order by start, rank) filter (base) as base_spans
  from spans group by doc_id
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base_spans, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join lists l on l.doc_id = d.doc_id"""

QUALITY = rf"""with texts as ({TEXTS}),
cut as (
  select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, string_split(t, chr(10)) as ls from texts
),
filled as (select *, list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as fs from cut),
grams as (select c.doc_id, i.i, c.ws[i.i:i.i + 4] as gram from cut c, lateral (select unnest(range(1, len(c.ws) - 3)) as i) i),
twice as (select * from (select *, count(*) over (partition by doc_id, gram) as n from grams) g where n > 1),
covered as (
  select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as p from twice) x group by doc_id
),
figures as (
  select f.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(fs) - len(list_distinct(fs)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(ls) as n_lines,
    length(regexp_replace(t, '[^0-9]', '', 'g')) as digits, len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•‣▪●]'))) as bullets,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) as ellipses
  from filled f left join covered c on c.doc_id = f.doc_id
),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from figures)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or word_chars < 2 * n_words or word_chars > 15 * n_words or 10 * n_symbols > n_words or 10 * n_dup_lines > 3 * n_lines
    or 10 * digits > 3 * word_chars or 10 * bullets > 9 * n_lines or 10 * ellipses > 3 * n_lines) as kept
from judged"""


def _clusters(k: int, rounds: int, dimensions: int, scale: int) -> str:
    """One nearest-centroid table and one table of moved centroids for each round."""
    def nearest(c: int) -> str:
        return (
            f"near{c} as (select r, arg_min(cluster, (d, cluster)) as cluster, min(d) as distance from ("
            f"select p.r, c.cluster, sum((p.x - c.x) * (p.x - c.x))::hugeint as d from parts p join c{c} c using (place) group by all) group by r)"
        )

    steps = [
        f"""kept as (select row_number() over (order by vec_id) as r, vec_id, embedding from embeddings
  where len(embedding) = {dimensions} and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = {dimensions})""",
        f"parts as materialized (select r, unnest(range({dimensions})) as place, unnest(list_transform(embedding, lambda x: floor({scale} * x::double)::bigint)) as x from kept)",
        f"first as (select r, row_number() over (order by sha256('1:' || vec_id)) - 1 as cluster from kept qualify cluster < {k})",
        "c0 as materialized (select cluster, place, x from first join parts using (r))",
        nearest(0).replace("near0 as", "near0 as materialized"),
    ]
    for c in range(1, rounds + 1):
        steps += [
            f"sum{c} as (select cluster, place, sum(x)::hugeint as s, count(*) as n from parts join near{c - 1} using (r) group by all)",
            f"c{c} as materialized (select o.cluster, o.place, coalesce((s - ((s % n) + n) % n) // n, o.x)::bigint as x "
            f"from c{c - 1} o left join sum{c} s on o.cluster = s.cluster and o.place = s.place)",
            nearest(c).replace(f"near{c} as", f"near{c} as materialized"),
        ]
    return f"""with {', '.join(steps)},
names as (select cluster, sha256(string_agg(x::varchar, ',' order by place)) as centroid_sha256 from c{rounds} group by cluster)
select vec_id, cluster::int as cluster, distance::bigint as distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
  (sum(distance) over ())::bigint as inertia, centroid_sha256
from kept join near{rounds} using (r) join names using (cluster)"""


CLUSTERS = _clusters(orchard.CENTROIDS, orchard.ROUNDS, orchard.DIMENSIONS, orchard.SCALE)

#: CRC-32 bit by bit: DuckDB has no such function.
CRC32 = (
    "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)), "
    "lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))))"
)
PREFIXES = f"""
with turns as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as n,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as id, length(coalesce(text, '')) as chars
  from conversations where conv_id is not null),
own as (select c, list(id order by n) as ids, list(chars order by n) as chars, {CRC32} % 6 as h from turns group by c),
whole as (
  select o.c, list_concat(coalesce(b.ids, [])[:o.h], o.ids[o.h + 1:]) as ids, list_concat(coalesce(b.chars, [])[:o.h], o.chars[o.h + 1:]) as chars
  from own o left join own b on b.c = o.c - o.c % 100),
stands as (select c, len(ids) as size, d, ids[:d] as path, if(d = 0, 0, chars[d]) as last from (select *, unnest(range(len(ids) + 1)) as d from whole)),
nodes as (
  select path, d, min(c) as conv_id, count(*) as n_convs, any_value(last) as last,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (d = size), '')) as ends_sha256
  from stands group by path, d),
children as (select path[:d - 1] as path, count(*) as n_children from nodes where d > 0 group by all),
counted as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join children using (path)),
below as (
  select ids[:unnest(range(d + 1))] as path, n_children, (n_convs - 1) * last as saved
  from (select path as ids, d, n_children, n_convs, last from counted)),
sums as (select path, count(*) filter (n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens from below group by path)
select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
from counted n join sums s using (path) left join nodes p on n.d > 0 and p.path = n.path[:n.d - 1]
"""
