"""SQL over whole tables for the operators that it can express in fair time, written without the operators' methods."""

from __future__ import annotations

from .secrets import BASE, RULES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every 100-byte string of every document, in order; those that came before cover their bytes.
OP2_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, p, substring(h, 2 * p + 1, 200) as s from d, unnest(range(0, length(h) // 2 - 99)) as u(p)),
r as (select doc_id, p, row_number() over (partition by s order by doc_id, p) as n from w),
g as (select doc_id, p, case when p > lag(p) over (partition by doc_id order by p) + 100 or lag(p) over (partition by doc_id order by p) is null then 1 else 0 end as fresh from r where n > 1),
k as (select doc_id, p, sum(fresh) over (partition by doc_id order by p) as run from g),
runs as (select doc_id, run, min(p) as a, max(p) + 100 as b from k group by doc_id, run),
cut as (select doc_id, run, a, b, coalesce(lag(b) over (partition by doc_id order by run), 0) as was from runs),
kept as (select doc_id, string_agg(substring(h, 2 * was + 1, 2 * (a - was)), '' order by run) || substring(any_value(h), 2 * max(b) + 1) as k, sum(b - a) as gone, count(*) as n from cut join d using (doc_id) group by doc_id)
select doc_id, length(h) // 2 as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(n, 0) as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256 from d left join kept using (doc_id)
"""

OP5_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as g from w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as u(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select x.doc_id as a, y.doc_id as b, count(*) as inter from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * inter >= 90 * (x.n + y.n - inter)),
r(doc_id, node) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on r.node = e.a)
select r.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(node) as component_id from r left join n using (doc_id) group by r.doc_id
"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
with i as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark where item_id is not null),
win as (select distinct item, least(13, len(w)) as n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') as g from i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as u(p) where len(w) > 0),
d as (select doc_id, {_WORDS} as w from documents),
dg as (select doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') as g from d, (select distinct n from win) s, unnest(range(1, len(w) - n + 2)) as u(p)),
hit as (select doc_id, p, n, item from dg join win using (n, g)),
hw as (select doc_id, count(distinct q) as n_hit from hit, unnest(range(p, p + n)) as u(q) group by doc_id),
hi as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hit group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
from d left join hw using (doc_id) left join hi using (doc_id)
"""


def _op9() -> str:
    parts = []
    for k, r in enumerate(RULES):
        p = "'" + r.pattern.replace("'", "''") + "'"
        sizes = "list_transform({}, lambda x: length(x))"
        parts.append(
            f"select doc_id, {k} as rank, '{r.kind}' as kind, coalesce(list_sum({sizes.format('gap[1:i]')}), 0) + coalesce(list_sum({sizes.format('got[1:i - 1]')}), 0) as a, length(got[i]) as n, length(held[i]) as held, {r.least} as least "
            f"from (select doc_id, string_split_regex(text, {p}) as gap, regexp_extract_all(text, {p}, 0) as got, regexp_extract_all(text, {p}, {r.group}) as held from documents where regexp_matches(text, {p})), unnest(range(1, len(got) + 1)) as u(i)"
        )
    spans = "string_agg(kind || ':' || cast(a as bigint) || ':' || cast(a + n as bigint), ',' order by a, rank)"
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in BASE)
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE)
    return f"""
with m as ({' union all '.join(parts)}), f as (select * from m where held >= least),
g as (select doc_id, {counts}, {spans} filter (kind in ({base})) as b, {spans} as s from f group by doc_id)
select doc_id, {zeros}, sha256(coalesce(b, '')) as base_sha256, coalesce(s, '') as spans from documents left join g using (doc_id)
"""


OP9_SQL = _op9()
