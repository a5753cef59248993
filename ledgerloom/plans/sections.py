"""Queries over sections of plain text, chunks that end at line breaks, and values found in texts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import extract
from ..operators import sections as ops
from ..registration import query
from ..tables import table
from .structure import MD, STRIP, _md
from .text import NORM

WORD = r"[\p{L}\p{N}_]"
_s = STRIP.format


def _docs(spark, d):
    return table(spark, d, "documents")


PLAIN = rf"""ln as (select doc_id, unnest(string_split_regex(coalesce(text, ''), '\r\n|[\n\r]')) as line, generate_subscripts(string_split_regex(coalesce(text, ''), '\r\n|[\n\r]'), 1) as n from documents),
l2 as (select doc_id, n, regexp_replace(line, '\s+$', '') as line, {_s('line')} as t from ln),
l3 as (select *, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) as le, length(regexp_replace(t, '[^\p{{Ll}}]', '', 'g')) as sm, len(string_split_regex(t, '\s+')) as w from l2),
l4 as (select *, t <> '' and length(t) <= 90 and (regexp_matches(t, '^[0-9]+(\.[0-9]+){{0,3}}\s*[)\.\-]\s+\S') or regexp_matches(t, '(?i)^[IVXLCDM]{{1,8}}\s*[)\.\-]\s+\S') or regexp_matches(t, '(?i)^(PHẦN|CHƯƠNG|MỤC|CHUYÊN ĐỀ|GIỚI THIỆU)($|[^\p{{L}}\p{{N}}_])')
  or (le >= 6 and (le - sm) * 100 >= le * 85 and w <= 12) or (ends_with(t, ':') and w <= 10)) as head from l3),
l5 as (select *, sum(case when head then 1 else 0 end) over (partition by doc_id order by n) as s from l4),
p1 as (select doc_id, s, arg_min(head, n) as head, arg_min(t, n) as t, {_s('string_agg(line, chr(10) order by n)')} as body from l5 group by doc_id, s),
p2 as (select doc_id, s, {_s("regexp_replace(t, '^#+|#+$', '', 'g')")} as h, head, body from p1 where body <> ''),
p3 as (select doc_id, s, case when head and h <> '' then h else 'Thông tin chung' end as heading, body, case when row_number() over (partition by doc_id order by s) = 1 or length(body) >= 80 then 1 else 0 end as own from p2),
p4 as (select *, sum(own) over (partition by doc_id order by s) - 1 as idx from p3),
plain as (select doc_id, cast(idx as bigint) as idx, arg_min(heading, s) as heading, string_agg(body, chr(10) || chr(10) order by s) as body from p4 group by doc_id, idx)"""


@query("split_plaintext", f"with {PLAIN} select * from plain")
def split_plaintext(spark, d):
    return ops.split_plaintext(_docs(spark, d).select("doc_id", "text"), "doc_id")


LOOKS = r"(regexp_matches(text, '(?m)^#{1,6} \S') or contains(text, chr(10) || '- ') or contains(text, chr(10) || '* ') or contains(text, '|'))"
MARKED = rf"""mln as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents where {LOOKS}),
mse as (select *, sum(case when regexp_matches(line, '^##[ \t]+\S') then 1 else 0 end) over (partition by doc_id order by n) as s from mln),
mpt as (select doc_id, s, string_agg(line, chr(10) order by n) as part from mse group by all),
marked as (select doc_id, row_number() over (partition by doc_id order by s) - 1 as idx, coalesce(nullif(trim(regexp_extract(part, '^##[ \t]+([^\n]+)', 1)), ''), 'Document') as heading, {_s('part')} as body from mpt where trim(regexp_replace(part, '\s+', ' ', 'g')) <> '')"""


@query("split_sections", f"with {PLAIN}, {MARKED} select * from marked union all select plain.* from plain join documents using (doc_id) where not coalesce({LOOKS}, false)")
def split_sections(spark, d):
    return ops.split_sections(_docs(spark, d).select("doc_id", "text"), "doc_id")


@query(
    "chunk_smart",
    r"""with recursive t as (select doc_id, regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\s+|\s+$', '', 'g') as s from documents),
c(doc_id, s, i, a, b) as (
  select doc_id, s, 0, 0, e from (select doc_id, s, case when length(s) <= 800 then length(s) else (select case when n > 0 then 800 - n + 1 when g > 0 then 800 - g + 1 else 800 end from (select strpos(reverse(substring(s, 481, 320)), chr(10)) as n, strpos(translate(reverse(substring(s, 481, 320)), chr(9), ' '), ' ') as g)) end as e from t where s <> '') x
  union all
  select doc_id, s, i + 1, st, case when length(s) <= st + 800 then length(s) else (select case when n > 0 then st + 800 - n + 1 when g > 0 then st + 800 - g + 1 else st + 800 end from (select strpos(reverse(substring(s, st + 481, 320)), chr(10)) as n, strpos(translate(reverse(substring(s, st + 481, 320)), chr(9), ' '), ' ') as g)) end
  from (select doc_id, s, i, b - 100 as st, b from c where b < length(s)) y
), k as (select doc_id, i, regexp_replace(substring(s, a + 1, b - a), '^\s+|\s+$', '', 'g') as text from c)
select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as int) as chunk, text from k where text <> ''""",
)
def chunk_smart(spark, d):
    return ops.chunk_smart(_docs(spark, d), "doc_id")


_MOST, _LEAST = 1500, 300
#: One row a unit, then a walk along each document's units that grows the last piece or begins another.
PACKED = rf"""t as (select doc_id, {_s("coalesce(text, '')")} as t from documents), ps as (select doc_id, i, {_s('p')} as p from (select doc_id, unnest(string_split_regex(t, '\n{{2,}}')) as p, generate_subscripts(string_split_regex(t, '\n{{2,}}'), 1) as i from t where length(t) > {_MOST})),
st as (select doc_id, i, -1 as lane, 0 as j, 0 as k, p as u, 2 as gap, 2 as room from ps where p <> '' and length(p) <= {_MOST}
  union all select doc_id, i, i, j, k, {_s('substring(s, k * 1500 + 1, 1500)')}, 1, 0 from (select doc_id, i, j, {_s('s')} as s from (select doc_id, i, unnest(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(0), 'g'), chr(0))) as s, generate_subscripts(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(0), 'g'), chr(0)), 1) as j from ps where length(p) > {_MOST})), unnest(range(0, cast(ceil(length(s) / {_MOST}.0) as bigint))) as x(k)),
un as (select *, row_number() over (partition by doc_id order by i, j, k) as n from st where u <> ''),
w(doc_id, n, piece, held, lane) as (select doc_id, n, 1, u, lane from un where n = 1
  union all select un.doc_id, un.n, case when un.lane = w.lane and length(held) + gap + length(u) + room <= {_MOST} then piece else piece + 1 end, case when un.lane = w.lane and length(held) + gap + length(u) + room <= {_MOST} then held || case when gap = 2 then chr(10) || chr(10) else ' ' end || u else u end, un.lane from w join un on un.doc_id = w.doc_id and un.n = w.n + 1),
pc as (select doc_id, piece, arg_max(held, n) as text from w group by all union all select doc_id, 1, t from t where length(t) between 1 and {_MOST}),
pm as (select *, max(piece) over (partition by doc_id) as last from pc), pe as (select doc_id, piece, text, last > 1 and arg_max(length(text), piece) over (partition by doc_id) < {_LEAST} as low, last from pm)
select doc_id, cast(least(piece, case when low then last - 1 else last end) - 1 as int) as chunk, string_agg(text, chr(10) || chr(10) order by piece) as text from pe group by all"""


@query("pack_paragraphs", "with recursive " + PACKED)
def pack_paragraphs(spark, d):
    return ops.pack_paragraphs(_docs(spark, d), "doc_id", most=_MOST, least=_LEAST)


SENTENCES = rf"""ss as (select doc_id, {_s('s')} as s, i from (select doc_id, unnest(string_split(x, chr(0))) as s, generate_subscripts(string_split(x, chr(0)), 1) as i from (select doc_id, regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(0), 'g') as x from documents))),
sn as (select doc_id, s, row_number() over (partition by doc_id order by i) as n from ss where s <> ''),
w(doc_id, n, held, out) as (select doc_id, 0::bigint, []::varchar[], []::varchar[] from (select distinct doc_id from sn)
  union all select w.doc_id, sn.n, case when length(s) > 300 then []::varchar[] when length(array_to_string(list_append(held, s), ' ')) <= 300 then list_append(held, s)
    else list_append(list_filter(held, lambda x, i: length(array_to_string(held[i:], ' ')) <= 120 and length(array_to_string(held[i:], ' ')) + 1 + length(s) <= 300), s) end,
    list_concat(case when length(array_to_string(list_append(held, s), ' ')) > 300 and len(held) > 0 then [array_to_string(held, ' ')] else []::varchar[] end, case when length(s) > 300 then list_transform(range(0, cast(ceil((length(s) - 300) / 180.0) as bigint) + 1), lambda i: substring(s, i * 180 + 1, 300)) else []::varchar[] end)
  from w join sn on sn.doc_id = w.doc_id and sn.n = w.n + 1),
ch as (select doc_id, n, 0 as z, unnest(out) as text, generate_subscripts(out, 1) as i from w union all select doc_id, n, 1, array_to_string(held, ' '), 0 from (select *, max(n) over (partition by doc_id) as m from w) where n = m and len(held) > 0)
select doc_id, cast(row_number() over (partition by doc_id order by n, z, i) - 1 as int) as chunk, text from ch"""


@query("chunk_sentences", "with recursive " + SENTENCES)
def chunk_sentences(spark, d):
    return ops.chunk_sentences(_docs(spark, d), "doc_id", size=300, overlap=120)


@query(
    "render_markdown",
    f"""with {PLAIN}, f as (select doc_id, idx, {_s('heading')} as h, {_s('body')} as b, string_split({_s('body')}, chr(10))[1] as first from plain where {_s('body')} <> ''),
r as (select doc_id, idx, '## ' || h || chr(10) || chr(10) || case when lower(strip_accents({_s('first')})) = lower(strip_accents(h)) then {_s('substring(b, length(first) + 2)')} else b end || chr(10) as t from f)
select doc_id, {_s("'# Extracted Markdown: ' || doc_id || chr(10) || chr(10) || string_agg(t, chr(10) order by idx)")} || chr(10) as text from r group by doc_id""",
)
def render_markdown(spark, d):
    return ops.render_markdown(split_plaintext(spark, d), "doc_id")


_ENT = f"coalesce(({NORM.format('s.title')}), '')"


@query(
    "relevant_lines",
    rf"""with {MD}, s as (select page_id, text, string_split_regex(text, '\r\n|[\n\r]') as ls, list_filter(string_split({NORM.format('left(text, 60)')}, ' '), lambda x: x <> '')[1:2] as ws from md),
l as (select page_id, unnest(ls) as line, generate_subscripts(ls, 1) as n, ws from s), m as (select *, {NORM.format('line')} as nl from l),
h as (select page_id, n, line, len(list_filter(ws, lambda w: contains(nl, w))) > 0 as hit from m),
k as (select *, hit or coalesce(lag(hit) over w, false) or coalesce(lag(hit, 2) over w, false) as kept, regexp_matches(line, '(?i)(₫|vnd|dong|trieu|tr|thang|tháng|tuan|tuần|ielts|toeic|a1|a2|b1|b2|c1|c2)') as money from h window w as (partition by page_id order by n)),
a as (select *, bool_or(kept) over (partition by page_id) as named, sum(case when money then 1 else 0 end) over (partition by page_id order by n) as nm from k),
o as (select page_id, coalesce({_s("string_agg(line, chr(10) order by n) filter (((named and kept) or (not named and money and nm <= 16)) and " + _s('line') + " <> '')")}, '') as t from a group by page_id)
select page_id, case when length(t) > 2200 then regexp_replace(left(t, 2200), '\s+$', '') || chr(10) || '...[TRUNCATED]...' else t end as lines from o""",
)
def relevant_lines(spark, d):
    entity = F.array_join(F.slice(F.filter(F.split(ops.norm_ascii(F.substring("text", 1, 60)), " "), lambda w: w != ""), 1, 2), " ")
    return _md(spark, d).select("page_id", ops.relevant_lines(F.col("text"), entity).alias("lines"))


LINE = "select l_orderkey, l_linenumber, case l_linenumber % 4 when 0 then ' ' || cast(l_quantity as int) || ',5 Triệu đồng' when 1 then cast(cast(floor(l_extendedprice) as bigint) as varchar) || '.000 VND' when 2 then 'free' end as v from lineitem"


@query("parse_tuition", rf"select l_orderkey, l_linenumber, case when contains(lower(v), 'triệu') then floor(cast(replace(regexp_extract(v, '[0-9]+,[0-9]+'), ',', '.') as double) * 1000000) when regexp_replace(v, '[^0-9]', '', 'g') <> '' then cast(regexp_replace(v, '[^0-9]', '', 'g') as double) end as tuition from ({LINE})")
def parse_tuition(spark, d):
    kind = F.col("l_linenumber") % 4
    v = F.when(kind == 0, F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(",5 Triệu đồng"))).when(kind == 1, F.concat(F.floor("l_extendedprice").cast("long").cast("string"), F.lit(".000 VND"))).when(kind == 2, "free")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", extract.parse_tuition(v).alias("tuition"))


SAID = "t as (select doc_id, text || case doc_id % 5 when 0 then ' CAMBRIDGE, british  council' when 1 then ' ets.' when 2 then ' 500 đồng, jets' else '' end as text from documents)"


def _said(spark, d):
    i = F.col("doc_id") % 5
    return _docs(spark, d).select("doc_id", F.concat("text", F.when(i == 0, " CAMBRIDGE, british  council").when(i == 1, " ets.").when(i == 2, " 500 đồng, jets").otherwise("")).alias("text"))


def _any(pairs):
    return ", ".join(f"case when regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){p}($|[^\\p{{L}}\\p{{N}}_])') then '{n}' end" for n, p in pairs)


@query("extract_partners", f"with {SAID} select doc_id, array_to_string(list_filter([{_any(extract.PARTNERS)}], lambda x: x is not null), ',') as partners from t")
def extract_partners(spark, d):
    return _said(spark, d).select("doc_id", F.array_join(extract.extract_partners(F.col("text")), ",").alias("partners"))


@query("is_commercial", f"with {SAID}, n as (select doc_id, text, {NORM.format('text')} as n from t) select doc_id, contains(text, '₫') or contains(n, 'hoc phi') or contains(n, 'vnd') or contains(n, 'dong') or contains(n, 'trieu') as commercial from n")
def is_commercial(spark, d):
    return _said(spark, d).select("doc_id", extract.is_commercial(F.col("text")).alias("commercial"))


ASKED = "t as (select doc_id, lower(text || case doc_id % 4 when 0 then ' need Python, data analyst 3 năm' when 1 then ' 12 years of JAVA; googleui, C++ and c#' when 2 then ' Go/net' else '' end) as text from documents)"
_KNOWN = ", ".join(f"case when regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_]){re.escape(s)}($|[^\\p{{L}}\\p{{N}}_])') then '{s.title()}' end" for s in extract.SKILLS)


@query("candidate_criteria", rf"with {ASKED} select doc_id, array_to_string(list_filter([{_KNOWN}], lambda x: x is not null), ',') as skills, try_cast(nullif(regexp_extract(text, '([0-9]+)\s*(?:năm|nam|year|yr|yrs|tuổi|tuoi)', 1), '') as bigint) as min_exp from t")
def candidate_criteria(spark, d):
    i = F.col("doc_id") % 4
    asked = F.concat("text", F.when(i == 0, " need Python, data analyst 3 năm").when(i == 1, " 12 years of JAVA; googleui, C++ and c#").when(i == 2, " Go/net").otherwise(""))
    return _docs(spark, d).select("doc_id", extract.candidate_criteria(asked).alias("c")).select("doc_id", F.array_join("c.skills", ",").alias("skills"), "c.min_exp")


@query(
    "guess_name",
    r"""with t as (select doc_id, case doc_id % 3 when 0 then 'Resume of' || chr(10) || 'Lê Van 3rd' || chr(10) else '' end || text as text, 'cv_' || source || '-a.pdf' as file from documents),
l as (select doc_id, file, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r\n|[\n\r]'), lambda x: trim(x)), lambda x: x <> '')[1:5] as ls from t),
f as (select doc_id, file, list_filter(ls, lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) between 2 and 5 and len(list_filter(string_split_regex(x, '\s+'), lambda w: regexp_matches(w, '^\p{L}+$') and not regexp_matches(w, '^\p{Lu}'))) = 0
  and not regexp_matches(lower(x), 'curriculum|resume|cv|tóm tắt|hồ sơ|ứng viên'))[1] as name from l)
select doc_id, coalesce(name, array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(file, '\.[^.]*$', ''), '[-_]', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')) as name from f""",
)
def guess_name(spark, d):
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, "Resume of\nLê Van 3rd\n").otherwise(""), F.col("text"))
    return _docs(spark, d).select("doc_id", extract.guess_name(text, F.concat(F.lit("cv_"), F.col("source"), F.lit("-a.pdf"))).alias("name"))


@query("policy_eligibility", "select o_orderkey, n_regionkey <> 2 and o_orderkey % 9 <= n_regionkey * 2 as refund, coalesce(o_orderkey % 70 >= 5 + n_regionkey, true) and coalesce(case when n_regionkey <> 3 then o_orderkey % 70 <= 60 - n_nationkey end, true) as age_fits from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def policy_eligibility(spark, d):
    policies = table(spark, d, "nation").select("n_nationkey", (F.col("n_regionkey") != 2).alias("refunds"), (F.col("n_regionkey") * 2).alias("sessions"), (F.col("n_regionkey") + 5).alias("least"), F.when(F.col("n_regionkey") != 3, 60 - F.col("n_nationkey")).alias("most"))
    asked = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(policies, F.col("c_nationkey") == F.col("n_nationkey"))
    return asked.select("o_orderkey", extract.refund_eligible(F.col("refunds"), F.col("sessions"), F.col("o_orderkey") % 9).alias("refund"), extract.age_eligible(F.col("o_orderkey") % 70, F.col("least"), F.col("most")).alias("age_fits"))


@query("merge_memory", """select doc_id, case when doc_id % 2 = 0 then lang else source end as who, case when doc_id % 2 = 0 then null else lang end as "where", case when doc_id % 2 = 0 then 'p' || doc_id end as phone,
  case when doc_id % 3 = 0 then null else 'x' end as deep, case when doc_id % 3 = 0 then 'leaf' end as top, case when doc_id % 3 = 1 then 'under' end as under from documents""")
def merge_memory(spark, d):
    """Values, nulls that win, a leaf that replaces a tree, and a tree that replaces a leaf."""
    even, third = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3
    base = F.create_map(F.lit("who"), F.col("source"), F.lit("where"), F.col("lang"), F.lit("a.b"), F.lit("x"), F.lit("c"), F.lit("y"))
    one = F.when(even, F.create_map(F.lit("who"), F.col("lang"), F.lit("phone"), F.concat(F.lit("p"), F.col("doc_id")), F.lit("where"), F.lit(None).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    two = F.when(third == 0, F.create_map(F.lit("a"), F.lit("leaf"))).when(third == 1, F.create_map(F.lit("c.d"), F.lit("under"))).otherwise(F.create_map().cast("map<string,string>"))
    m = _docs(spark, d).select("doc_id", extract.merge_memory(base, F.map_concat(one, two)).alias("m"))
    return m.select("doc_id", *[F.col("m")[k].alias(n) for k, n in (("who", "who"), ("where", "where"), ("phone", "phone"), ("a.b", "deep"), ("a", "top"), ("c.d", "under"))])
