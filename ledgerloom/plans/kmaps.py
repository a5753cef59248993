"""Queries over knowledge maps; pages stand for documents, with lines on courses, prices, dates and rules added to their sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract
from ..operators import courses, enrich, kmaps
from ..registration import query
from ..tables import table
from .courses import _sections
from .structure import SECTIONS, STRIP
from .text import NORM, _contains_any

#: What is added to a section, by its number: both engines make the same text of it.
HEADING = "CASE idx % 5 WHEN 1 THEN 'Học phí' WHEN 2 THEN 'Lịch khai giảng' WHEN 3 THEN 'Chính sách' ELSE {} END"
LINES = "{} || chr(10) || CASE idx % 5 WHEN 0 THEN 'chuong trinh TOEIC ' || {} % 3 || chr(10) || 'Cambridge 6 thang' WHEN 1 THEN '- IELTS A: 8.500.000 vnd / 4 thang' || chr(10) || 'TOEIC 1: 6,5 tr' WHEN 2 THEN 'IELTS A: khai giang 5/6' WHEN 3 THEN 'Hoan phi: IELTS A, TOEIC 750' ELSE 'lop Giao tiep 2' || chr(10) || 'IELTS A' END"
KS = SECTIONS + f", ks as (select page_id as doc, idx, {HEADING.format('heading')} as heading, {LINES.format('body', 'page_id')} as body from sc)"


def _ks(spark, d):
    s = _sections(spark, d)
    return s.select("doc", "idx", F.expr(HEADING.format("heading")).alias("heading"), F.expr(LINES.format("body", "doc")).alias("body"))


_s = STRIP.format
_UN = r"regexp_replace(" + _s("{}") + r", '(?i)^\s*([0-9]+(\.[0-9]+){{0,3}}|[ivxlcdm]{{1,8}})\s*[).\-:]\s*', '')"
_LOW = "lower(replace(replace(strip_accents({}), 'đ', 'd'), 'Đ', 'D'))"
_list = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
DISCOVER = rf"""{KS}, nm as (
  select doc, idx, 1 as kind, 0 as pos, heading as raw, {_s(_UN.format('heading'))} as name from ks
  union all select doc, idx, 2, i, x, {_s('x')} from (select doc, idx, unnest(regexp_extract_all(body, '(?im)\b(khoa\s*hoc|chuong\s*trinh|lop)\s+([^\n]{{3,80}})$', 2)) as x, generate_subscripts(regexp_extract_all(body, '(?im)\b(khoa\s*hoc|chuong\s*trinh|lop)\s+([^\n]{{3,80}})$', 2), 1) as i from ks)
  union all select doc, idx, 3, i, x, {_s('x')} from (select doc, idx, unnest(regexp_extract_all(body, '(?m)^\s*[-*]?\s*([^\n:]{{3,80}})\s*:\s+\S.+$', 1)) as x, generate_subscripts(regexp_extract_all(body, '(?m)^\s*[-*]?\s*([^\n:]{{3,80}})\s*:\s+\S.+$', 1), 1) as i from ks)),
n2 as (select *, {_LOW.format(_UN.format(_s('raw')))} as n, replace({NORM.format('name')}, ' ', '_') as eid from nm),
n3 as (select * from n2 where length(n) >= 3 and n not in {_list(kmaps.GENERIC_HEADINGS)} and ({_contains_any('n', kmaps.ENTITY_WORDS)} or (len(string_split_regex({_s('n')}, '\s+')) <= 8 and regexp_matches(n, '\p{{L}}'))) and eid <> '' and eid not in {_list(kmaps.GENERIC_HEADINGS)}),
n4 as (select doc, eid as entity_id, arg_min(name, kind * 1000000000::bigint + idx * 100000 + pos) as entity from n3 group by doc, eid),
de as (select doc, entity_id, entity from (select *, row_number() over (partition by doc order by entity_id) as r from n4) where r <= 24)"""


@query("discover_entities", DISCOVER + " select * from de")
def discover_entities(spark, d):
    return kmaps.discover_entities(_ks(spark, d))


_W = "list_distinct(list_filter(string_split({}, ' '), lambda x: x <> ''))"
PICKED = f"""{DISCOVER}, en as (select distinct doc, entity, {NORM.format('entity')} as en from de where entity_id <> '{kmaps.GENERAL}'), ss as (select doc, idx, {NORM.format('heading')} as hn, {NORM.format('left(body, 2000)')} as b2, {NORM.format('left(body, 3000)')} as bn from ks),
jo as (select doc, entity, idx, en, hn, bn, len(list_intersect({_W.format('en')}, {_W.format('hn')})) as ih, len(list_intersect({_W.format('en')}, {_W.format('b2')})) as ib from en join ss using (doc) where en <> ''),
so as (select doc, entity, idx, 3 * ih + ib + case when contains(hn, en) then 6 else 0 end + case when contains(bn, en) then 2 else 0 end + {' + '.join(f"case when ib > 0 and {_contains_any('hn', w)} then 1 else 0 end" for w in courses.BOOSTS)} as score from jo),
pk as (select * from (select doc, entity, idx, row_number() over (partition by doc, entity order by score desc, idx) as rank from so where score > 0) where rank <= 6),
kd as (select *, case when {_contains_any('hn', courses.TUITION_WORDS)} then 'tuition' when {_contains_any('hn', courses.SCHEDULE_WORDS)} then 'schedule' when {_contains_any('hn', courses.POLICY_WORDS)} then 'policy' else 'general' end as kind from (select *, {NORM.format('heading')} as hn from ks))"""


def _lines(name: str, source: str, most: int) -> str:
    """CTEs that end in ``name``: ``source`` (rid, body, entity, ...) with the lines that concern the entity as ``cut``."""
    body = rf"string_split_regex(body, '\r\n|[\n\r]')"
    return rf"""{name}_a as (select rid, {_W.format(NORM.format('entity'))} as ws, unnest({body}) as line, generate_subscripts({body}, 1) as n from {source}),
{name}_b as (select rid, n, line, len(list_filter(ws, lambda w: contains(nl, w))) > 0 as hit from (select *, {NORM.format('line')} as nl from {name}_a)),
{name}_c as (select *, hit or coalesce(lag(hit) over w, false) or coalesce(lag(hit, 2) over w, false) as kept, regexp_matches(line, '(?i)(₫|vnd|dong|trieu|tr|thang|tháng|tuan|tuần|ielts|toeic|a1|a2|b1|b2|c1|c2)') as money from {name}_b window w as (partition by rid order by n)),
{name}_d as (select *, bool_or(kept) over (partition by rid) as named, sum(case when money then 1 else 0 end) over (partition by rid order by n) as nm from {name}_c),
{name}_e as (select rid, coalesce({_s("string_agg(line, chr(10) order by n) filter (((named and kept) or (not named and money and nm <= " + str(most) + ")) and " + _s('line') + " <> '')")}, '') as t from {name}_d group by rid),
{name} as (select s.*, {_cut('t', 2200)} as cut from {source} s join {name}_e using (rid))"""


def _cut(col: str, size: int) -> str:
    return rf"case when length({col}) > {size} then regexp_replace(left({col}, {size}), '\s+$', '') || chr(10) || '...[TRUNCATED]...' else {col} end"


_KINDS = " ".join(f"when '{k}' then '{v}'" for k, v in kmaps.ADDED.items())
ADDED = f"""{PICKED}, ms as (select e.doc, e.entity, k.kind from (select distinct doc, entity from pk) e, (values {', '.join(f"('{k}')" for k in kmaps.ADDED)}) k(kind) where not exists (select 1 from pk join kd using (doc, idx) where pk.doc = e.doc and pk.entity = e.entity and kd.kind = k.kind)),
sl as (select ms.doc, ms.entity, ms.kind, kd.idx, kd.body, row_number() over () as rid from ms join kd on ms.doc = kd.doc and ms.kind = kd.kind), {_lines('sk', 'sl', 14)},
sj as (select doc, entity, kind, {_s('string_agg(cut, chr(10) order by idx)')} as b from sk where cut <> '' group by all), ad as (select doc, entity, kind, case kind {_KINDS} end as heading, {_cut('b', 2200)} as body from sj)"""


def _picked(spark, d):
    s = _ks(spark, d)
    return kmaps.entity_sections(kmaps.discover_entities(s).where(F.col("entity_id") != kmaps.GENERAL), s), s


@query("supplement_kinds", ADDED + " select * from ad")
def supplement_kinds(spark, d):
    picked, s = _picked(spark, d)
    return kmaps.supplement_kinds(picked, s)


CONTEXT = f"""{ADDED}, bo as (select pk.doc, pk.entity, pk.rank as pos, kd.heading, kd.body, kd.kind from pk join kd using (doc, idx) union all select doc, entity, case kind when 'tuition' then 1000 when 'schedule' then 1001 else 1002 end, heading, body, kind from ad),
bx as (select *, row_number() over () as rid from bo), {_lines('ck', 'bx', 16)},
cx as (select doc, entity, {_s("string_agg('[' || coalesce(nullif(" + _s('heading') + ", ''), '" + kmaps.NO_HEADING + "') || ']' || chr(10) || case when kind <> 'general' then cut else " + _s('body') + " end, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by pos)")} as ctx from ck group by doc, entity)"""


@query("entity_context", CONTEXT + f" select doc, entity, {_cut('ctx', 12000)} as context from cx")
def entity_context(spark, d):
    picked, s = _picked(spark, d)
    return kmaps.entity_context(picked, kmaps.supplement_kinds(picked, s), s)


_num = lambda pattern: rf"list_sort(list_distinct(list_transform(regexp_extract_all(ctx, '{pattern}', 1), lambda x: cast(replace(x, ',', '.') as double))))"
_MONEY = r"list_sort(list_distinct(list_concat(list_filter(list_transform(regexp_extract_all(ctx, '(?i)(?:^|\s)([0-9][0-9., ]{4,}\s*(?:đ|vnd|dong)\b)', 1), lambda x: case when length(regexp_replace(x, '[^0-9]', '', 'g')) >= 5 then cast(regexp_replace(x, '[^0-9]', '', 'g') as bigint) end), lambda x: x is not null), list_transform(regexp_extract_all(ctx, '(?i)\b([0-9]+(?:[.,][0-9]+)?)\s*(?:tr|tri[eệ]u)\b', 1), lambda x: cast(round_even(cast(replace(x, ',', '.') as double) * 1000000, 0) as bigint)))))"
_PARTNERS = ", ".join(f"case when regexp_matches(ctx, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){p}($|[^\\p{{L}}\\p{{N}}_])') then '{n}' end" for n, p in extract.PARTNERS)
_show = lambda col: f"array_to_string(list_transform({col}, lambda x: cast(x as varchar)), ', ')"
MAPS = rf"""{CONTEXT}, us as (select distinct doc, idx from pk), gn as (select kd.* from kd anti join us using (doc, idx) where kind = 'general' and {_s('body')} <> ''),
fb as (select * from (select kd.*, row_number() over (partition by doc order by idx) as r from kd where doc not in (select doc from pk) and doc not in (select doc from gn)) where r <= 10),
gx as (select doc, {_s("string_agg('[' || coalesce(nullif(" + _s('heading') + ", ''), '" + kmaps.NO_HEADING + "') || ']' || chr(10) || body, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by idx)")} as ctx from (select doc, idx, heading, body from gn union all select doc, idx, heading, body from fb) group by doc),
rw as (select de.doc, de.entity_id, de.entity, ctx, false as general from de join cx using (doc, entity) where entity_id <> '{kmaps.GENERAL}' union all select doc, '{kmaps.GENERAL}', '{kmaps.GENERAL_NAME}', ctx, true from gx),
ev as (select *, list_filter([{_PARTNERS}], lambda x: x is not null) as ps, {_num(r'(?i)\b([0-9]+(?:[.,][0-9]+)?)\s*(?:thang|tháng)\b')} as mo, {_MONEY} as vn, {_num(r'(?i)\bielts\s*([0-9](?:[.,][0-9])?)\b')} as ie, {_num(r'(?i)\btoeic\s*([0-9]{3,4})\b')} as tc, {NORM.format('ctx')} as nc from rw),
pc as (select *, array_to_string(list_filter([case when len(mo) > 0 then 'thời lượng ' || {_show('mo')} || ' tháng' end, case when len(vn) > 0 then 'học phí ' || array_to_string(list_transform(vn[1:3], lambda v: replace(format('{{:,}}', v), ',', '.')), ', ') || ' VND' end, case when len(ie) > 0 then 'mục tiêu IELTS ' || {_show('ie')} end, case when len(tc) > 0 then 'mục tiêu TOEIC ' || {_show('list_transform(tc, lambda x: cast(x as int))')} end], lambda x: x is not null), '; ') as pieces from ev)
select doc, entity_id, {_s("'Thực thể: ' || entity || case when len(ps) > 0 then chr(10) || 'Đối tác liên quan: ' || array_to_string(ps, ', ') else '' end || case when pieces <> '' then chr(10) || 'Tóm tắt nhanh: ' || pieces || '.' else '' end || chr(10) || chr(10) || 'Thông tin liên quan (trích từ tài liệu):' || chr(10) || case when ctx <> '' then ctx else '" + kmaps.NOTHING + "' end")} as cluster,
  array_to_string(ps, ',') as partners, {_show('mo')} as months, {_show('vn')} as tuition, not general and (contains(ctx, '₫') or {_contains_any('nc', extract.MONEY_WORDS)}) as commercial from pc"""


def _maps(spark, d):
    s = _ks(spark, d)
    return kmaps.heuristic_maps(kmaps.discover_entities(s), s)


@query("heuristic_maps", MAPS)
def heuristic_maps(spark, d):
    """One job from sections to maps."""
    shown = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit(""))
    return _maps(spark, d).select("doc", "entity_id", "cluster", F.array_join("partners", ",").alias("partners"), shown("evidence.duration_months").alias("months"), shown("evidence.tuition_vnd").alias("tuition"), "commercial")


@query("normalize_maps", "select p_partkey, replace(lower(p_brand), '#', '_') as entity_id, trim(p_name) as cluster, coalesce(case when p_size % 3 = 0 then p_size % 2 = 0 end, true) as commercial, case when p_size % 2 = 0 then 1 else 0 end as n_partners from part where p_size % 7 <> 0")
def normalize_maps(spark, d):
    z = F.col("p_size")
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), F.col("p_brand")).alias("entity_id"), F.when(z % 7 == 0, " \n").otherwise(F.concat(F.col("p_name"), F.lit(" "))).alias("cluster"), F.when(z % 3 == 0, z % 2 == 0).alias("commercial"), F.when(z % 2 == 0, F.array("p_brand")).alias("partners"))
    return kmaps.normalize_maps(rows).select("p_partkey", "entity_id", "cluster", "commercial", F.size("partners").alias("n_partners"))


@query("run_stats", "select count(distinct user_id) as docs_total, count(distinct user_id) filter (event_type in ('click', 'view')) as docs_with_attempt, count(*) filter (event_type in ('click', 'view')) as calls, count(*) filter (event_type = 'click') as success, count(*) filter (event_type <> 'click') as fallback_entities from events")
def run_stats(spark, d):
    e = F.col("event_type")
    return kmaps.run_stats(table(spark, d, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("entity_id"), e.isin("click", "view").alias("called"), (e == "click").alias("succeeded")))


def _score(bucket: str) -> str:
    words = enrich.BUCKETS[bucket]
    hits = lambda c: "(" + " + ".join(f"case when contains({c}, '{w}') then 2 + least(8, (length({c}) - length(replace({c}, '{w}', ''))) // {len(w)}) else 0 end" for w in words) + ")"
    return f"{hits('t')} + 2 * {hits('h')}"


_TEXT = "lower(strip_accents(replace(replace({}, chr(13) || chr(10), chr(10)), chr(13), chr(10))))"
BUCKETS = rf"""{KS}, bt as (select doc, idx, heading, body, {_TEXT.format('heading')} as h, {_TEXT.format('heading')} || chr(10) || {_TEXT.format('body')} as t from ks),
bs as (select doc, idx, heading, body, cast({_score('course_info')} as double) as course_info, cast({_score('tuition')} + case when regexp_matches(t, '(^|[^\p{{L}}\p{{N}}_])(vnd|đ|dong|trieu)($|[^\p{{L}}\p{{N}}_])') or regexp_matches(t, '[0-9][0-9., ]{{3,}}\s*(đ|vnd|dong)') then 6 else 0 end as double) as tuition, cast({_score('policy')} as double) as policy,
  cast({_score('schedule')} + case when regexp_matches(t, '\b[0-9]{{1,2}}[/-][0-9]{{1,2}}([/-][0-9]{{2,4}})?\b') or contains(t, 'khai giang') then 5 else 0 end + case when regexp_matches(t, '\b[0-9]{{1,2}}[:h][0-9]{{0,2}}\b') then 2 else 0 end as double) as schedule from bt),
bu as ({' union all '.join(f"select doc, idx, heading, body, '{b}' as bucket, {b} as raw, round({b} - 0.7 * greatest({', '.join(x for x in enrich.BUCKETS if x != b)}), 6) as adjusted from bs" for b in enrich.BUCKETS)}),
br as (select * from (select *, cast(row_number() over (partition by doc, bucket order by adjusted desc, idx) as int) as rank from bu where adjusted > 0) where rank <= 4),
bx as (select doc, bucket, {_s("string_agg('[' || heading || '] (score=' || cast(cast(raw as bigint) as varchar) || ', adj=' || format('{:.1f}', adjusted) || ')' || chr(10) || body, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank)")} as text from br group by doc, bucket)"""


@query("bucket_sections", BUCKETS + " select doc, bucket, rank, idx, raw, adjusted from br")
def bucket_sections(spark, d):
    return enrich.bucket_sections(_ks(spark, d))


@query("bucket_texts", BUCKETS + " select doc, bucket, text from bx")
def bucket_texts(spark, d):
    s = _ks(spark, d)
    return enrich.bucket_texts(enrich.bucket_sections(s), s)


#: Documents that follow the template in part: their own text stands under the numbers.
OUTLINE = "'Mở đầu' || chr(10) || CASE doc_id % 4 WHEN 0 THEN 'Mục 5: khóa học' || chr(10) || text || chr(10) || '  muc 06 hoc phi' || chr(10) || 'x' || chr(10) || 'MỤC 7' || chr(10) || '8) chinh sach' || chr(10) || lang || chr(10) || '9. y' || chr(10) || '10. lich' || chr(10) || source WHEN 1 THEN '5. only' || chr(10) || source || chr(10) || '15. no' ELSE text END"
TEMPLATE = f"ou as (select doc_id as doc, {OUTLINE} as text, text as own, lang, source from documents)"
TEMPLATED = f"""{TEMPLATE}, te as (select doc, b.bucket, {_s("case doc % 4 when 0 then case b.bucket when 'course_info' then 'Mục 5: khóa học' || chr(10) || own when 'tuition' then 'muc 06 hoc phi' || chr(10) || 'x' when 'policy' then '8) chinh sach' || chr(10) || lang else '10. lich' || chr(10) || source end when 1 then case when b.bucket = 'course_info' then '5. only' || chr(10) || source || chr(10) || '15. no' else '' end else case when b.bucket = 'course_info' then text else '' end end")} as text from ou, (values ('course_info'), ('tuition'), ('policy'), ('schedule')) b(bucket))"""


def _template(spark, d):
    return enrich.template_buckets(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.expr(OUTLINE).alias("text")))


@query("numbered_section", f"with {TEMPLATED} select * from te")
def numbered_section(spark, d):
    return _template(spark, d)


@query("fill_missing_buckets", f"with {TEMPLATED}, n as (select *, sum(case when text = '' then 1 else 0 end) over (partition by doc) as n from te) select doc, bucket, case when text = '' and n >= 2 then case when doc % 3 = 0 then '' else bucket || doc end else text end as text from n")
def fill_missing_buckets(spark, d):
    t = _template(spark, d)
    other = t.where("doc % 3 <> 0").select("doc", "bucket", F.concat("bucket", F.col("doc").cast("string")).alias("text"))
    return enrich.fill_missing_buckets(t, other)


@query("normalize_courses", """select p_partkey, p_brand as tenant, case p_partkey % 3 when 0 then lower(p_brand) || ':c' || p_partkey else p_brand || ':' || 'c_' || p_partkey end as course_id, p_name as content, case when p_size % 2 = 0 then p_type else p_brand end as category,
case p_size % 3 when 0 then cast(p_partkey * 1000 as double) when 1 then floor((p_size + 0.5) * 1000000) end as tuition, case when p_size % 4 = 0 then 'May' else 'Liên hệ để cập nhật lịch mới nhất' end as next_opening from part where p_size % 11 <> 0 and p_size % 13 <> 0""")
def normalize_courses(spark, d):
    z, k = F.col("p_size"), F.col("p_partkey")
    rows = table(spark, d, "part").select(
        F.col("p_brand").alias("tenant"), F.when(z % 11 == 0, " ").when(k % 3 == 0, F.concat(F.lower("p_brand"), F.lit(":c"), k.cast("string"))).otherwise(F.concat(F.lit("C -"), k.cast("string"), F.lit("!"))).alias("course_id"), F.when(z % 13 == 0, "\n").otherwise(F.concat(F.lit(" "), F.col("p_name"))).alias("content"),
        F.when(z % 2 == 0, F.col("p_type")).alias("category"), F.when(z % 3 == 0, F.concat(k.cast("string"), F.lit(".000 VND"))).when(z % 3 == 1, F.concat(z.cast("string"), F.lit(",5 triệu"))).alias("tuition"), F.when(z % 4 == 0, "May").alias("next_opening"),
    )
    return enrich.normalize_courses(rows).withColumn("p_partkey", F.regexp_extract("course_id", "([0-9]+)$", 1).cast("long"))
