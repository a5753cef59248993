"""Queries over entities, courses, fees and discounts; parts stand for courses, orders for requests, lines for discounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import courses as ops
from ..operators import structure
from ..registration import query
from ..tables import table
from .structure import SECTIONS
from .text import NORM, _contains_any


def _sections(spark, d):
    md = table(spark, d, "pages").select("page_id", structure.html_to_markdown(F.col("html")).alias("text"))
    return structure.parse_sections(md, "page_id").withColumnRenamed("page_id", "doc")


def _entities(sections):
    """The first two words of each heading name the document's entities."""
    name = F.array_join(F.slice(F.split(F.trim("heading"), " +"), 1, 2), " ")
    return sections.where("heading <> ''").select("doc", name.alias("entity")).distinct()


@query("section_kind", f"with h as (select doc_id, case doc_id % 4 when 0 then 'Học phí ' when 1 then 'Lịch học ' when 2 then 'Chính sách ' else 'About ' end || lang as h from documents), n as (select doc_id, {NORM.format('h')} as n from h) select doc_id, case when {_contains_any('n', ops.TUITION_WORDS)} then 'tuition' when {_contains_any('n', ops.SCHEDULE_WORDS)} then 'schedule' when {_contains_any('n', ops.POLICY_WORDS)} then 'policy' else 'general' end as kind from n")
def section_kind(spark, d):
    i = F.col("doc_id") % 4
    head = F.concat(F.when(i == 0, "Học phí ").when(i == 1, "Lịch học ").when(i == 2, "Chính sách ").otherwise("About "), "lang")
    return table(spark, d, "documents").select("doc_id", ops.section_kind(head).alias("kind"))


@query("extract_phone", "select o_orderkey, case o_orderkey % 4 when 0 then '09' || lpad(cast(o_custkey as varchar), 8, '1') when 1 then '03' || lpad(cast(o_custkey as varchar), 8, '2') when 2 then '02' || lpad(cast(o_custkey as varchar), 9, '3') end as phone from orders")
def extract_phone(spark, d):
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    said = F.when(k == 0, F.concat(F.lit("goi +84 9"), F.lpad(c, 8, "1"), F.lit(" nhe"))).when(k == 1, F.concat(F.lit("so: 03"), F.lpad(c, 8, "2"))).when(k == 2, F.concat(F.lit("02"), F.lpad(c, 9, "3"))).otherwise(F.concat(F.lit("id 04"), F.lpad(c, 8, "4")))
    return table(spark, d, "orders").select("o_orderkey", ops.extract_phone(said).alias("phone"))


WORDS = "list_distinct(list_filter(string_split({}, ' '), lambda x: x <> ''))"
SCORED = SECTIONS + f""", en as (select distinct page_id, array_to_string(regexp_split_to_array(trim(heading), ' +')[1:2], ' ') as entity from sc where heading <> ''),
ee as (select page_id, entity, {NORM.format('entity')} as en from en), ss as (select page_id, idx, {NORM.format('heading')} as hn, {NORM.format('left(body, 2000)')} as b2, {NORM.format('left(body, 3000)')} as bn from sc),
jo as (select ee.page_id as doc, entity, idx, en, hn, bn, len(list_intersect({WORDS.format('en')}, {WORDS.format('hn')})) as ih, len(list_intersect({WORDS.format('en')}, {WORDS.format('b2')})) as ib from ee join ss using (page_id) where en <> ''),
sr as (select doc, entity, idx, cast(3 * ih + ib + case when contains(hn, en) then 6 else 0 end + case when contains(bn, en) then 2 else 0 end + {' + '.join(f"case when ib > 0 and {_contains_any('hn', w)} then 1 else 0 end" for w in ops.BOOSTS)} as double) as score from jo)"""


@query("score_entity_sections", SCORED + " select * from sr")
def score_entity_sections(spark, d):
    s = _sections(spark, d)
    return ops.score_entity_sections(_entities(s), s)


@query("top_sections", SCORED + ", t as (select *, cast(row_number() over (partition by doc, entity order by score desc, idx) as int) as rank from sr where score > 0) select * from t where rank <= 6")
def top_sections(spark, d):
    s = _sections(spark, d)
    return ops.top_sections(ops.score_entity_sections(_entities(s), s))


@query("general_sections", SECTIONS + f", k as (select page_id as doc, idx, {NORM.format('heading')} as n from sc where idx % 2 = 0 and body <> ''), g as (select doc, idx, cast(row_number() over (partition by doc order by idx) as int) as rank from k where not ({_contains_any('n', ops.TUITION_WORDS)} or {_contains_any('n', ops.SCHEDULE_WORDS)} or {_contains_any('n', ops.POLICY_WORDS)})) select * from g")
def general_sections(spark, d):
    s = _sections(spark, d)
    return ops.general_sections(s, s.where("idx % 2 = 1")).select("doc", "idx", "rank")


@query("refine_fees", "with f as (select o_orderkey, cast(floor(o_totalprice * 10) as bigint) * (o_orderkey % 2) as b, cast(floor(o_totalprice * 20) as bigint) as e from orders), s as (select o_orderkey, case when b > 0 and b < 1000000 then 0 else b end as b, case when b > 0 and b < 1000000 then e + b else e end as e from f) select o_orderkey, case when b = 0 and e >= 1000000 then e else b end as base, case when b = 0 and e >= 1000000 then 0 else e end as extra from s")
def refine_fees(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.floor(F.col("o_totalprice") * 10) * (F.col("o_orderkey") % 2)).alias("base"), F.floor(F.col("o_totalprice") * 20).alias("extra"))
    return ops.refine_fees(o)


@query("labelled_fee", "with v as (select o_custkey, (o_orderkey % 5) * 1000400 as v from orders where o_orderkey % 5 > 0), r as (select o_custkey, case when v < 2000000 and v % 1000 <> 0 then cast(round_even(v / 1000.0, 0) * 1000 as bigint) else v end as v from v), n as (select o_custkey, v, count(*) as n from r group by all) select o_custkey, arg_max(v, n * 100000000 + v) as fee from n group by o_custkey")
def labelled_fee(spark, d):
    o = table(spark, d, "orders").select("o_custkey", ((F.col("o_orderkey") % 5) * 1000400).alias("amount"))
    return ops.labelled_fee(o, "o_custkey")


TOKENS = "list_distinct(list_filter(string_split({}, ' '), lambda t: length(t) >= 3 and t not in (" + ", ".join(f"'{w}'" for w in ops.COURSE_STOP) + "))[1:6])"


@query("match_course", f"with q as (select s_suppkey as query, unnest({TOKENS.format(NORM.format('s_name'))}) as t from supplier), p as (select n_nationkey as course, unnest({TOKENS.format(NORM.format(chr(39) + 'supplier ' + chr(39) + ' || n_name'))}) as t from nation), h as (select query, course, count(*) as hits from q join p using (t) group by all), r as (select *, row_number() over (partition by query order by hits desc, course) as r from h) select query, course, hits from r where r = 1")
def match_course(spark, d):
    q = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query"), F.col("s_name").alias("text"))
    return ops.match_course(q, table(spark, d, "nation").select(F.col("n_nationkey").alias("course"), F.concat(F.lit("supplier "), "n_name").alias("name")))


@query("recommend_course", "with q as (select c_custkey as query, c_nationkey as tenant, cast(c_custkey % 12 as double) as target, c_custkey % 9 * 1000000 as budget from customer), c as (select p_partkey as course, p_partkey % 25 as tenant, cast(p_size as double) / 4 as months, cast(floor(p_retailprice) as bigint) * 3000 as fee from part), f as (select query, course, greatest(0, cast(trunc(10 - abs(months - target) * 3) as int)) + greatest(0, cast(trunc((budget - fee) / 1000000) as int)) as score from q join c using (tenant) where months <= target + 0.25 and fee <= budget), r as (select *, row_number() over (partition by query order by score desc, course) as r from f) select query, course, score from r where r = 1")
def recommend_course(spark, d):
    k = F.col("c_custkey")
    q = table(spark, d, "customer").select(k.alias("query"), F.col("c_nationkey").alias("tenant"), (k % 12).cast("double").alias("target"), (k % 9 * 1000000).alias("budget"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("course"), (F.col("p_partkey") % 25).alias("tenant"), (F.col("p_size") / 4).alias("months"), (F.floor("p_retailprice") * 3000).alias("fee"))
    return ops.recommend_course(q, p)


@query("compare_entities_summary", "select p_brand, min(cast(floor(p_retailprice) as bigint)) as fee_from, max(cast(floor(p_retailprice) as bigint)) as fee_to, min(p_size) as months_from, max(p_size) as months_to, string_agg(distinct p_type, ',' order by p_type) as targets from part group by p_brand")
def compare_entities_summary(spark, d):
    p = table(spark, d, "part").select("p_brand", F.floor("p_retailprice").alias("fee"), F.col("p_size").alias("months"), F.col("p_type").alias("target"))
    return ops.compare_entities_summary(p, "p_brand")


POLICY = "po as (select distinct c_mktsegment as tenant from customer), ef as (select tenant, case when substring(tenant, 1, 1) in ('A', 'B', 'F') then 'combinable' else 'highest_only' end as stacking, case when substring(tenant, 1, 1) in ('A', 'B', 'F') then 12.0::double else 100.0::double end as max_percent, case when substring(tenant, 1, 1) in ('A', 'B', 'F') then tenant else '_default' end as origin from po)"


def _policy(spark, d):
    tenants = table(spark, d, "customer").select(F.col("c_mktsegment").alias("tenant")).distinct()
    own = tenants.where(F.substring("tenant", 1, 1).isin("A", "B", "F")).select("tenant", F.lit("combinable").alias("stacking"), F.lit(12.0).alias("max_percent"))
    return ops.effective_policy(tenants, own, {"stacking": "highest_only", "max_percent": 100.0})


@query("effective_policy", f"with {POLICY} select * from ef")
def effective_policy(spark, d):
    return _policy(spark, d)


LINES = "li as (select l_orderkey as request, c_mktsegment as tenant, case when l_linenumber % 2 = 0 then round(l_discount * 100) end as percent, case when l_linenumber % 2 = 1 then cast(floor(l_quantity) as bigint) end as amount from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)"


@query("resolve_discounts", f"with {POLICY}, {LINES} select request, least(coalesce(case when any_value(stacking) = 'combinable' then sum(percent) else max(percent) end, 0), any_value(max_percent)) as percent, cast(coalesce(case when any_value(stacking) = 'combinable' then sum(amount) else max(amount) end, 0) as bigint) as amount from li join ef using (tenant) group by request")
def resolve_discounts(spark, d):
    seg = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("tenant"))
    req = table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), "o_custkey").join(seg, "o_custkey").drop("o_custkey")
    even = F.col("l_linenumber") % 2 == 0
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request"), F.when(even, F.round(F.col("l_discount") * 100)).alias("percent"), F.when(~even, F.floor("l_quantity")).alias("amount"))
    return ops.resolve_discounts(li.join(req, "request"), _policy(spark, d))


@query("price_range", "with p as (select l_orderkey as request, cast(floor(l_extendedprice) as bigint) as price from lineitem), r as (select request, min(price) as low, max(price) as high from p group by request) select *, case when low = high then low end as final from r")
def price_range(spark, d):
    return ops.price_range(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request"), F.floor("l_extendedprice").alias("price")))


#: A part's text names one of 300 courses of its brand: its duration, and its fee behind the colon, on the next line, after a line without one, or cut off by a blank line.
COURSE_TEXT = "'Mục lục' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '1.' || (1 + p_partkey % 9) || '. Khóa X' || (p_partkey % 300) || '  Pro (' || (1 + p_size % 12) || ',5 tháng)' || chr(10) ELSE '' END || 'Hoc phi khoa x' || (p_partkey % 300) || ' pro:' || CASE p_partkey % 5 WHEN 0 THEN ' ' || (1 + p_size) || '.500.000 VND' WHEN 1 THEN chr(10) || (2 + p_size) || ' tr' WHEN 2 THEN ' xem dưới' || chr(10) || 'giá 500k' || chr(10) || 'hay ' || (3 + p_size) || '.100.000' WHEN 3 THEN chr(10) || chr(10) || '9 tr' ELSE ' ' || (p_size) || '00k' END"
FEES = """n as (select p_partkey as pos, p_brand as tenant, p_partkey % 300 as c, p_size as z, p_partkey % 5 as k from part),
fe as (select tenant, pos, 'x' || c || ' pro' as key, cast(case k when 0 then (1 + z) * 1000000 + 500000 when 1 then (2 + z) * 1000000 when 2 then (3 + z) * 1000000 + 100000 when 4 then z * 100000 end as bigint) as fee from n where k <> 3 and (k <> 4 or z >= 10))"""


def _course_texts(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("tenant"), F.col("p_partkey").alias("pos"), F.expr(COURSE_TEXT).alias("text"))


@query("course_fees", f"with {FEES} select * from fe")
def course_fees(spark, d):
    return ops.course_fees(_course_texts(spark, d))


@query("course_catalog", f"with {FEES}, lf as (select tenant, key, arg_max(fee, pos) as fee from fe group by all), du as (select tenant, 'khoa x' || c || ' pro' as key, arg_max(1.5 + z % 12, pos) as months from n where pos % 3 = 0 group by all) select coalesce(du.tenant, lf.tenant) as tenant, coalesce(du.key, lf.key) as key, case when du.key is not null then 'Khoa X' || regexp_extract(du.key, '[0-9]+') || ' Pro' else 'X' || regexp_extract(lf.key, '[0-9]+') || ' Pro' end as name, cast(months as double) as months, fee from du full join lf on du.tenant = lf.tenant and du.key = lf.key")
def course_catalog(spark, d):
    return ops.course_catalog(_course_texts(spark, d))
