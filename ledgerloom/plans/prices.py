"""Queries over amounts in questions and course texts; the texts are made of the tables' numbers, and the SQL works the answers out from those numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence, jsontext, prices
from ..operators import courses
from ..registration import query
from ..tables import table

#: What an order asks: a = millions, p = percent, c = thousands, g = a grouped amount.
QUESTIONS = (
    "Học phí {a}tr giảm {p}% còn bao nhiêu?",
    "{g}đ giảm {p}% còn bao nhiêu?",
    "Học phí {a}tr giảm {c}k còn bao nhiêu?",
    "{g} VND giảm {b}tr còn bao nhiêu?",
    "hoc phi {a}tr giam {p}%, hoc lieu {c}k thi tong la bao nhieu?",
    "{a}tr giảm {q}% còn bao nhiêu?",
    "{a}tr giảm {d}tr còn bao nhiêu?",
    "{a}tr sau giảm còn bao nhiêu?",
    "Phí xếp lớp {c}k. Khóa dài hạn, trả góp linh hoạt hằng kỳ, giá trọn gói {a} củ, giảm trên tổng {p}% mỗi tháng",
)
NUMBERS = {"a": "6 + o_custkey % 14", "p": "5 + o_orderkey % 30", "c": "100 + o_custkey % 800", "b": "1 + o_orderkey % 5", "q": "101 + o_orderkey % 90", "d": "21 + o_custkey % 9", "g": "(6 + o_custkey % 9) || '.' || (100 + o_orderkey % 900) || '.000'"}


def _filled(text: str) -> str:
    out = "'" + text + "'"
    for k, v in NUMBERS.items():
        out = out.replace("{" + k + "}", f"' || ({v}) || '")
    return out


def _asked(spark, d):
    cases = "CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN {_filled(t)}" for i, t in enumerate(QUESTIONS)) + " END"
    return table(spark, d, "orders").select("o_orderkey", F.expr(cases).alias("q"))


_G = "((6 + o_custkey % 9) * 1000000 + (100 + o_orderkey % 900) * 1000)"
ASKED = f"""n as (select o_orderkey, o_orderkey % 9 as k, {', '.join(f'cast({v} as bigint) as {x}' for x, v in NUMBERS.items() if x != 'g')}, cast({_G} as bigint) as g from orders),
w as (select o_orderkey, k, case when k in (1, 3) then g else a * 1000000 end as base, cast(case when k in (0, 1, 4, 8) then p when k = 5 then q end as double) as pct,
  case k when 2 then c * 1000 when 3 then b * 1000000 when 6 then d * 1000000 end as cash, case when k in (4, 8) then c * 1000 else 0 end as fees from n)"""


@query(
    "tuition_args",
    f"""with {ASKED} select o_orderkey, base as base_price, pct as discount_percent, cash as discount_cash, case when pct is not null then 'percent' when cash is not null then 'cash' end as discount_type,
  case when k = 8 then 'total' else 'tuition' end as discount_scope, case when k = 8 then 'per_month' else 'one_time' end as discount_period, case when fees > 0 then fees || ':' || (fees // 1000) || 'k' else '' end as surcharges from w""",
)
def tuition_args(spark, d):
    told = _asked(spark, d).select("o_orderkey", prices.tuition_args(F.col("q")).alias("t"))
    fees = F.array_join(F.transform("t.surcharges", lambda s: F.concat(s["amount"].cast("string"), F.lit(":"), s["label"])), ",")
    return told.select("o_orderkey", *[f"t.{c}" for c in ("base_price", "discount_percent", "discount_cash", "discount_type", "discount_scope", "discount_period")], fees.alias("surcharges"))


@query(
    "price_from_question",
    f"""with {ASKED}, b as (select *, case when k = 8 then base + fees else base end as basis, case when k = 8 then 0 else fees end as rest from w)
select o_orderkey, case when k = 7 or pct > 100 or cash > basis then null else cast(basis - case when pct is not null then round_even(basis * pct / 100, 0) else cash end + rest as bigint) end as final, fees, k = 7 as needs_discount from b""",
)
def price_from_question(spark, d):
    """The price that each question asks for, from its text."""
    args = _asked(spark, d).withColumn("args", prices.tuition_args(F.col("q")))
    return args.select("o_orderkey", prices.price_from_args(F.col("args")).alias("p")).select("o_orderkey", "p.*")


OFFERS = "CASE o_orderkey % 5 WHEN 0 THEN 'Ưu đãi ' || p || '%, giảm ' || c || 'k' WHEN 1 THEN 'Combo 2 khóa: ' || p || '% và ' || (p + 40) || '%' WHEN 2 THEN 'COMBO hè' || chr(10) || 'ưu đãi ' || p || ',5%' WHEN 3 THEN 'combo' || chr(10) || '- riêng ' || p || '%' || chr(10) || 'giam 3%' ELSE 'mua combo hai khóa' || chr(10) || chr(10) || 'sẽ giam ' || p || ' % nhé' END"


def _offers(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr("5 + o_orderkey % 40").alias("p"), F.expr("100 + o_custkey % 800").alias("c"))
    return o.select("o_orderkey", F.expr(OFFERS).alias("t"))


@query(
    "extract_discounts",
    """with n as (select o_orderkey, o_orderkey % 5 as k, cast(5 + o_orderkey % 40 as double) as p, cast(100 + o_custkey % 800 as bigint) as c from orders)
select o_orderkey, array_to_string(case k when 1 then [p, p + 40] when 2 then [p + 0.5] when 3 then [3.0::double, p] else [p] end, ',') as percents, case when k = 1 then case when p + 40 <= 50 then p + 40 else p end when k = 2 then p + 0.5 when k = 3 then 3.0 when k = 4 then p end as combo, case when k = 0 then c * 1000 end as cash from n""",
)
def extract_discounts(spark, d):
    told = _offers(spark, d).select("o_orderkey", prices.extract_discounts(F.col("t")).alias("x"))
    return told.select("o_orderkey", F.array_join(F.transform("x.percents", lambda p: p.cast("string")), ",").alias("percents"), "x.combo", "x.cash")


@query(
    "combo_price",
    """with q as (select o_orderkey as request, 5 + o_orderkey % 60 as pct, cast((o_custkey % 3) * 100000 as bigint) as fees, o_custkey % 25 as x, (o_custkey + 7) % 25 as y, o_orderkey % 4 as k from orders),
p as (select n_nationkey as course, lower(n_name) as name, cast(5000000 + n_nationkey * 100000 as bigint) as price from nation), t as (select course, price, list_filter(regexp_extract_all('khoa ' || name || ' abcd', '[a-z0-9]+'), lambda x: length(x) >= 4) as ts from p),
a as (select request, pct, fees, 'mua combo khoa ' || (select name from p where course = x) || case when k < 3 then ' va ' || (select name from p where course = y) else '' end || ' abcd' as said, k from q),
h as (select request, pct, fees, course, price, len(list_filter(ts, lambda w: list_contains(regexp_extract_all(said, '[a-z0-9]+'), w))) as hits, len(ts) as n from a, t where k > 0),
r as (select *, row_number() over (partition by request order by hits desc, price desc, course) as r from h where hits >= least(2, n)), s as (select request, any_value(pct) as pct, any_value(fees) as fees, sum(price) as base, count(*) as n from r where r <= 2 group by request)
select request, cast(base as bigint) as base, case when pct <= 50 then cast(pct as double) end as percent, cast(base - case when pct <= 50 then round_even(base * pct / 100, 0) else 0 end + fees as bigint) as final from s where n = 2""",
)
def combo_price(spark, d):
    """Two nations are named as courses; a quarter of the questions names no combo, another one course only."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("course"), F.concat(F.lit("khoa "), F.lower("n_name"), F.lit(" abcd")).alias("name"), (5000000 + F.col("n_nationkey") * 100000).cast("long").alias("price"), F.lower("n_name").alias("short"))
    k = F.col("o_orderkey") % 4
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), k.alias("k"), (5 + F.col("o_orderkey") % 60).cast("double").alias("percent"), ((F.col("o_custkey") % 3) * 100000).alias("fees"), (F.col("o_custkey") % 25).alias("x"), ((F.col("o_custkey") + 7) % 25).alias("y"))
    named = o.join(F.broadcast(n.select(F.col("course").alias("x"), F.col("short").alias("nx"))), "x").join(F.broadcast(n.select(F.col("course").alias("y"), F.col("short").alias("ny"))), "y")
    said = F.concat(F.when(F.col("k") > 0, "mua combo khoa ").otherwise("mua khoa "), "nx", F.when(F.col("k") < 3, F.concat(F.lit(" va "), "ny")).otherwise(""), F.lit(" abcd"))
    return courses.combo_price(named.select("request", said.alias("text"), "percent", "fees"), n.select("course", "name", "price"))


#: Course texts: their numbers come from the part.
ABOUT = "CASE p_partkey % 4 WHEN 0 THEN ' Khóa học: học phí ' || (1 + p_size % 9) || '.' || (100 + p_partkey % 900) || '.000 VND cho ' || (2 + p_size % 10) || ' tháng, IELTS ' || (4 + p_size % 5) || '.5' WHEN 1 THEN ' lệ phí thi thử ' || (2 + p_size % 7) || '.' || (100 + p_partkey % 900) || '.000 đ, ' || (3 + p_size % 20) || ' tuần, TOEIC ' || (400 + p_partkey % 500) WHEN 2 THEN ' Niêm yết ' || (6 + p_size) || ' triệu' || repeat(' -', 70) || ' giữ chỗ ' || (1 + p_size % 3) || ' tr. Trình độ B1, A2, B1' ELSE ' ' || (200 + p_partkey % 700) || '.000 vnd; 1,5 thang va 1,5 tháng' END"
PARTS = "p as (select p_partkey, p_partkey % 4 as k, p_size as z, p_partkey as i from part)"
EVIDENCE_SQL = f"""with {PARTS}, e as (select p_partkey,
  case k when 0 then (2 + z % 10) || '.0' when 3 then '1.5' end as duration_months, case when k = 1 then (3 + z % 20) || '.0' end as duration_weeks,
  {{money}} case when k = 0 then (4 + z % 5) || '.5' end as ielts_target, case when k = 1 then cast(400 + i % 500 as varchar) end as toeic_target, case when k = 2 then 'A2,B1' end as cefr_target from p)"""
_ALL = "case k when 0 then cast((1 + z % 9) * 1000000 + (100 + i % 900) * 1000 as varchar) when 1 then cast((2 + z % 7) * 1000000 + (100 + i % 900) * 1000 as varchar) when 2 then (1 + z % 3) || '000000,' || (6 + z) || '000000' else cast((200 + i % 700) * 1000 as varchar) end"
_TUITION = "case k when 0 then cast((1 + z % 9) * 1000000 + (100 + i % 900) * 1000 as varchar) when 2 then (6 + z) || '000000' end"
_FEES = "case k when 1 then cast((2 + z % 7) * 1000000 + (100 + i % 900) * 1000 as varchar) when 2 then (1 + z % 3) || '000000' when 3 then cast((200 + i % 700) * 1000 as varchar) end"


def _about(spark, d):
    return table(spark, d, "part").select("p_partkey", F.expr(ABOUT).alias("text"))


def _joined(told, names):
    return told.select("p_partkey", *[F.array_join(F.transform(f"e.{n}", lambda v: v.cast("string")), ",").alias(n) for n in names])


NAMES = ("duration_months", "duration_weeks", "tuition_vnd", "fees_vnd", "ielts_target", "toeic_target", "cefr_target")


@query("extract_evidence", EVIDENCE_SQL.format(money=f"{_TUITION} as tuition_vnd, {_FEES} as fees_vnd,") + " select * from e")
def extract_evidence(spark, d):
    return _joined(_about(spark, d).select("p_partkey", evidence.extract_evidence(F.col("text")).alias("e")), NAMES)


@query("extract_evidence_unsplit", EVIDENCE_SQL.format(money=f"{_ALL} as tuition_vnd,") + " select * from e")
def extract_evidence_unsplit(spark, d):
    return _joined(_about(spark, d).select("p_partkey", evidence.extract_evidence(F.col("text"), split_fees=False).alias("e")), [n for n in NAMES if n != "fees_vnd"])


@query(
    "coerce_evidence",
    EVIDENCE_SQL.format(money=f"{_ALL} as tuition_vnd,")
    + """ select p_partkey, duration_months, case p_partkey % 3 when 1 then case when duration_weeks is null then '9.0' when cast(duration_weeks as double) < 9 then duration_weeks || ',9.0' when duration_weeks = '9.0' then '9.0' else '9.0,' || duration_weeks end else duration_weeks end as duration_weeks,
case when p_partkey % 3 = 0 then '7' else tuition_vnd end as tuition_vnd, ielts_target, toeic_target, case when p_partkey % 3 = 0 then 'X' else cefr_target end as cefr_target from e""",
)
def coerce_evidence(spark, d):
    """A third of the parts has an object for evidence, a third a list, a third text that is no JSON."""
    k = F.col("p_partkey") % 3
    told = F.when(k == 0, '{"tuition_vnd": [7], "cefr_target": ["X"]}').when(k == 1, '["9 tuan", null]').otherwise("no {json")
    return _joined(_about(spark, d).select("p_partkey", evidence.coerce_evidence(told, F.col("text")).alias("e")), [n for n in NAMES if n != "fees_vnd"])


@query("extract_json", """select event_id, case event_id % 7 when 1 then '{"a": "}{", "b": ' || props || '}' when 2 then '{"q": "\\"}", "l": [1, {"x": {}}]}' when 4 then null when 5 then null else props end as object, case when event_id % 7 = 2 then '[1, {"x": {}}]' when event_id % 7 = 6 then '[' || props || ', "]"]' end as array from events""")
def extract_json(spark, d):
    """Events' properties inside fences, prose, other objects and broken texts."""
    i, p = F.col("event_id") % 7, F.col("props")
    said = (
        F.when(i == 0, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```\nas {asked}")))
        .when(i == 1, F.concat(F.lit('so {"a": "}{", "b": '), p, F.lit("} and {more}")))
        .when(i == 2, F.lit('{"q": "\\"}", "l": [1, {"x": {}}]} {'))
        .when(i == 3, F.concat(F.lit("  "), p, F.lit("\n")))
        .when(i == 4, F.concat(F.lit("{broken "), p))
        .when(i == 5, "nothing")
        .otherwise(F.concat(F.lit("list ["), p, F.lit(', "]"] end')))
    )
    return table(spark, d, "events").select("event_id", jsontext.extract_json(said).alias("object"), jsontext.extract_json(said, "array").alias("array"))
