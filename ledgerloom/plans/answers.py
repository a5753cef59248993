"""Queries over questions and answers, made of the tables' numbers and texts, and facts from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers
from ..operators import memory
from ..operators.courses import extract_phone
from ..registration import query
from ..tables import table

SWITCHES = (
    ("Học phí khóa IELTS A, à không, khóa TOEIC B bao nhiêu", "tuition_calculator", "entity_override", "TOEIC B bao nhiêu"),
    ("Học phí bao nhiêu, thôi khỏi, cho em ghi danh {n}", "tuition_calculator", "create_ticket", None),
    ("ghi danh {n} mà không, so sánh A với B đi", "create_ticket", "comparison", None),
    ("giá {n} bao nhiêu", "tuition_calculator", "no_change", None),
    ("đổi ý rồi, ghi danh hay học phí 'Khoa {n}'", "chat", "create_ticket", None),
    ("đăng ký {n} học phí, đổi ý", "create_ticket", "multi_intent_ambiguity", None),
    ("\"Lop {n}\" rồi 'Lop X{n}', thay đổi", "course_search", "entity_override", "Lop X{n}"),
    ("  ", "chat", "empty", None),
)


def _sql(t):
    return "null" if t is None else "'" + t.replace("'", "''").replace("{n}", "' || o_orderkey || '") + "'"


def _spark(t):
    return F.lit(None).cast("string") if t is None else F.concat(*[x for i, part in enumerate(t.split("{n}")) for x in ([F.col("o_orderkey").cast("string")] if i else []) + [F.lit(part)]])


def _cases(column, items):
    out = F.when(F.lit(False), "")
    for i, t in enumerate(items):
        out = out.when(column == i, _spark(t))
    return out


def _cases_sql(items):
    return "case o_orderkey % " + str(len(items)) + " " + " ".join(f"when {i} then {_sql(t)}" for i, t in enumerate(items)) + " end"


@query("resolve_context_switch", f"select o_orderkey, reason in ('create_ticket', 'comparison', 'entity_override') as changed, case when reason in ('create_ticket', 'comparison') then reason end as resolved_intent, entity as override_entity, reason = 'multi_intent_ambiguity' as needs_confirmation, reason from (select o_orderkey, {_cases_sql([s[2] for s in SWITCHES])} as reason, {_cases_sql([s[3] for s in SWITCHES])} as entity from orders)")
def resolve_context_switch(spark, d):
    k = F.col("o_orderkey") % len(SWITCHES)
    asked = table(spark, d, "orders").select("o_orderkey", _cases(k, [s[0] for s in SWITCHES]).alias("q"), _cases(k, [s[1] for s in SWITCHES]).alias("intent"))
    return asked.select("o_orderkey", answers.resolve_context_switch(F.col("q"), F.col("intent")).alias("r")).select("o_orderkey", "r.*")


@query("check_slots", """with s as (select o_orderkey, o_orderkey % 4 as k, o_custkey % 3 as m, o_custkey % 7 as a from orders)
select o_orderkey, case k when 0 then m = 0 when 1 then m <> 1 when 2 then m = 2 else true end as complete, case when k = 0 and m > 0 then 'course_name' when k = 1 and m = 1 then 'entity_b' when k = 2 and m < 2 then 'phone' else '' end as missing,
  case when k = 3 then '' else array_to_string(list_filter([case when o_orderkey % 5 = 0 then 'budget' end, case when m = 1 then 'timeline' end, case when a < 5 then 'age' end], lambda x: x is not null), ',') end as warnings from s""")
def check_slots(spark, d):
    k, m = F.col("o_orderkey") % 4, F.col("o_custkey") % 3
    intent = F.when(k == 0, "tuition_calculator").when(k == 1, "comparison").when(k == 2, "create_ticket").otherwise("chat")
    slots = F.create_map(F.lit("course_name"), F.when(m == 0, "IELTS").when(m == 1, " "), F.lit("entity_a"), F.lit("A"), F.lit("entity_b"), F.when(m != 1, "B"), F.lit("phone"), F.when(m == 2, "0901234567"))
    said = F.concat(F.when(m == 1, "giỏi trong 3 ngày").otherwise("học lâu dài"), F.lit(", bé "), (F.col("o_custkey") % 7).cast("string"), F.lit(" tuổi"))
    told = table(spark, d, "orders").select("o_orderkey", answers.check_slots(intent, slots, said, F.when(F.col("o_orderkey") % 5 == 0, 499000).otherwise(500000)).alias("r"))
    return told.select("o_orderkey", "r.complete", F.array_join("r.missing", ",").alias("missing"), F.array_join("r.warnings", ",").alias("warnings"))


@query("sanitize_answer", r"""select conv_id, turn, case turn % 4 when 0 then 'Trả lời' || chr(10) || 'sau khối' when 1 then 'A' || chr(10) || turn when 2 then 'x' else regexp_replace(text, '^\s+|\s+$', '', 'g') end as answer from conversations""")
def sanitize_answer(spark, d):
    k = F.col("turn") % 4
    said = F.when(k == 0, F.concat(F.lit(" Trả lời\nLEAD-data:\n"), "text", F.lit("\nphone: 1\n  ```\nsau khối"))).when(k == 1, F.concat(F.lit("A\n"), F.col("turn").cast("string"), F.lit("\nkhi và chỉ khi\n"), "text")).when(k == 2, F.concat(F.lit("x\nlead data\n"), F.lit("y\nz"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", answers.sanitize_answer(said).alias("answer"))


#: Answers: what each says, and what is wrong with it.
SAID = (
    ("Dạ học phí là 9.500.000 VND", ""),
    ("the system  prompt says {n}", r"internal_leak:pattern=system\s*prompt,numeric_mismatch:computed=9500000 not found in answer"),
    ("khoảng 7.000.000đ thôi", "numeric_mismatch:computed=9500000 not found in answer"),
    ("9500000, cam kết chắc chắn đậu", "promise:guarantee_result"),
    ("9,500,000 vnd như bên supplier#000000003 nhé", "cross_tenant_leak:mentioned=supplier#000000003"),
    (" ", ""),
    ("9.500.000 trace_id {n}, hoàn lại 100% học phí", r"internal_leak:pattern=\btrace_id\b,promise:full_refund"),
    ("9.500.000 của Supplier#000000001", ""),
)
VALIDATED = f"with t as (select o_orderkey as key, {_cases_sql([s[1] for s in SAID])} as v, {_cases_sql([s[0] for s in SAID])} as a from orders)"


@query("validate_answer", VALIDATED + f""" select key, v = '' as passed, case when v = '' then 'pass' when contains(v, '_leak') then 'handoff' else 'sanitize' end as action, v as violations, case when v = '' then null when contains(v, '_leak') then '{answers.HANDOFF}' else a || '{answers.NOTE}' end as text from t""")
def validate_answer(spark, d):
    k = F.col("o_orderkey") % len(SAID)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), _cases(k, [s[0] for s in SAID]).alias("answer"), F.lit("Supplier#000000001").alias("tenant"), F.lit(9_500_000).cast("long").alias("computed"))
    return answers.validate_answers(rows, table(spark, d, "supplier").select(F.col("s_name").alias("tenant_id"))).withColumn("violations", F.array_join("violations", ","))


@query("focus_course", "select o_orderkey, case o_orderkey % 3 when 0 then 'ielts ' || o_custkey when 1 then 'x' || o_custkey || ' pro' end as course from orders")
def focus_course(spark, d):
    k, n = F.col("o_orderkey") % 3, F.col("o_custkey").cast("string")
    said = F.when(k == 0, F.concat(F.lit("Khoá IELTS "), n, F.lit(" học phí khóa gì"))).when(k == 1, F.concat(F.lit("cho hỏi khóa X"), n, F.lit("-Pro"))).otherwise(F.lit("khóa ab giá bao nhiêu"))
    return table(spark, d, "orders").select("o_orderkey", answers.focus_course(said).alias("course"))


@query("compare_entities", "select o_orderkey, case o_orderkey % 4 when 0 then 'a' || o_custkey || '|b' when 1 then 'ielts ' || o_custkey || '|toeic va cefr' when 2 then 'x' || o_custkey || '|y' else '' end as names from orders")
def compare_entities(spark, d):
    k, n = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    said = F.when(k == 0, F.concat(F.lit("/tenant t1 A"), n, F.lit(" vs. B"))).when(k == 1, F.concat(F.lit("So sánh IELTS "), n, F.lit(" với TOEIC và CEFR"))).when(k == 2, F.concat(F.lit("so sánh X"), n, F.lit(" và Y?"))).otherwise("hai khóa với nhau")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(answers.compare_entities(said), "|").alias("names"))


#: Users are customers of a segment; their orders are messages or tool calls in the order of their keys.
FACTS = """with o as (select c_mktsegment as tenant_id, o_custkey as user_id, o_orderkey as ts, o_orderkey % 6 as k from orders join customer on o_custkey = c_custkey),
f as (select tenant_id, user_id, ts, 0 as o, 'contact_phone' as fact_key, '09' || lpad(cast(user_id as varchar), 8, '0') as value_text, 0.85 as confidence, 'heuristic_tool' as source, 365 as ttl_days from o where k = 0
 union all select tenant_id, user_id, ts, 0, 'course_interest', 'IELTS ' || (ts % 3), 0.85, 'heuristic_tool', 180 from o where k = 0
 union all select tenant_id, user_id, ts, 0, 'latest_quote_vnd', (5000000 + ts % 7) || ' VND', 0.85, 'heuristic_tool', 30 from o where k = 0
 union all select tenant_id, user_id, ts, 0, 'target_level', 'b' || (ts % 2), 0.85, 'heuristic_tool', 365 from o where k = 1
 union all select tenant_id, user_id, ts, 1, 'mentioned_ielts_target', 'IELTS ' || (4 + ts % 5) || '.5', 0.4, 'heuristic_regex', 30 from o where k = 2
 union all select tenant_id, user_id, ts, 1, 'mentioned_grade', 'Lop ' || (1 + ts % 12), 0.4, 'heuristic_regex', 180 from o where k = 3
 union all select tenant_id, user_id, ts, 1, 'mentioned_budget_vnd', ((1 + ts % 20) * 1000000) || ' VND', 0.4, 'heuristic_regex', 30 from o where k = 4),
r as (select *, row_number() over (partition by tenant_id, user_id, fact_key, lower(value_text) order by o, ts) as n from f)
select tenant_id, user_id, fact_key, value_text, cast(confidence as double) as confidence, source, ttl_days from r where n = 1"""


@query("extract_facts", FACTS)
def extract_facts(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    t, u = F.col("ts"), F.col("user_id").cast("string")
    rows = o.select(F.col("c_mktsegment").alias("tenant_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("ts"))
    k = t % 6
    n = lambda e: e.cast("string")
    args = F.when(k == 0, F.concat(F.lit('{"extracted_args": {"phone": "09'), F.lpad(u, 8, "0"), F.lit('", "course_name": "", "course": "IELTS '), n(t % 3), F.lit('"}, "computed_final_vnd": '), n(5000000 + t % 7), F.lit(".0}")))
    args = args.when(k == 1, F.concat(F.lit('{"extracted_args": {"goal": " '), F.when(t % 4 == 1, "B").otherwise("b"), n(t % 2), F.lit('"}, "computed_final_vnd": "12"}'))).otherwise('{"extracted_args": {}, "computed_final_vnd": 5}')
    said = F.when(k == 2, F.concat(F.lit("Mục tiêu của em: IELTS "), n(4 + t % 5), F.lit(".5 nhé"))).when(k == 3, F.concat(F.lit("Bé đang học lớp "), n(1 + t % 12))).when(k == 4, F.concat(F.lit("Ngân sách 2 người tầm "), n(1 + t % 20), F.lit(" tr"))).otherwise("IELTS 6.5 lop hoc, 9 tr")
    told = memory.extract_facts(rows.where(k >= 2).withColumns({"role": F.lit("user"), "content": said}), rows.where((k < 2) | (k == 5)).withColumns({"route": F.lit("tuition_calculator"), "metadata": args}))
    return told.withColumn("value_text", F.when(F.col("fact_key") == "target_level", F.lower("value_text")).otherwise(F.col("value_text")))


@query("resolve_pending", """select 't' as tenant_id, conv_id as user_id, 'goal' as fact_key, case conv_id % 4 when 0 then 'IELTS 6.5' else 'Lop 7' end as value_text, cast(0.95 as double) as confidence from (select conv_id from conversations where role = 'user' and trim(coalesce(text, '')) <> '' group by conv_id) where conv_id % 4 in (0, 1)""")
def resolve_pending(spark, d):
    """Every conversation has a conflict; its latest user message names one option, the last word of one, both or none."""
    c = table(spark, d, "conversations").select(F.lit("t").alias("tenant_id"), F.col("conv_id").alias("user_id"), F.col("turn").alias("ts"), "role", F.coalesce("text", F.lit("")).alias("content"))
    last = c.where("role = 'user' and trim(content) <> ''").groupBy("user_id").agg(F.max("ts").alias("at"))
    k = F.col("user_id") % 4
    reply = F.when(k == 0, "em chọn  ielts 6.5 ").when(k == 1, "số 7 nhé").when(k == 2, "IELTS 6.5 hay Lop 7").otherwise("không biết")
    m = c.join(last, "user_id", "left").withColumn("content", F.when((F.col("ts") == F.col("at")) & (F.col("role") == "user"), reply).otherwise(F.concat(F.lit("Lop 7 "), "content")))
    pending = c.select("tenant_id", "user_id").distinct().select("tenant_id", "user_id", F.lit("goal").alias("fact_key"), F.array(F.lit("IELTS 6.5"), F.lit("Lop 7"), F.lit("Lop 7")).alias("options"))
    return memory.resolve_pending(pending, m)


@query("entity_patch", "select event_id, case when event_id % 3 = 0 then '09' || lpad(cast(user_id as varchar), 8, '1') end as phone, case when event_id % 4 < 2 then cast(event_id as varchar) end as total, case when event_id % 4 = 1 then 'total' end as scope from events")
def entity_patch(spark, d):
    i = F.col("event_id")
    meta = F.when(i % 4 == 0, F.concat(F.lit('{"computed_final_vnd": '), i.cast("string"), F.lit(', "discount_scope": null}'))).when(i % 4 == 1, F.concat(F.lit('{"computed_final_vnd": '), i.cast("string"), F.lit('.75, "discount_scope": "total"}'))).when(i % 4 == 2, '{"computed_final_vnd": "7", "discount_scope": 3}')
    rows = table(spark, d, "events").withColumns({"said": F.when(i % 3 == 0, F.concat(F.lit("gọi 09"), F.lpad(F.col("user_id").cast("string"), 8, "1"))).otherwise("x"), "meta": meta})
    return rows.select("event_id", memory.entity_patch(F.col("said"), "meta").alias("p")).select("event_id", F.col("p")["phone"].alias("phone"), F.col("p")["computed_total_payable_vnd"].alias("total"), F.col("p")["discount_scope"].alias("scope"))


@query("comparison_args", "select o_orderkey, case o_orderkey % 4 when 0 then 'A' || o_custkey || '|B' when 1 then 'IELTS ' || o_custkey || '|TOEIC|CEFR' when 2 then 'X' || o_custkey || '|X' || o_custkey || ' bao lâu' else '' end as subjects, case o_orderkey % 4 when 0 then 'price' when 1 then 'all' when 2 then 'duration' else 'all' end as criteria from orders")
def comparison_args(spark, d):
    k, n = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    said = F.when(k == 0, F.concat(F.lit("Cho em so sánh A"), n, F.lit(" với lớp B, học phí"))).when(k == 1, F.concat(F.lit("IELTS "), n, F.lit(" hay TOEIC hoặc CEFR: học phí, đầu ra"))).when(k == 2, F.concat(F.lit("X"), n, F.lit(". VS X"), n, F.lit(" bao lâu"))).otherwise(F.lit(""))
    return table(spark, d, "orders").select("o_orderkey", answers.comparison_args(said).alias("a")).select("o_orderkey", F.array_join("a.subjects", "|").alias("subjects"), "a.criteria")


@query("ticket_args", "select o_orderkey, case when o_orderkey % 3 < 2 then '09' || lpad(cast(o_custkey as varchar), 8, '2') end as phone, case o_orderkey % 3 when 0 then 'Lan ' || o_custkey when 1 then 'Minh' end as name, case o_orderkey % 3 when 0 then 'chieu' when 1 then lpad(cast(o_custkey % 24 as varchar), 2, '0') || ':30' end as preferred_time, case o_orderkey % 3 when 0 then 'Em là Lan ' || o_custkey || ', gọi chiều nhé' when 1 then 'mình tên Minh sdt lúc ' || (o_custkey % 24) || ':30' else 'alo' end as intent_summary from orders")
def ticket_args(spark, d):
    k, n = F.col("o_orderkey") % 3, F.col("o_custkey").cast("string")
    number = F.concat(F.lit("09"), F.lpad(n, 8, "2"))
    said = F.when(k == 0, F.concat(F.lit("Em là Lan "), n, F.lit(",  "), number, F.lit(" gọi chiều nhé"))).when(k == 1, F.concat(F.lit("mình tên Minh sdt "), number, F.lit("  lúc "), (F.col("o_custkey") % 24).cast("string"), F.lit(":30"))).otherwise(" alo ")
    return table(spark, d, "orders").select("o_orderkey", answers.ticket_args(said, extract_phone(said)).alias("t")).select("o_orderkey", "t.*")
