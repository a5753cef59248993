"""Prices, evidence, JSON, maps, answers and facts in texts: golden cases and odd input."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import answers, evidence, jsontext, prices, spans
from ledgerloom.operators import courses, enrich, kmaps, memory

ODD = [None, "", "   ", "x" * 5000, "đ" * 50, "\n\n:\n", "1" * 40 + " tr", "%", "giảm", "{", "khoa"]


def told(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


GOLDEN = [
    ("Học phí 10tr giảm 10% còn bao nhiêu?", 9_000_000, False),
    ("9.500.000đ giảm 10% còn bao nhiêu?", 8_550_000, False),
    ("Học phí 10tr giảm 500k còn bao nhiêu?", 9_500_000, False),
    ("9.500.000 VND giảm 1tr còn bao nhiêu?", 8_500_000, False),
    ("hoc phi 5tr giam 10%, hoc lieu 500k thi tong la bao nhieu?", 5_000_000, False),
    ("10tr giảm 120% còn bao nhiêu?", None, False),
    ("10tr giảm 20tr còn bao nhiêu?", None, False),
    ("10tr sau giảm còn bao nhiêu?", None, True),
]


def test_golden_prices_from_their_texts(spark):
    got = told(spark, [g[0] for g in GOLDEN], lambda c: prices.price_from_args(prices.tuition_args(c)))
    assert [(r.final, r.needs_discount) for r in got] == [g[1:] for g in GOLDEN]


def test_amounts_share_no_characters(spark):
    a = told(spark, ["giảm 2tr, học phí 12tr, tài liệu 300k và 250k", "giảm 10tr", "gửi xe 50k"], prices.tuition_args)
    assert (a[0].base_price, a[0].discount_cash, [s.amount for s in a[0].surcharges]) == (12_000_000, 2_000_000, [300_000, 250_000])
    assert (a[1].base_price, a[1].discount_cash) == (None, 10_000_000)
    assert (a[2].base_price, [(s.amount, s.label) for s in a[2].surcharges]) == (None, [(50_000, "50k")])


def test_spans_are_those_of_a_plain_search(spark):
    import re

    texts = ["aXbbXXc", "", None, "XX", "é X ü X", "abc"]
    got = told(spark, texts, lambda c: spans.matches(c, "X+"))
    assert [[(m.start, m.end, m.text) for m in r] for r in got] == [[(m.start(), m.end(), m[0]) for m in re.finditer("X+", t or "")] for t in texts]


def test_spans_search_a_text_twice(spark):
    """Once for the matches and once for what is between them, however many there are."""
    df = spark.createDataFrame([("ab" * 3000,), (None,)], "t string").select(spans.matches(F.col("t"), "(b)", 1).alias("x"))
    got = df.collect()
    assert [(m.start, m.end, m.part) for m in got[0].x] == [(2 * i + 1, 2 * i + 2, "b") for i in range(3000)] and got[1].x == []
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("split(") == 1 and plan.count("regexp_extract_all(") == 2


def test_evidence_by_what_stands_near(spark):
    e = told(spark, ["Học phí trọn gói 900.000 vnd", "lệ phí thi 2.000.000 đ", "2.000.000 đ" + " " * 61 + "lệ phí thi", "IELTS 6,5 ielts 6.5 TOEIC 800, b1 B2, 3 tháng 3 thang 12 tuần"], evidence.extract_evidence)
    assert [(r.tuition_vnd, r.fees_vnd) for r in e[:3]] == [([900_000], None), (None, [2_000_000]), ([2_000_000], None)]
    assert (e[3].ielts_target, e[3].toeic_target, e[3].cefr_target, e[3].duration_months, e[3].duration_weeks) == ([6.5], [800], ["B2"], [3.0], [12.0])


JSON = [
    ('x {"a": {"b": "}"}} y', '{"a": {"b": "}"}}', None),
    ('```json\n{"a": [1, "]"]}\n```', '{"a": [1, "]"]}', '[1, "]"]'),
    ("{broken", None, None),
    ('{"a": 1', None, None),
    ('say "{" then {"k": "\\"{"}', None, None),
    ("[1, [2, {}]] and {}", "{}", "[1, [2, {}]]"),
    ('{"a": NaN}', None, None),
    (None, None, None),
    ("", None, None),
    ("[" * 100_000, None, None),
]


def test_json_in_texts(spark):
    assert told(spark, [j[0] for j in JSON], jsontext.extract_json)[:4] == [j[1] for j in JSON][:4]
    assert told(spark, [j[0] for j in JSON], jsontext.extract_json)[5:] == [j[1] for j in JSON][5:]
    got = told(spark, [j[0] for j in JSON], lambda c: jsontext.extract_json(c, "array"))
    assert [g for g in got if g] == [j[2] for j in JSON if j[2]] and all(json.loads(g) is not None for g in got if g)


@pytest.mark.parametrize(
    "f",
    [
        prices.tuition_args, prices.extract_discounts, evidence.extract_evidence, jsontext.extract_json, answers.sanitize_answer, answers.focus_course, answers.compare_entities, answers.mentioned_facts,
        lambda c: answers.resolve_context_switch(c, F.lit("comparison")), lambda c: enrich.numbered_section(c, 5), lambda c: evidence.coerce_evidence(c, c), lambda c: enrich.bucket_scores(c, c),
    ],
)
def test_odd_texts_have_results(spark, f):
    assert len(told(spark, ODD, f)) == len(ODD)


def test_answers_meet_a_dictionary_of_several_rows(spark, monkeypatch):
    rows = [(1, "Tenant-3 và tenant-40", "tenant-1", None), (2, "của tenant-1", "Tenant-1", 5), (3, None, "tenant-1", 7), (4, "tenant-2", None, None)]
    df = spark.createDataFrame(rows, "key int, answer string, tenant string, computed long")
    names = spark.createDataFrame([(f"Tenant-{i}",) for i in range(50)] + [(None,), (" ",)], "tenant_id string")
    one = sorted(map(tuple, answers.validate_answers(df, names).collect()))
    monkeypatch.setattr(answers, "NAMES", 7)
    assert sorted((k, p, a, sorted(v), t) for k, p, a, v, t in answers.validate_answers(df, names).collect()) == sorted((k, p, a, sorted(v), t) for k, p, a, v, t in one)
    assert [(r[0], r[2]) for r in one] == [(1, "handoff"), (2, "sanitize"), (3, "pass"), (4, "pass")]
    assert one[0][3] == ["cross_tenant_leak:mentioned=tenant-3", "cross_tenant_leak:mentioned=tenant-4", "cross_tenant_leak:mentioned=tenant-40"]


@pytest.mark.parametrize("most", [3, 500_000])
def test_names_are_found_anywhere(spark, monkeypatch, most):
    """Names of 1 to 90 characters, some within others and over the ends of pieces, against a plain search; equal rows all stay."""
    import random

    r = random.Random(5)
    word = lambda n: "".join(r.choice("abđ") for _ in range(n))
    names = sorted({word(n) for n in (1, 2, 3, 4, 7, 8, 9, 16, 31, 90) for _ in range(3)} | {"me"})
    texts = [word(r.randrange(1, 300)) + r.choice(names).upper() + word(r.randrange(1, 70)) for _ in range(30)] + [" ", None]
    rows = [(k % 20, t, r.choice([" Me", "", None, names[k % len(names)]]), None) for k, t in enumerate(texts)]
    rows += rows[:3]
    monkeypatch.setattr(answers, "NAMES", most)
    got = answers.validate_answers(spark.createDataFrame(rows, "key int, answer string, tenant string, computed long"), spark.createDataFrame([(n,) for n in names], "tenant_id string")).collect()
    found = lambda t, own: [f"cross_tenant_leak:mentioned={n}" for n in names if own and n in (t or "").lower() and n != own and (t or "").strip()]
    want = [(k, found(t, (own or "").strip().lower())) for k, t, own, _ in rows]
    assert sorted((x.key, x.violations) for x in got) == sorted(want)


def test_sections_without_entities_give_a_general_map(spark):
    s = spark.createDataFrame([(1, 0, "", "só"), (2, 0, "IELTS A", "IELTS A 3 thang: 9.000.000 vnd"), (2, 1, "Học phí", "IELTS A: 8.500.000 vnd\nx"), (3, 0, "Liên hệ", "0901")], "doc long, idx long, heading string, body string")
    e = kmaps.discover_entities(s)
    assert sorted((r.doc, r.entity_id) for r in e.collect()) == [(2, "ielts_a"), (2, "ielts_a_3_thang")]
    maps = {(r.doc, r.entity_id): r for r in kmaps.heuristic_maps(e, s).collect()}
    assert set(maps) == {(1, kmaps.GENERAL), (2, "ielts_a"), (2, "ielts_a_3_thang"), (3, kmaps.GENERAL)}
    assert maps[2, "ielts_a"].evidence.tuition_vnd == [8_500_000, 9_000_000] and maps[2, "ielts_a"].commercial and not maps[1, kmaps.GENERAL].commercial
    assert kmaps.heuristic_maps(e.where("false"), s.where("false")).count() == 0


def test_recommended_courses_by_all_pairs(spark, monkeypatch):
    """Nulls on both sides, queries that ask for the same, ties; before the join each duration keeps only courses that can win."""
    import random

    r = random.Random(2)
    some = lambda x: r.choice([None, *[x] * 9])
    q = [(k % 200, r.choice([1, 2, None]), some(float(r.randrange(12))), some(r.randrange(9) * 1_000_000)) for k in range(210)]
    c = [(k, r.choice([1, 2, None]), some(r.randrange(24) / 2), some(r.randrange(80) * 100_000)) for k in range(1500)]
    best = {}
    for query, tenant, target, budget in q:
        for course, of, months, fee in c:
            if tenant is None or of != tenant or (months is not None and target is not None and months > target + 0.25) or (fee is not None and budget is not None and fee > budget):
                continue
            near = max(0, int(10 - abs(months - target) * 3)) if months is not None and target is not None else 0
            cheap = max(0, int((budget - fee) / 1_000_000)) if fee is not None and budget is not None else 0
            best[query] = min(best.get(query, (1, 0)), (-near - cheap, course))
    frame = type(spark.range(0))
    joined, join = [], frame.join
    monkeypatch.setattr(frame, "join", lambda self, other, *on: (joined.append(other.count()), join(self, other, *on))[1])
    queries = spark.createDataFrame(q, "query int, tenant int, target double, budget long")
    got = courses.recommend_course(queries, spark.createDataFrame(c, "course int, tenant int, months double, fee long")).collect()
    assert sorted((x.query, -x.score, x.course) for x in got) == sorted((k, *v) for k, v in best.items())
    assert joined[0] < len(c) / 3


def test_fees_end_at_blank_lines(spark):
    t = spark.createDataFrame([("t", 1, "Khóa A plus:\n\n9tr\nB plus: x\n800k\n7 triệu\nB plus: 6tr\nC: 5tr\n: 5tr"), ("t", 2, None)], "tenant string, pos int, text string")
    assert sorted((r.key, r.fee) for r in courses.course_fees(t).collect()) == [("b plus", 7_000_000)]


def test_pending_needs_one_option(spark):
    pending = spark.createDataFrame([("t", u, "k", ["Lop 7", "IELTS 6.5"]) for u in range(5)], "tenant_id string, user_id long, fact_key string, options array<string>")
    said = [(0, "LOP  7"), (1, "6.5"), (2, "7 hoac 6.5"), (3, " ")]
    m = spark.createDataFrame([("t", u, 2, "user", s) for u, s in said] + [("t", 3, 1, "User", "ielts 6.5"), ("t", 0, 9, "assistant", "6.5")], "tenant_id string, user_id long, ts long, role string, content string")
    assert sorted((r.user_id, r.value_text) for r in memory.resolve_pending(pending, m).collect()) == [(0, "Lop 7"), (1, "IELTS 6.5"), (3, "IELTS 6.5")]


def test_events_are_appended(spark, tmp_path):
    rows = spark.createDataFrame([(86_400 * d, "t", 1, "x", None, None) for d in (1, 1, 2)], "ts long, tenant_id string, user_id long, event_type string, content_text string, payload string")
    for _ in range(2):
        memory.append_events(rows, str(tmp_path / "log"))
    got = spark.read.parquet(str(tmp_path / "log"))
    assert got.count() == 6 and got.where("content_text = '' and payload = '{}'").count() == 6
