"""Questions that change their mind, slots that are missing, and answers that must not go out: columns, and a check of answers against other tenants' names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .guards import any_of, format_vnd, parse_money
from .spans import AFTER, BEFORE, let, matches
from .textnorm import norm_ascii, strip_accents

# Patterns of the rules in their order, words of the slots, and names.
OVERRIDES = (
    r"\ba khong\b",
    r"\ba ko\b",
    r"\bthoi khoi\b",
    r"\bkhoan\b.*\b(?:de|cho|doi)\b",
    r"\bkhoan da\b",
    r"\bthoi\b.*\b(?:bo|doi|khong|ko)\b",
    r"\bkhong\b.*\b(?:phai|co|dung)\b.*\b(?:la|ma)\b",
    r"\bma khong\b",
    r"\bthay doi\b",
    r"\bdoi y\b",
    r"\bdoi lai\b",
    r"\bbo qua\b.*\b(?:cau|cai|phan)\b.*\b(?:truoc|tren)\b",
)
TO_TICKET = (r"\bthoi\b.*\b(?:ghi danh|dang ky|tu van vien)\b", r"\bghi danh\b", r"\bdang ky hoc\b", r"\bgap tu van vien\b", r"\blien he\b.*\b(?:tu van|nhan vien)\b")
TO_COMPARISON = (r"\bso sanh\b.*\b(?:voi|va)\b", r"\bkhac nhau\b")
CUES = (r"\b(?:hoc phi|gia|bao nhieu tien|phi)\b", r"\b(?:so sanh|khac nhau)\b", r"\b(?:ghi danh|dang ky|tu van vien|lien he)\b")
ENTITY_INTENTS = ("tuition_calculator", "comparison", "course_search")
QUOTED = "[\"“”'](.*?)[\"“”']"
COURSE = r"(?iu)(?:khoa|khóa|khoá)\s+([A-ZĐa-zđÀ-ỹ][A-Za-zĐđÀ-ỹ\s\-.]{1,40})"
SLOTS = {"tuition_calculator": ("course_name",), "comparison": ("entity_a", "entity_b"), "create_ticket": ("phone",), "course_search": ()}
SHORT_TIMES = ("1 tuan", "1 ngay", "2 ngay", "3 ngay", "vai ngay", "may ngay")
MASTERY = ("thanh thao", "gioi", "fluent", "ielts 7", "ielts 8", "ielts 9")
LEAKS = (
    r"system\s*prompt",
    r"```(?:json|python|yaml)",
    r"\bnode[s_]\.jsonl\b",
    r"\b(?:app|services|agentic|guardrails)[/\\]",
    r"\b__[a-z_]+__\b",
    r"\bDEBUG\b.*\btrace\b",
    r"\btrace_id\b",
    r"\btenant_id\b.*=.*\b[a-z0-9_]{3,}\b",
    r"\bapi[_\s]*key\b",
    r"\b(?:SELECT|INSERT|UPDATE|DELETE)\b.*\bFROM\b",
    r"\bSettings\.",
    r"\bVectorStoreIndex\b",
    r"\bQdrantClient\b",
    r"\bembedding\b.*\bmodel\b",
    r"\"fact_key\"",
    r"\"fact_value_text\"",
)
PROMISES = ((r"cam kết.*(?:100%|đậu|đạt|pass)", "promise:guarantee_result"), (r"miễn phí.*(?:toàn bộ|hoàn toàn|100%)", "promise:free_everything"), (r"hoàn.*100%.*học phí", "promise:full_refund"))
HANDOFF = "Dạ em cần xác nhận lại thông tin chính xác với bộ phận hỗ trợ. Anh/chị vui lòng để em chuyển cho tư vấn viên hỗ trợ chi tiết nhé!"
NOTE = "\n\n_Lưu ý: Các thông tin trên mang tính tham khảo. Anh/chị vui lòng liên hệ trung tâm để xác nhận chi tiết._"
#: Tenants' names, and no more, that are broadcast.
NAMES = 500_000
#: Texts are searched in pieces of so many characters, for a place in a text is found by counting from its start.
PIECE = 64


def _place(text, pattern: str):
    """Where a pattern first stands, from 0, null where it doesn't."""
    return F.when(text.rlike(pattern), F.length(F.get(F.split(text, pattern, 2), F.lit(0))))


def _entities(col):
    """Names in quotes and after the word for a course, by their places."""
    told = F.concat(matches(col, QUOTED, 1), matches(col, COURSE, 1))
    named = F.transform(told, lambda m: F.struct(m["start"], F.regexp_replace(F.regexp_replace(m["part"], r"^\s+|\s+$", ""), r"[.,;!?]+$", "").alias("name")))
    return F.array_sort(F.filter(named, lambda m: F.length(m["name"]) >= 2))


def resolve_context_switch(question, intent):
    """struct(changed, resolved_intent, override_entity, needs_confirmation, reason) of a question that takes something back.

    What takes something back is the first rule that fits. A wish for a ticket, or else for a comparison, that stands behind it wins. Otherwise, where the intent
    is about courses and two or more are named, the last one named wins. Otherwise two different wishes ask for a confirmation.
    """
    q = F.coalesce(question, F.lit(""))

    def reason_of(n):
        back = F.coalesce(*[_place(n, p) for p in OVERRIDES])
        last = lambda patterns: F.array_max(F.array(*[_place(n, p) for p in patterns]))
        wishes = sum((n.rlike(p).cast("int") for p in CUES), F.lit(0))
        return F.struct(back.alias("back"), last(TO_TICKET).alias("ticket"), last(TO_COMPARISON).alias("comparison"), wishes.alias("wishes"))

    def told(x):
        at, named = x["at"], x["named"]
        reason = (
            F.when(F.trim(q) == "", "empty")
            .when(at["ticket"] > at["back"], "create_ticket")
            .when(at["comparison"] > at["back"], "comparison")
            .when(at["back"].isNotNull() & intent.isin(*ENTITY_INTENTS) & (F.size(named) >= 2), "entity_override")
            .when(at["back"].isNotNull() & (at["wishes"] >= 2), "multi_intent_ambiguity")
            .otherwise("no_change")
        )
        return F.struct(
            reason.isin("create_ticket", "comparison", "entity_override").alias("changed"),
            F.when(reason.isin("create_ticket", "comparison"), reason).alias("resolved_intent"),
            F.when(reason == "entity_override", F.element_at(named, -1)["name"]).alias("override_entity"),
            (reason == "multi_intent_ambiguity").alias("needs_confirmation"),
            reason.alias("reason"),
        )

    return let(F.struct(let(norm_ascii(q), reason_of).alias("at"), _entities(q).alias("named")), told)


def check_slots(intent, slots, question, budget=None):
    """struct(complete, missing, warnings): the slots (a map) that an intent needs and lacks, in order, and what is not reasonable: a "budget" under
    500,000, a "timeline" of days for mastery, an "age" under five. An unknown intent lacks nothing and is not looked at."""
    n = norm_ascii(question)
    need = F.array().cast("array<string>")
    for k, names in SLOTS.items():
        need = F.when(intent == k, F.array(*[F.lit(x) for x in names]).cast("array<string>")).otherwise(need)
    missing = F.filter(need, lambda s: F.trim(F.coalesce(F.try_element_at(slots, s), F.lit(""))) == "")
    age = F.regexp_extract(n, r"\b([0-9]{1,2})\s*tuoi\b", 1)
    low = (budget > 0) & (budget < 500_000) if budget is not None else F.lit(False)
    warnings = F.array_compact(F.array(F.when(low, "budget"), F.when(any_of(n, SHORT_TIMES) & any_of(n, MASTERY), "timeline"), F.when((age != "") & (age.cast("int") < 5), "age")))
    known = intent.isin(*SLOTS)
    return F.struct((F.size(missing) == 0).alias("complete"), missing.alias("missing"), F.when(F.coalesce(known, F.lit(False)), warnings).otherwise(F.array().cast("array<string>")).alias("warnings"))


def sanitize_answer(col):
    """An answer without its block of lead data, from the line that names it to the fence that ends it, and without all from the line that says "khi va chi khi" on."""
    text = F.coalesce(col, F.lit(""))
    lines = F.split(text, r"\r\n|[\n\r]")

    def step(acc, line):
        n = norm_ascii(line)
        end, lead = acc["end"] | n.contains("khi va chi khi"), n.contains("lead data")
        fence = acc["skip"] & F.trim(line).startswith("```")
        kept = F.when(end | lead | acc["skip"], acc["kept"]).otherwise(F.array_append(acc["kept"], line))
        return F.struct(kept.alias("kept"), (~end & (lead | (acc["skip"] & ~fence))).alias("skip"), end.alias("end"))

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("skip"), F.lit(False).alias("end"))
    n = norm_ascii(text)
    cleaned = F.array_join(F.aggregate(lines, start, step, lambda acc: acc["kept"]), "\n")
    return F.regexp_replace(F.when(n.contains("lead data") | n.contains("khi va chi khi"), cleaned).otherwise(text), r"^\s+|\s+$", "")


def _own_violations(answer, computed):
    """Violations that need no other table: leaks, a computed amount that isn't told, promises."""
    low = F.lower(answer)
    told = F.transform(F.regexp_extract_all(answer, F.lit(r"(?iu)([0-9.,]+)\s*(?:VND|vnđ|đồng|dong|₫)"), F.lit(1)), lambda x: F.regexp_replace(x, "[.,]", "").try_cast("long"))
    wrong = (computed > 0) & ~(answer.contains(computed.cast("string")) | answer.contains(format_vnd(computed)) | F.coalesce(F.array_contains(F.filter(told, lambda x: x >= 10_000), computed), F.lit(False)))
    leaks = [F.when(answer.rlike(f"(?i){p}"), F.lit(f"internal_leak:pattern={p}")) for p in LEAKS]
    numeric = F.when(wrong, F.concat(F.lit("numeric_mismatch:computed="), computed.cast("string"), F.lit(" not found in answer")))
    return F.array_compact(F.array(*leaks, numeric)), F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(name)) for p, name in PROMISES]))


def _mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(__of, name): the distinct ``names`` that stand in each ``text``.

    A name begins with a head of 1, 2, 4, 8 ... characters, the longest that it has. Every place of a text is looked up with each size of heads that occurs, and where
    one is found with the lengths of its names; both are joins by equality.
    """
    length = F.length("name")
    told = names.select("name", length.alias("length"), F.expr("shiftleft(1, length(bin(length(name))) - 1)").alias("size"))
    known = told.agg(F.count("*").alias("n"), F.max("length").alias("most"), F.array_sort(F.collect_set("size")).alias("sizes")).first()
    few = lambda df: F.broadcast(df) if known.n <= NAMES else df
    heads = told.groupBy("size", F.expr("substring(name, 1, size)").alias("head")).agg(F.collect_set("length").alias("lengths"))
    pieces = texts.select("__of", F.expr(f"explode(sequence(1, length(text), {PIECE}))").alias("at"), "text").select("__of", F.expr(f"substring(text, at, {PIECE - 1 + (known.most or 1)})").alias("piece"))
    places = pieces.select("__of", "piece", F.expr(f"explode(sequence(1, least({PIECE}, length(piece))))").alias("at"))
    sized = places.select("*", F.explode(F.array(*[F.lit(x) for x in known.sizes]).cast("array<int>")).alias("size")).where("at + size - 1 <= length(piece)")
    found = sized.withColumn("head", F.expr("substring(piece, at, size)")).join(few(heads), ["size", "head"])
    whole = found.select("__of", "piece", "at", F.explode("lengths").alias("length")).where("at + length - 1 <= length(piece)")
    return whole.select("__of", F.expr("substring(piece, at, length)").alias("name")).join(few(names), "name").select("__of", "name").distinct()


def validate_answers(answers: DataFrame, tenants: DataFrame, key: str = "key") -> DataFrame:
    """(key, passed, action, violations, text) for (key, answer, tenant, computed): leaks and other tenants' names hand the answer over, a computed amount that isn't
    told or a promise adds a note. Blank answers pass.

    Names of ``tenants`` (tenant_id) that stand anywhere in an answer, in any case, are found by ``_mentions``, whose work grows with the answers' characters and
    not with the number of names.
    """
    names = tenants.select(F.lower(F.trim("tenant_id")).alias("name")).where("name <> ''").distinct()
    own, low = F.lower(F.trim("tenant")), F.lower(F.coalesce("answer", F.lit("")))
    none = F.array().cast("array<string>")
    asked = answers.where(own.isNotNull() & (own != "") & (F.trim(low) != "")).select(F.struct(key, "answer").alias("__of"), low.alias("text"))
    told = _mentions(asked, names).groupBy("__of").agg(F.array_sort(F.collect_set("name")).alias("__names"))
    met = answers.join(told, F.struct(key, "answer").eqNullSafe(F.col("__of")), "left")
    met = met.withColumn("__met", F.when(F.coalesce(own, F.lit("")) != "", F.filter(F.coalesce("__names", none), lambda t: t != own)).otherwise(none))
    answer = F.coalesce("answer", F.lit(""))
    first, promises = _own_violations(answer, F.col("computed"))
    others = F.transform("__met", lambda t: F.concat(F.lit("cross_tenant_leak:mentioned="), t))
    found = F.when(F.trim(answer) == "", F.array().cast("array<string>")).otherwise(F.concat(first, others, promises))
    told = met.select(key, answer.alias("__a"), found.alias("violations"))
    grave = F.exists("violations", lambda v: v.startswith("internal_leak") | v.startswith("cross_tenant_leak"))
    action = F.when(F.size("violations") == 0, "pass").when(grave, "handoff").otherwise("sanitize")
    told = told.withColumn("action", action)
    text = F.when(F.col("action") == "handoff", HANDOFF).when(F.col("action") == "sanitize", F.concat("__a", F.lit(NOTE)))
    return told.select(key, (F.col("action") == "pass").alias("passed"), "action", "violations", text.alias("text"))


def focus_course(col):
    """What follows the word for a course in the normalised text, up to a word that ends it; null below three characters."""
    tail = F.regexp_extract(norm_ascii(col), r"\bkhoa\s+([a-z0-9][a-z0-9\s]{2,80})", 1)
    name = F.trim(F.get(F.split(tail, r"\b(?:hoc phi|gia|bao nhieu|neu|thi|va|roi|co cong don|khong|cua|theo)\b", 2), F.lit(0)))
    return F.when(F.length(name) >= 3, name)


def compare_entities(col):
    """The two names that a question compares, normalised: what stands around "vs", or around "voi" or else "va" where it asks to compare."""
    n = norm_ascii(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?i)(?:^|\s)/(?:tenant|branch|index|llm|state|help|exit)\b(?:\s+\S+)?", " "))
    asks = n.contains("so sanh")
    parts = F.when(n.rlike(r"\bvs\b"), F.split(n, r"\bvs\b", 2)).when(asks & n.rlike(r"\bvoi\b"), F.split(n, r"\bvoi\b", 2)).when(asks & n.rlike(r"\bva\b"), F.split(n, r"\bva\b", 2))
    return F.coalesce(F.filter(F.transform(parts, lambda p: F.trim(F.replace(p, F.lit("so sanh"), F.lit("")))), lambda p: p != ""), F.array().cast("array<string>"))


def mentioned_facts(col):
    """array<struct<fact_key, value_text, ttl_days>> of what a message tells of a target, a grade and a budget."""
    text = F.trim(F.coalesce(col, F.lit("")))
    n = F.trim(F.lower(strip_accents(text, map_d=True)))
    ielts = F.regexp_extract(n, rf"{BEFORE}ielts\s*([0-9](?:\.[0-9])?){AFTER}", 1)
    grade = F.regexp_extract(n, rf"{BEFORE}(?:dang hoc|hoc lop|lop)\s*([0-9]{{1,2}}){AFTER}", 1)
    amounts = F.transform(F.regexp_extract_all(text, F.lit(r"(?iu)[0-9][0-9.,\s]{0,12}(?:\s*(?:tr|trieu|k|vnd|đ))?"), F.lit(0)), lambda x: parse_money(F.trim(x)))
    budget = F.get(F.filter(amounts, lambda v: v > 0), F.lit(0))
    fact = lambda ok, name, value, days: F.when(ok, F.struct(F.lit(name).alias("fact_key"), value.alias("value_text"), F.lit(days).alias("ttl_days")))
    return F.array_compact(
        F.array(
            fact((ielts != "") & any_of(n, ("muc tieu", "target", "can dat", "muon dat", "phai dat", "goal", "band")), "mentioned_ielts_target", F.concat(F.lit("IELTS "), ielts), 30),
            fact(grade != "", "mentioned_grade", F.concat(F.lit("Lop "), grade), 180),
            fact(budget.isNotNull() & any_of(n, ("ngan sach", "budget", "toi da", "toi co", "tam")), "mentioned_budget_vnd", F.concat(budget.cast("string"), F.lit(" VND")), 30),
        )
    )


# Words for what is compared, and times that callers name.
CRITERIA = (("price", ("hoc phi", "gia", "price", "phi")), ("duration", ("thoi luong", "bao lau", "so thang", "tuan", "buoi", "duration")), ("output", ("dau ra", "output", "muc tieu", "band", "diem")))
EVERYTHING = ("tat ca", "toan bo", "full", "all")
TIMES = ("hom nay", "ngay mai", "mai", "thu 2", "thu 3", "thu 4", "thu 5", "thu 6", "thu 7", "chu nhat", "sang", "chieu", "toi")


def comparison_args(col):
    """struct(subjects, criteria): up to four different subjects, between words for "or" and "against" and behind "so sánh", and the one criterion that a question names, else "all"."""
    q = F.trim(F.coalesce(col, F.lit("")))
    n = norm_ascii(q)
    hits = F.array_compact(F.array(*[F.when(any_of(n, words), name) for name, words in CRITERIA]))
    criteria = F.when(~any_of(n, EVERYTHING) & (F.size(hits) == 1), F.get(hits, F.lit(0))).otherwise("all")
    joined = F.regexp_replace(F.regexp_replace(q, rf"(?iu){BEFORE}(vs|voi|với){AFTER}", " vs "), rf"(?iu){BEFORE}(hay|hoac|hoặc){AFTER}", " vs ")
    tail = F.when(joined.rlike(rf"(?iu){BEFORE}so\s*s[aá]nh{AFTER}.*$"), F.trim(F.regexp_extract(joined, rf"(?iu){BEFORE}so\s*s[aá]nh{AFTER}(.*)$", 1))).otherwise(joined)
    parts = F.slice(F.filter(F.transform(F.split(tail, " vs "), lambda p: F.trim(p)), lambda p: p != ""), 1, 4)
    plain = lambda p: F.trim(F.regexp_replace(p, rf"(?iu){BEFORE}(giua|khoa hoc|khóa học|lop|lớp|course|nen hoc|nên học){AFTER}", " "))
    names = F.filter(F.transform(parts, lambda p: F.trim(F.get(F.split(plain(p), r"[:;,.\n\-]", 2), F.lit(0)))), lambda p: p != "")
    return F.struct(F.transform(F.array_distinct(names), lambda p: F.substring(p, 1, 80)).alias("subjects"), criteria.alias("criteria"))


def ticket_args(col, phone):
    """struct(phone, name, preferred_time, intent_summary) of a request to be called; ``phone`` is the text's number. The summary is the text without it, blanks collapsed, 180 characters at most."""
    t = F.trim(F.coalesce(col, F.lit("")))
    own = F.regexp_extract(t, rf"(?iu){BEFORE}(?:tôi|toi|em|mình|minh|anh|chị|chi)\s+(?:là|la|tên|ten)\s+([^\n,;.]{{2,40}})", 1)
    plain = F.regexp_extract(strip_accents(t, map_d=True), rf"(?i){BEFORE}(?:toi|em|minh|anh|chi)\s+(?:la|ten)\s+([^\n,;.]{{2,40}})", 1)
    name = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.when(own != "", own).otherwise(plain)), r"\s+", " "), r"(?i)\b(sdt|phone|so dien thoai).*$", ""))
    n = norm_ascii(t)
    said = F.coalesce(*[F.when(n.contains(x), x) for x in TIMES])
    clock = lambda p, g: F.regexp_extract(t, p, g)
    exact, hour = r"(?i)\b([0-9]{1,2})[:h]([0-9]{2})\b", r"(?i)\b([0-9]{1,2})\s*h\b"
    at = F.when((clock(exact, 1) != "") & (clock(exact, 1).cast("int") <= 23) & (clock(exact, 2).cast("int") <= 59), F.concat(F.lpad(clock(exact, 1), 2, "0"), F.lit(":"), clock(exact, 2)))
    on = F.when((clock(hour, 1) != "") & (clock(hour, 1).cast("int") <= 23), F.concat(F.lpad(clock(hour, 1), 2, "0"), F.lit(":00")))
    rest = F.when(phone.isNotNull(), F.replace(t, phone, F.lit(""))).otherwise(t)
    summary = F.trim(F.substring(F.trim(F.regexp_replace(rest, r"\s+", " ")), 1, 180))
    return F.struct(phone.alias("phone"), F.nullif(name, F.lit("")).alias("name"), F.coalesce(said, at, on).alias("preferred_time"), summary.alias("intent_summary"))
