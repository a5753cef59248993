"""Screening of questions and answers: language, toxicity, prompt attacks, routing, criteria."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .textnorm import norm_ascii, strip_accents

# Word lists and patterns of the screening rules.
DIACRITICS = "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"
SHORT_ENGLISH = r"\b(price|tuition|schedule|fee|where|when|how|what)\b"
VIETNAMESE_HINTS = r"\b(hoc phi|lich hoc|khai giang|uu dai|tu van|dang ky|co so|chi nhanh)\b"
ENGLISH_WORDS = r"\b(the|a|an|is|are|do|does|how|what|where|when|price|tuition|schedule|fee)\b"
VIETNAMESE_WORDS = r"\b(hoc|phi|lich|khai|giang|uu|dai|tu|van|dang|ky)\b"
TOXIC_TOKENS = ("vcl", "dm", "dmm", "dit")
TOXIC_COMPACT = ("vcl", "dm", "dmm", "ditme")
TOXIC_PARTS = ("địt", "dit", "đụ", "lồn", "lon ", "cặc", "cak", "đm", "dm ", "vcl")
INJECTION_CUES = ("bo qua", "ignore", "khong can", "xac nhan luon", "tra loi gia", "khong theo tai lieu")
RAW_BLOCKS = (".env", "select *")
PROMPT_LEAK = (
    r"\bbo qua\b.*\bhuong dan\b",
    r"\bbo qua\b.*\bluat\b",
    r"\bbo qua\b.*\bquy tac\b",
    r"\bin ra\b.*\bsystem prompt\b",
    r"\bin ra\b.*\bhuong dan he thong\b",
    r"\bhien thi\b.*\bprompt\b",
    r"\bcho xem\b.*\bprompt\b",
    r"\bnoi dung\b.*\bsystem\b",
    r"\bhuong dan noi bo\b",
    r"\bchu dan noi bo\b",
    r"\bliet ke\b.*\bquy tac\b",
    r"\bignore\b.*\b(?:previous|above|all)\b.*\b(?:instruction|rule|prompt)\b",
    r"\bprint\b.*\bsystem prompt\b",
    r"\bshow\b.*\bsystem prompt\b",
    r"\breveal\b.*\b(?:instruction|prompt)\b",
    r"\bdisregard\b.*\b(?:instruction|rule|guideline|prompt)\b",
    r"\bdisregard\b.*\b(?:above|previous|all)\b",
    r"\bforget\b.*\b(?:instruction|rule|everything)\b",
    r"\byou are now\b",
    r"\bact as\b.*\b(?:developer|admin|root)\b",
    r"\bjailbreak\b",
    r"\bdan mode\b",
)
SOCIAL_ENGINEERING = (
    r"\bgiam doc\b",
    r"\bquan ly\b",
    r"\badmin\b.*\bbypass\b",
    r"\bbypass\b",
    r"\bvip\b.*\b(?:admin|code|password|mat khau)\b",
    r"\bmat khau\b",
    r"\bpassword\b",
    r"\bxac nhan\b.*\bgiam gia\b.*\b(?:1 vnd|0 dong|mien phi)\b",
    r"\bgiam gia\b.*\bcon\b.*\b(?:1 vnd|0 dong|1vnd|0dong)\b",
    r"\btoken\b.*\b(?:admin|bypass|master)\b",
    r"\bma\b.*\bbypass\b",
    r"\bem hay\b.*\bxac nhan\b.*\bgiam\b",
    r"\banh la\b.*\b(?:giam doc|sep|admin|quan ly)\b",
    r"\btoi la\b.*\b(?:giam doc|sep|admin|quan ly)\b",
)
DATA_EXFILTRATION = (
    r"\bdatabase\b.*\b(?:schema|dump|export)\b",
    r"\bapi[_ ]?key\b",
    r"\benv\b.*\bfile\b",
    r"\bfile\b.*\benv\b",
    r"\bexport\b.*\b(?:data|log|trace|user)\b",
    r"\bshow\b.*\b(?:data|log|trace|secret)\b",
    r"\bdump\b.*\b(?:data|memory|user|table)\b",
    r"\bsql\b.*\b(?:inject|query|select|drop)\b",
    r"\bselect\b.*\bfrom\b",
    r"\bdrop table\b",
)
SMALLTALK = ("xin chao", "chao ban", "hello", "hi ", "cam on", "bye", "ai day", "chao em", "ban la ai", "tro ly gi", "hey", "good morning", "good afternoon")
ANALYTICS = ("thống kê", "phân bố", "so sánh it", "bao nhiêu ứng viên", "ti lệ", "ti le", "analytics", "bieu do", "biểu đồ", "phần trăm", "phan tram")
BANK_HINTS = ("bank", "ngân hàng", "ngan hang")
IT_HINTS = ("it", "công nghệ", "cong nghe", "tech")


def any_of(col, parts):
    return reduce(lambda a, b: a | b, [col.contains(p) for p in parts])


def detect_language(col):
    """"vi" or "en"; Vietnamese unless English shows."""
    s = F.trim(F.coalesce(col, F.lit("")))
    n = F.regexp_replace(F.lower(strip_accents(s)), r"[^\x00-\x7F]", "x")  # other letters are letters at word ends too
    english, vietnamese = F.regexp_count(n, F.lit(ENGLISH_WORDS)), F.regexp_count(n, F.lit(VIETNAMESE_WORDS))
    short = (F.length(n) <= 12) & n.rlike(r"^[a-z0-9?!.\s]+$") & n.rlike(SHORT_ENGLISH)
    return F.when(F.lower(s).rlike(f"[{DIACRITICS}]"), "vi").when(short, "en").when(n.rlike(VIETNAMESE_HINTS), "vi").when((english > vietnamese) & (english >= 1), "en").otherwise("vi")


def is_toxic(col):
    tokens = F.regexp_extract_all(F.lower(strip_accents(F.coalesce(col, F.lit("")))), F.lit("([a-z0-9]+)"), F.lit(1))
    spelled = (F.size(tokens) >= 2) & F.forall(tokens, lambda t: F.length(t) == 1) & any_of(F.array_join(tokens, ""), TOXIC_COMPACT)
    return F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in TOXIC_TOKENS])) | spelled | any_of(F.lower(F.coalesce(col, F.lit(""))), TOXIC_PARTS)


def security_category(col):
    """"safe", or the first of the rule banks that the text meets."""
    raw, n = F.lower(F.coalesce(col, F.lit(""))), norm_ascii(col)
    bank = lambda patterns: n.rlike("|".join(f"(?:{p})" for p in patterns))
    return F.when(F.trim(raw) == "", "safe").when(any_of(raw, RAW_BLOCKS), "data_exfil").when(bank(PROMPT_LEAK), "prompt_leak").when(bank(SOCIAL_ENGINEERING), "social_engineering").when(bank(DATA_EXFILTRATION), "data_exfil").otherwise("safe")


def injection_cues(col):
    return any_of(norm_ascii(col), INJECTION_CUES)


def route_query(col):
    """struct(route, confidence, tenant)."""
    q = F.lower(F.coalesce(col, F.lit("")))
    small, stats = any_of(q, SMALLTALK) & (F.length(q) < 30), any_of(q, ANALYTICS)
    tenant = F.when(small | stats, F.lit(None).cast("string")).when(any_of(q, BANK_HINTS), "banking").when(any_of(q, IT_HINTS), "it")
    return F.struct(F.when(small, "general_chat").when(stats, "skills_analytics").otherwise("cv_search").alias("route"), F.when(small, 0.9).when(stats, 0.8).otherwise(0.9).alias("confidence"), tenant.alias("tenant"))


def parse_money(col):
    """An amount in VND from common notations (500k, 2 củ, 10tr, 10.5 triệu, 9.500.000 vnd); null where there is none."""
    raw = F.lower(F.trim(F.coalesce(col, F.lit(""))))
    for a, b in (("₫", "đ"), ("vnđ", "vnd"), ("đồng", "dong"), ("đ", "vnd")):
        raw = F.replace(raw, F.lit(a), F.lit(b))

    def scaled(pattern, factor):
        number = F.regexp_extract(raw, pattern, 1)
        return F.when(number != "", F.bround(F.replace(number, F.lit(","), F.lit(".")).cast("double") * factor).try_cast("long"))

    grouped = F.regexp_replace(F.regexp_extract(raw, r"(\d[\d., ]{4,})\s*(?:vnd|dong)\b", 1), r"\D", "")
    return F.coalesce(
        scaled(r"(?U)(\d+(?:[.,]\d+)?)\s*(?:k|nghin|ngan|ngàn|nghìn|canh|cành)\b", 1_000),
        scaled(r"(?U)(\d+(?:[.,]\d+)?)\s*(?:cu|củ)\b", 1_000_000),
        scaled(r"(?U)(\d+(?:[.,]\d+)?)\s*tr\b", 1_000_000),
        scaled(r"(\d+(?:[.,]\d+)?)\s*tri[eệ]u", 1_000_000),
        F.when(F.length(grouped) >= 5, grouped.try_cast("long")),
    )


def parse_grouped_vnd(col):
    """9.500.000 -> 9500000."""
    found = F.regexp_extract(col, r"(\d{1,3}(?:[.,]\d{3})+)", 1)
    return F.when(found != "", F.regexp_replace(found, "[.,]", "").try_cast("long"))


def format_vnd(col):
    return F.replace(F.format_number(col.cast("long"), 0), F.lit(","), F.lit("."))


def price_after_discount(base, fees, percent, cash, on_total):
    """Price after a percent or cash discount on tuition, or on tuition and fees; null where the discount is not valid."""
    total = base + fees
    basis = F.when(F.coalesce(on_total, F.lit(False)), total).otherwise(base)
    rest = F.when(F.coalesce(on_total, F.lit(False)), F.lit(0)).otherwise(fees)
    cut = F.when(percent.isNotNull(), F.bround(basis * percent / 100)).when(cash.isNotNull(), cash).otherwise(F.lit(0))
    bad = (percent <= 0) | (percent > 100) | (cash < 0) | (cash > basis)
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(None)).otherwise(basis - cut + rest).cast("long")


def heuristic_score(col):
    """A resume's score from length, figures and wording, 10 to 95."""
    raw, t = F.coalesce(col, F.lit("")), F.lower(F.coalesce(col, F.lit("")))
    hits = lambda words: sum((t.contains(w).cast("int") for w in words), F.lit(0))
    # Verbs that count for, and phrases that count against.
    verbs = ("led", "built", "shipped", "reduced", "improved", "managed", "designed", "architected", "mentored", "scaled", "optimized", "implemented")
    vague = ("various", "helped with", "responsible for", "assisted", "participated")
    figures = F.regexp_count(t, F.lit(r"\d+%|\d+x|\$\d+|[0-9]+\+"))
    score = 40 + F.when(F.length(raw) > 1500, 10).otherwise(0) + F.when(F.length(raw) > 3000, 5).otherwise(0) + F.least(figures * 3, F.lit(15)) + F.least(hits(verbs) * 2, F.lit(10)) - F.least(hits(vague) * 3, F.lit(10))
    return F.greatest(F.lit(10), F.least(F.lit(95), score))


def reconcile_score(parts: list, claimed):
    """Four parts clamped to 0-25 and added up; the claimed total where it is within 5 of that."""
    total = sum((F.greatest(F.lit(0), F.least(F.lit(25), F.coalesce(p, F.lit(0)))) for p in parts), F.lit(0))
    return F.when(F.abs(claimed - total) <= 5, claimed).otherwise(total)
