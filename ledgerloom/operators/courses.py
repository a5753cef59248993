"""Entities and their sections, courses, fees, policies and discounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import any_of, parse_grouped_vnd, parse_money
from ..functions.spans import AFTER, BEFORE, matches, number
from ..functions.textnorm import norm_ascii, strip_accents

# Words that tell a section's kind, words that name no course, and the phone shapes.
TUITION_WORDS = ("hoc phi", "phi", "uu dai", "hoc bong")
SCHEDULE_WORDS = ("lich", "khai giang", "gio hoc", "thoi gian hoc")
POLICY_WORDS = ("chinh sach", "quy dinh", "noi quy", "cam ket", "bao luu", "hoan phi")
BOOSTS = (("hoc phi", "phi", "uu dai"), ("lich", "khai giang", "gio hoc"), ("chinh sach", "quy dinh", "cam ket", "bao luu", "hoan phi"))
COURSE_STOP = ("khoa", "hoc", "phi", "lop", "gia", "bao", "nhieu", "trung", "tam", "course")
PHONE = r"(?<!\d)(?:\+?84|0)(?:[\s.-]?\d){8,10}(?!\d)"
MOBILE, LANDLINE = r"^0(3|5|7|8|9)\d{8}$", r"^02\d{9}$"


def section_kind(heading):
    h = norm_ascii(heading)
    return F.when(any_of(h, TUITION_WORDS), "tuition").when(any_of(h, SCHEDULE_WORDS), "schedule").when(any_of(h, POLICY_WORDS), "policy").otherwise("general")


def extract_phone(col):
    """The first number of a Vietnamese shape, +84 as 0; null where it is neither a mobile nor a landline number."""
    digits = F.regexp_replace(F.regexp_extract(F.coalesce(col, F.lit("")), PHONE, 0), r"\D", "")
    digits = F.when(digits.startswith("84"), F.concat(F.lit("0"), F.substring(digits, 3, 20))).otherwise(digits)
    return F.when(digits.rlike(MOBILE) | digits.rlike(LANDLINE), digits)


def _words(norm):
    return F.array_distinct(F.filter(F.split(norm, " "), lambda w: w != ""))


def score_entity_sections(entities: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc, entity, idx, score): 3 for each word shared with the heading, 1 with the body, more where the whole name stands there."""
    e = entities.select("doc", "entity", norm_ascii(F.col("entity")).alias("en")).where("en <> ''")
    s = sections.select("doc", "idx", norm_ascii(F.col("heading")).alias("hn"), _words(norm_ascii(F.substring("body", 1, 2000))).alias("bw"), norm_ascii(F.substring("body", 1, 3000)).alias("bn"))
    both = e.join(s, "doc").withColumn("in_head", F.size(F.array_intersect(_words(F.col("en")), _words(F.col("hn"))))).withColumn("in_body", F.size(F.array_intersect(_words(F.col("en")), F.col("bw"))))
    score = 3 * F.col("in_head") + F.col("in_body") + F.when(F.col("hn").contains(F.col("en")), 6).otherwise(0) + F.when(F.col("bn").contains(F.col("en")), 2).otherwise(0)
    for words in BOOSTS:
        score = score + F.when((F.col("in_body") > 0) & any_of(F.col("hn"), words), 1).otherwise(0)
    return both.select("doc", "entity", "idx", score.cast("double").alias("score"))


def top_sections(scored: DataFrame, k: int = 6) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("doc", "entity").orderBy(F.col("score").desc(), "idx"))
    return scored.where("score > 0").withColumn("rank", best).where(F.col("rank") <= k)


def general_sections(sections: DataFrame, used: DataFrame) -> DataFrame:
    """Sections of the general kind with a body that no entity uses, numbered in each document."""
    free = sections.join(used.select("doc", "idx").distinct(), ["doc", "idx"], "left_anti").where((section_kind(F.col("heading")) == "general") & (F.trim("body") != ""))
    return free.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy("idx")))


def refine_fees(df: DataFrame, least: int = 1_000_000) -> DataFrame:
    """A base under ``least`` is a fee; fees of ``least`` or more without a base are the base."""
    base, extra = F.coalesce("base", F.lit(0)), F.coalesce("extra", F.lit(0))
    small = (base > 0) & (base < least)
    extra = F.when(small, extra + base).otherwise(extra)
    base = F.when(small, 0).otherwise(base)
    swap = (base == 0) & (extra >= least)
    return df.withColumns({"base": F.when(swap, extra).otherwise(base).cast("long"), "extra": F.when(swap, 0).otherwise(extra).cast("long")})


def labelled_fee(amounts: DataFrame, key: str, amount: str = "amount") -> DataFrame:
    """(key, fee): the most frequent positive amount, ties to the largest; amounts below 2 million are rounded to thousands."""
    v = F.col(amount)
    rounded = F.when((v < 2_000_000) & (v % 1000 != 0), (F.bround(v / 1000) * 1000).cast("long")).otherwise(v)
    n = amounts.where(v > 0).groupBy(key, rounded.alias("v")).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.max_by("v", F.struct("n", "v")).alias("fee"))


def course_tokens(col):
    return F.slice(F.filter(F.split(norm_ascii(col), " "), lambda t: (F.length(t) >= 3) & ~t.isin(*COURSE_STOP)), 1, 6)


def match_course(queries: DataFrame, courses: DataFrame) -> DataFrame:
    """(query, course, hits): the course whose name shares most words with the query; ties go to the smaller id."""
    q = queries.select("query", F.explode(F.array_distinct(course_tokens(F.col("text")))).alias("t"))
    c = courses.select("course", F.explode(F.array_distinct(course_tokens(F.col("name")))).alias("t"))
    hits = q.join(c, "t").groupBy("query", "course").agg(F.count("*").alias("hits"))
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.col("hits").desc(), "course"))
    return hits.withColumn("r", first).where("r = 1").drop("r")


def recommend_course(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query, course, score): of the tenant's courses no longer than asked (and a quarter) and within the budget, the closest fit."""
    profile = ["tenant", "target", "budget"]
    # Queries that ask for the same are answered once.
    asked = queries.select(*profile).distinct()
    # A course that costs as much as another one of its tenant and duration, or more, and has a larger id never wins against it.
    front = Window.partitionBy("tenant", "months", F.col("fee").isNull()).orderBy("fee", "course").rowsBetween(Window.unboundedPreceding, -1)
    left = catalog.select("tenant", "months", "fee", "course").withColumn("least", F.min(F.struct("course")).over(front)).where(F.col("least").isNull() | (F.struct("course") < F.col("least"))).drop("least")
    fits = asked.join(left, "tenant").where("(months is null or target is null or months <= target + 0.25) and (fee is null or budget is null or fee <= budget)")
    near = F.when(F.col("months").isNotNull() & F.col("target").isNotNull(), F.greatest(F.lit(0), (10 - F.abs(F.col("months") - F.col("target")) * 3).cast("int"))).otherwise(0)
    cheap = F.when(F.col("fee").isNotNull() & F.col("budget").isNotNull(), F.greatest(F.lit(0), ((F.col("budget") - F.col("fee")) / 1_000_000).cast("int"))).otherwise(0)
    best = F.min(F.struct((-F.col("score")).alias("less"), "course")).alias("best")
    told = fits.withColumn("score", near + cheap).groupBy(*profile).agg(best).select(F.struct(*profile).alias("__of"), "best")
    rows = queries.join(told, F.struct(*profile).eqNullSafe(F.col("__of"))).select("query", "best")
    return rows.groupBy("query").agg(F.min("best").alias("best")).select("query", "best.course", (-F.col("best.less")).alias("score"))


def compare_entities_summary(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.min("fee").alias("fee_from"), F.max("fee").alias("fee_to"), F.min("months").alias("months_from"), F.max("months").alias("months_to"), F.array_join(F.array_sort(F.collect_set("target")), ",").alias("targets"))


def effective_policy(tenants: DataFrame, policies: DataFrame, defaults: dict) -> DataFrame:
    """Every tenant with its own values where it has them, else the defaults; ``origin`` names the default."""
    told = tenants.join(policies.withColumn("__own", F.lit(True)), "tenant", "left")
    return told.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}).withColumn("origin", F.when(F.col("__own"), F.col("tenant")).otherwise("_default")).drop("__own")


def resolve_discounts(discounts: DataFrame, policy: DataFrame) -> DataFrame:
    """(request, percent, amount): the highest of each kind, or their sums where the tenant combines; percent up to the tenant's most."""
    sums = discounts.groupBy("request", "tenant").agg(F.max("percent").alias("mp"), F.sum("percent").alias("sp"), F.max("amount").alias("ma"), F.sum("amount").alias("sa"))
    told = sums.join(policy, "tenant")
    both = F.col("stacking") == "combinable"
    pick = lambda s, m: F.coalesce(F.when(both, F.col(s)).otherwise(F.col(m)), F.lit(0))
    return told.select("request", F.least(pick("sp", "mp"), F.col("max_percent")).alias("percent"), pick("sa", "ma").cast("long").alias("amount"))


def price_range(bases: DataFrame, request: str = "request") -> DataFrame:
    """(request, low, high, final): of a request's prices after discount; one price is final, several are a range."""
    out = bases.where("price is not null").groupBy(request).agg(F.min("price").alias("low"), F.max("price").alias("high"))
    return out.withColumn("final", F.when(F.col("low") == F.col("high"), F.col("low")))


def combo_price(requests: DataFrame, courses: DataFrame, most: float = 50) -> DataFrame:
    """(request, base, percent, final): the price of the two courses that a request for a combo names best, after its percentage and with its fees.

    ``requests`` (request, text, percent, fees), ``courses`` (course, name, price). A course is named where two of its words of four letters or more
    stand in the text, or its only one. More words come first, then the higher price, then the smaller id. A percentage above ``most`` doesn't count; requests that
    name fewer than two courses have no row.
    """
    said = F.split(norm_ascii(F.col("text")), " ")
    asked = requests.select("request", F.explode(F.array_distinct(said)).alias("t"), (F.array_contains(said, "combo") & F.array_contains(said, "khoa")).alias("combo")).where("combo")
    words = courses.select("course", "price", F.filter(F.split(norm_ascii(F.col("name")), " "), lambda t: F.length(t) >= 4).alias("ts"))
    each = words.select("course", "price", F.size("ts").alias("n"), F.explode("ts").alias("t")).groupBy("course", "price", "n", "t").agg(F.count("*").alias("times"))
    hits = asked.join(each, "t").groupBy("request", "course", "price", "n").agg(F.sum("times").alias("hits")).where(F.col("hits") >= F.least(F.lit(2), F.col("n")))
    order = Window.partitionBy("request").orderBy(F.col("hits").desc(), F.col("price").desc(), "course")
    two = hits.withColumn("r", F.row_number().over(order)).where("r <= 2").groupBy("request").agg(F.sum("price").alias("base"), F.count("*").alias("n")).where("n = 2")
    percent = F.when((F.col("percent") > 0) & (F.col("percent") <= most), F.col("percent"))
    told = two.join(requests.select("request", "fees", percent.alias("percent")), "request")
    return told.select("request", "base", "percent", (F.col("base") - F.coalesce(F.bround(F.col("base") * F.col("percent") / 100), F.lit(0)) + F.coalesce("fees", F.lit(0))).cast("long").alias("final"))


def _fee(col):
    return F.coalesce(parse_money(col), parse_grouped_vnd(col))


def course_fees(texts: DataFrame, least: int = 1_000_000) -> DataFrame:
    """(tenant, pos, key, fee): the largest fee of each name in each text.

    A line with a colon names a course, without the words for one, and the first amount of ``least`` or more behind the colon or on the lines that follow is its
    fee. A blank line or another colon ends that; names below three characters name nothing.
    """
    lines = texts.select("tenant", "pos", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|[\n\r]")).alias("n", "line")).withColumn("line", F.trim("line"))
    colon = F.col("line").contains(":")
    left = F.regexp_replace(F.substring_index("line", ":", 1), rf"(?iu){BEFORE}(hoc phi|khoa|lop){AFTER}", " ")
    name = F.regexp_replace(F.regexp_replace(left, r"\s+", " "), r"^[ \-\t]+|[ \-\t]+$", "")
    amount = _fee(F.when(colon, F.regexp_replace("line", r"^[^:]*:", "")).otherwise(F.col("line")))
    parts = Window.partitionBy("tenant", "pos").orderBy("n")
    told = lines.select("tenant", "pos", "n", F.sum((colon | (F.col("line") == "")).cast("int")).over(parts).alias("part"), F.when(colon & (F.length(name) >= 3), norm_ascii(name)).alias("key"), F.when(amount >= least, amount).alias("fee"))
    first = told.groupBy("tenant", "pos", "part").agg(F.min_by("key", "n").alias("key"), F.min_by("fee", F.when(F.col("fee").isNotNull(), F.col("n"))).alias("fee"))
    return first.where("key <> '' and fee is not null").groupBy("tenant", "pos", "key").agg(F.max("fee").alias("fee"))


def course_catalog(texts: DataFrame) -> DataFrame:
    """(tenant, key, name, months, fee): courses with a duration ("1.2. Name (6 tháng)") and courses with a fee, as one; of several texts the last one that tells a value counts."""
    plain = strip_accents(F.coalesce("text", F.lit("")), map_d=True)
    titled = matches(plain, rf"(?iu){BEFORE}[0-9]+\.[0-9]+\.\s*[^(\n]{{3,80}}\([0-9]+(?:[.,][0-9]+)?\s*thang{AFTER}")
    each = texts.select("tenant", "pos", F.posexplode(titled).alias("n", "m")).select("tenant", "pos", "n", F.regexp_replace(F.trim(F.regexp_extract("m.text", r"^[0-9]+\.[0-9]+\.\s*([^(\n]{3,80})\(", 1)), r"\s+", " ").alias("name"), number(F.regexp_extract("m.text", r"\(([0-9]+(?:[.,][0-9]+)?)", 1)).alias("months"))
    each = each.where("name <> ''").withColumn("key", norm_ascii(F.col("name")))
    durations = each.groupBy("tenant", "key").agg(F.min_by("name", F.struct("pos", "n")).alias("name"), F.max_by("months", F.struct("pos", "n")).alias("months"))
    fees = course_fees(texts).groupBy("tenant", "key").agg(F.max_by("fee", "pos").alias("fee"))
    both = durations.join(fees, ["tenant", "key"], "full_outer")
    return both.select("tenant", "key", F.initcap(F.lower(F.coalesce("name", "key"))).alias("name"), "months", "fee")
