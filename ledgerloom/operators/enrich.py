"""Course documents: numbered sections, sections ranked into four buckets against each other, and courses made regular."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import parse_tuition
from ..functions.guards import any_of
from ..functions.spans import AFTER, BEFORE
from ..functions.textnorm import strip_accents
from .kmaps import RULE
from .sections import strip

# The words of each bucket, the numbers of its section in documents that follow the template, and what stands for a missing opening date.
BUCKETS = {
    "course_info": ("khoa hoc", "lo trinh", "muc tieu", "dau vao", "dau ra", "cap do", "chuong trinh", "ielts", "toeic", "cefr", "cambridge", "starters", "movers", "flyers", "ket", "pet", "giao tiep"),
    "tuition": ("hoc phi", "phi", "le phi", "phi tai lieu", "tai lieu", "uu dai", "giam", "khuyen mai", "dong", "vnd", "trieu"),
    "policy": ("chinh sach", "quy dinh", "cam ket", "noi quy", "bao luu", "hoan phi", "hoan tien", "doi lop", "chuyen lop", "hoc vien"),
    "schedule": ("lich", "khai giang", "lich hoc", "thoi khoa bieu", "thu", "ca hoc", "gio hoc", "buoi", "tuan", "ngay"),
}
NUMBERS = {"course_info": 5, "tuition": 6, "policy": 8, "schedule": 10}
NO_OPENING = "Liên hệ để cập nhật lịch mới nhất"


def _hits(norm, words):
    """For each word that stands in the text 2, and 1 for each time it does, up to 8."""
    return sum((F.when(norm.contains(w), 2 + F.least(F.lit(8), F.regexp_count(norm, F.lit(w)))).otherwise(0) for w in words), F.lit(0))


def bucket_scores(heading, body):
    """struct of a section's score for each bucket: words anywhere once, in the heading twice more, and signs of money, dates and times."""
    norm = lambda c: F.lower(strip_accents(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")))
    head = norm(heading)
    text = F.concat(head, F.lit("\n"), norm(body))
    money = text.rlike(rf"{BEFORE}(vnd|đ|dong|trieu){AFTER}") | text.rlike(r"[0-9][0-9., ]{3,}\s*(đ|vnd|dong)")
    date = text.rlike(rf"{BEFORE}[0-9]{{1,2}}[/-][0-9]{{1,2}}([/-][0-9]{{2,4}})?{AFTER}") | text.contains("khai giang")
    time = text.rlike(rf"{BEFORE}[0-9]{{1,2}}[:h][0-9]{{0,2}}(?:(?<=[0-9h]){AFTER}|(?<=:)(?=[\p{{L}}\p{{N}}_]))")
    extra = {"tuition": F.when(money, 6).otherwise(0), "schedule": F.when(date, 5).otherwise(0) + F.when(time, 2).otherwise(0)}
    return F.struct(*[(_hits(text, w) + 2 * _hits(head, w) + extra.get(b, F.lit(0))).cast("double").alias(b) for b, w in BUCKETS.items()])


def bucket_sections(sections: DataFrame, top: int = 4, share: float = 0.7) -> DataFrame:
    """(doc, bucket, rank, idx, raw, adjusted): for each bucket of a document its ``top`` sections by their own score less ``share`` of the best other bucket's, if above 0."""
    scored = sections.select("doc", "idx", bucket_scores(F.col("heading"), F.col("body")).alias("s"))
    best_other = lambda b: F.greatest(*[F.col(f"s.{x}") for x in BUCKETS if x != b])
    each = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"s.{b}").alias("raw"), F.round(F.col(f"s.{b}") - share * best_other(b), 6).alias("adjusted")) for b in BUCKETS])
    rows = scored.select("doc", "idx", F.explode(each).alias("e")).select("doc", "e.bucket", "idx", "e.raw", "e.adjusted").where("adjusted > 0")
    order = Window.partitionBy("doc", "bucket").orderBy(F.col("adjusted").desc(), "idx")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def bucket_texts(ranked: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc, bucket, text): the ranked sections of each bucket with their scores, one after the other."""
    told = ranked.join(sections.select("doc", "idx", "heading", "body"), ["doc", "idx"])
    part = F.concat(F.lit("["), "heading", F.format_string("] (score=%.0f, adj=%.1f)\n", F.col("raw"), F.col("adjusted")), "body")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("t")))), lambda x: x["t"]), RULE)
    return told.groupBy("doc", "bucket").agg(strip(joined).alias("text"))


def numbered_section(col, n: int):
    """From the line that begins section ``n`` ("Mục n", or the number with a mark) to the one that begins the next; empty where there is none."""
    text = F.coalesce(col, F.lit(""))
    begins = lambda k: (rf"(?iumd)^\s*m[uụ]c\s*0*{k}{AFTER}.*$", rf"(?iumd)^\s*0*{k}\s*[).\-:]\s+.*$")
    first = lambda t, patterns: F.coalesce(*[F.when(t.rlike(p), F.length(F.get(F.split(t, p, 2), F.lit(0)))) for p in patterns])
    start = first(text, begins(n))
    rest = F.substr(text, start + 2)
    return F.coalesce(strip(F.substr(text, start + 1, F.coalesce(first(rest, begins(n + 1)), F.length(rest)) + 1)), F.lit(""))


def template_buckets(docs: DataFrame) -> DataFrame:
    """(doc, bucket, text): the four numbered sections of a document; one without any of them has its whole text as course information."""
    found = docs.select("doc", "text", *[numbered_section(F.col("text"), n).alias(b) for b, n in NUMBERS.items()])
    none = F.concat(*[F.col(b) for b in NUMBERS]) == ""
    found = found.withColumn("course_info", F.when(none, strip(F.coalesce("text", F.lit("")))).otherwise(F.col("course_info")))
    return found.select("doc", F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(b).alias("text")) for b in NUMBERS])).alias("e")).select("doc", "e.*")


def fill_missing_buckets(template: DataFrame, heuristic: DataFrame, least: int = 2) -> DataFrame:
    """``template`` (doc, bucket, text) with the empty buckets of documents that lack ``least`` or more taken from ``heuristic``."""
    blank = strip(F.coalesce("text", F.lit(""))) == ""
    rows = template.withColumn("__blank", blank).withColumn("__n", F.sum(F.col("__blank").cast("int")).over(Window.partitionBy("doc")))
    told = rows.join(heuristic.select("doc", "bucket", F.col("text").alias("__other")), ["doc", "bucket"], "left")
    return told.select("doc", "bucket", F.when(F.col("__blank") & (F.col("__n") >= least), F.coalesce("__other", F.lit(""))).otherwise(F.coalesce("text", F.lit(""))).alias("text"))


def normalize_courses(courses: DataFrame) -> DataFrame:
    """(tenant, course_id, content, category, tuition, next_opening): ids begin with their tenant, the tenant is the category where none is given, tuition is read
    as an amount, and a text stands for a missing opening. Courses without an id or content are left out."""
    lower, tenant = F.lower("course_id"), F.col("tenant")
    slug = F.regexp_replace(F.regexp_replace(lower, "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    own = F.when(lower.startswith(F.concat(F.lower("tenant"), F.lit(":"))), F.col("course_id")).otherwise(F.concat(tenant, F.lit(":"), F.when(slug != "", slug).otherwise(lower)))
    given = lambda c, other: F.when(strip(F.coalesce(c, F.lit(""))) != "", F.col(c)).otherwise(other)
    kept = courses.where((strip(F.coalesce("course_id", F.lit(""))) != "") & (strip(F.coalesce("content", F.lit(""))) != ""))
    return kept.select("tenant", own.alias("course_id"), strip(F.col("content")).alias("content"), given("category", tenant).alias("category"), parse_tuition(F.col("tuition")).alias("tuition"), given("next_opening", F.lit(NO_OPENING)).alias("next_opening"))
