"""Figures about a corpus of resumes or other documents, and reviews of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def corpus_text_stats(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """(by, n, mean, median, least, most, deviation, words): of characters, overall (by null) and for each group, in one pass."""
    rows = docs.select(F.col(by), F.length(text).alias("chars"), F.regexp_count(text, F.lit(r"\S+")).alias("words"))
    stats = rows.rollup(by).agg(F.count("*").alias("n"), F.round(F.avg("chars"), 3).alias("mean"), F.round(F.percentile("chars", 0.5), 3).alias("median"), F.min("chars").alias("least"), F.max("chars").alias("most"), F.round(F.stddev("chars"), 3).alias("deviation"), F.sum("words").alias("words"))
    return stats


def extraction_quality(docs: DataFrame, text: str = "text", short: int = 100) -> DataFrame:
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return docs.agg(F.count("*").alias("n"), F.count_if(n == 0).alias("empty"), F.count_if((n > 0) & (n < short)).alias("scanned"), F.count_if(n >= short).alias("text_based"))


def page_histogram(docs: DataFrame, pages: str) -> DataFrame:
    return docs.groupBy(F.col(pages).alias("pages")).agg(F.count("*").alias("n"))


#: Patterns whose presence is counted.
ENTITIES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "phone": r"\+?[0-9][0-9 ().-]{7,}[0-9]", "url": r"https?://|www\.", "education": r"(?i)university|college|degree|bachelor|master"}


def entity_rates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: how many documents hold each kind, and the percentage."""
    counts = [F.count_if(F.col(text).rlike(p)).alias(f"n_{k}") for k, p in ENTITIES.items()]
    rates = [F.round(F.avg(F.col(text).rlike(p).cast("double")) * 100, 3).alias(f"pct_{k}") for k, p in ENTITIES.items()]
    return docs.agg(*counts, *rates)


def top_terms(docs: DataFrame, by: str, terms: list[str], k: int = 15, text: str = "text") -> DataFrame:
    """(by, term, n, rank): in how many documents of a group each dictionary term stands as a word; the first ``k``."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    found = docs.select(F.col(by), F.explode(F.array_intersect(words, F.array(*[F.lit(t) for t in terms]))).alias("term"))
    n = found.groupBy(by, "term").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col("n").desc(), "term"))).where(F.col("rank") <= k)


def line_counts(docs: DataFrame, least: int = 2, text: str = "text") -> DataFrame:
    """(line, n): how many documents hold a line, for lines that ``least`` documents hold; blank lines don't count."""
    lines = docs.select(F.explode(F.array_distinct(F.split(text, "\n", -1))).alias("line")).where(F.trim("line") != "")
    return lines.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def quality_issues(docs: DataFrame, by: str, text: str = "text", short: int = 200, long: int = 20_000) -> DataFrame:
    """(by, n, garbled, very_short, very_long)."""
    n = F.length(F.coalesce(text, F.lit("")))
    return docs.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(text).rlike("\\uFFFD|[*#$%&!]{3}")).alias("garbled"), F.count_if(n < short).alias("very_short"), F.count_if(n > long).alias("very_long"))


def compare_sources(a: DataFrame, b: DataFrame, by: str, length: str) -> DataFrame:
    side = lambda df, s: df.groupBy(by).agg(F.count("*").alias(f"n_{s}"), F.round(F.avg(length), 3).alias(f"mean_{s}"))
    return side(a, "a").join(side(b, "b"), by, "full_outer")


def ai_flags(replies: DataFrame, reply: str = "reply") -> DataFrame:
    return replies.withColumn("is_ai", F.upper(reply).contains("TRUE"))


def batch_inputs(df: DataFrame, order: str, size: int = 5, parts: int = 64) -> DataFrame:
    """``df`` with ``batch`` and ``place`` in it, by position in the order of a unique ``order`` column.

    Rows are numbered within ranges of the order, and the ranges' counts (``parts`` rows) give what comes before each, so that no task sees all rows.
    """
    bounds = df.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10_000).alias("b")).select(F.array_distinct("b").alias("__bounds"))
    ranged = df.join(F.broadcast(bounds)).withColumn("__part", F.coalesce(F.size(F.filter("__bounds", lambda x: x < F.col(order))), F.lit(0))).drop("__bounds")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    at = F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    numbered = ranged.join(F.broadcast(before), "__part").withColumn("__at", at)
    return numbered.withColumn("batch", F.floor(F.col("__at") / size).cast("long")).withColumn("place", (F.col("__at") % size).cast("long")).drop("__part", "__before", "__at")


def complete_batch(inputs: DataFrame, scored: DataFrame, key: str = "id") -> DataFrame:
    """Every input with its first result by ``pos``; where there is none: role Candidate, score 50."""
    first = scored.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where("__n = 1").select(key, "role", "score")
    return inputs.join(first, key, "left").withColumn("role", F.coalesce("role", F.lit("Candidate"))).withColumn("score", F.coalesce("score", F.lit(50)))


def leaderboard(df: DataFrame, by: str, score: str = "score", key: str = "id") -> DataFrame:
    return df.withColumn("place", F.rank().over(Window.partitionBy(by).orderBy(F.col(score).desc())))


def validate_annotations(df: DataFrame, text: str, notes: str = "notes", most: int = 10) -> DataFrame:
    """``notes`` kept: bonus or penalty, with a tip, whose text stands in the resume in any case; the text as the resume writes it."""
    known = F.filter(notes, lambda a: a["kind"].isin("bonus", "penalty") & (F.coalesce(a["tip"], F.lit("")) != "") & (F.instr(F.lower(F.col(text)), F.lower(a["text"])) > 0))
    real = F.transform(known, lambda a: F.struct(F.substring(F.col(text), F.instr(F.lower(F.col(text)), F.lower(a["text"])), F.length(a["text"])).alias("text"), a["kind"].alias("kind"), a["tip"].alias("tip")))
    return df.withColumn(notes, F.slice(real, 1, most))
