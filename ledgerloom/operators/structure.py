"""Pages, sections and chunks, as array columns of one row or one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_pages(pages: DataFrame) -> DataFrame:
    """(source, text, n_pages): pages that aren't blank, in page order, joined by a blank line."""
    kept = pages.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return kept.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n\n").alias("text"), F.count("*").alias("n_pages"))


def scanned_docs(pages: DataFrame, least: float = 50) -> DataFrame:
    """(source, mean_chars, scanned): documents whose pages hold fewer than ``least`` characters on average."""
    out = pages.groupBy("source").agg(F.round(F.avg(F.length(F.trim(F.coalesce("text", F.lit(""))))), 6).alias("mean_chars"))
    return out.withColumn("scanned", F.col("mean_chars") < least)


def best_extraction(*texts, least: int = 100):
    """The first text of more than ``least`` characters, else the first that isn't blank."""
    strip = [F.trim(F.coalesce(t, F.lit(""))) for t in texts]
    long = [F.when(F.length(s) > least, s) for s in strip]
    some = [F.when(s != "", s) for s in strip]
    return F.coalesce(*long, *some, F.lit(""))


def html_to_markdown(col):
    """Headings as # lines, other tags as blanks; enough for pages that stand for documents."""
    out = col
    for n in range(1, 7):
        out = F.regexp_replace(F.regexp_replace(out, f"<h{n}[^>]*>", "\n" + "#" * n + " "), f"</h{n}>", "\n")
    return F.regexp_replace(out, "<[^>]+>", " ")


def looks_like_markdown(col):
    return col.rlike(r"(?m)^#{1,6} \S") | col.contains("\n- ") | col.contains("\n* ") | col.contains("|")


def split_markdown(df: DataFrame, key: str, text: str = "text", level: int = 2, default: str = "Document") -> DataFrame:
    """(key, idx, heading, body): cut at headings of one level, whose line stays in the body; what comes before is ``default``."""
    mark = "#" * level
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), rf"\n(?={mark}[ \t]+\S)", -1), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    rows = df.select(F.col(key), F.posexplode(parts).alias("idx", "part"))
    first = F.regexp_extract("part", rf"^{mark}[ \t]+([^\n]+)", 1)
    return rows.select(key, F.col("idx").cast("long").alias("idx"), F.when(F.trim(first) != "", F.trim(first)).otherwise(default).alias("heading"), F.regexp_replace("part", r"^\s+|\s+$", "").alias("body"))


def parse_sections(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, idx, level, heading, body): cut at headings of every level, whose line isn't in the body."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), r"\n(?=#{1,6}[ \t]+\S)", -1), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    rows = df.select(F.col(key), F.posexplode(parts).alias("idx", "part"))
    head = F.regexp_extract("part", r"^(#{1,6})[ \t]+([^\n]+)", 1)
    body = F.when(head != "", F.regexp_replace("part", r"^#{1,6}[ \t]+[^\n]+", "")).otherwise(F.col("part"))
    return rows.select(key, F.col("idx").cast("long").alias("idx"), F.length(head).cast("long").alias("level"), F.trim(F.regexp_extract("part", r"^(#{1,6})[ \t]+([^\n]+)", 2)).alias("heading"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))


def chunk_chars(df: DataFrame, key: str, text: str = "text", size: int = 800, overlap: int = 100) -> DataFrame:
    """(key, chunk, text): windows of ``size`` characters, ``size - overlap`` apart; the stripped text is what is cut."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the chunk")
    step = size - overlap
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    rows = df.select(F.col(key), t.alias("__t")).where("__t <> ''")
    t = F.col("__t")
    n = F.when(F.length(t) <= size, 1).otherwise(F.ceil((F.length(t) - size) / step) + 1).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(t, i * step + 1, F.lit(size)))
    return rows.select(key, F.posexplode(cut).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("long"))


def add_breadcrumb(stem, heading, text):
    return F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), stem, F.lit(" > "), heading, F.lit("]\n"), text))


def node_ids(tenant, section, chunk):
    """tenant:section:chunk, counted from 1."""
    return F.concat_ws(":", tenant, (section + 1).cast("string"), (chunk + 1).cast("string"))


def attach_metadata(nodes: DataFrame, meta: DataFrame, stem: str = "stem") -> DataFrame:
    return nodes.join(meta, stem, "left")


def merge_resume_metadata(flags: DataFrame, entities: DataFrame) -> DataFrame:
    """(resume_id, is_ai, skills, years): both sides' rows; empty skills are left out."""
    told = flags.join(entities, "resume_id", "full_outer")
    return told.select("resume_id", "is_ai", F.when(F.col("skills") != "", F.col("skills")).alias("skills"), "years")


def budget_sections(df: DataFrame, group: str, length: str, most: int = 24_000, each: int = 8_000, least: int = 1_200) -> DataFrame:
    """``df`` with ``allowed``: lengths clamped to ``each``; where a group's sum is over ``most``, ``least`` each and the rest in proportion."""
    from pyspark.sql import Window

    w = Window.partitionBy(group)
    clamped = F.least(F.col(length), F.lit(each))
    total, small = F.sum(clamped).over(w), F.sum(F.least(clamped, F.lit(least))).over(w)
    base = F.least(clamped, F.lit(least))
    spare = F.greatest(F.lit(0), F.lit(most) - small)
    share = F.floor(spare * (clamped - base) / F.greatest(total - small, F.lit(1)))
    return df.withColumn("allowed", F.when(total <= most, clamped).otherwise(F.least(clamped, base + share)).cast("long"))


def section_preview(nodes: DataFrame, key: str, size: int = 800) -> DataFrame:
    return nodes.groupBy(key).agg(F.count("*").alias("n_nodes"), F.sum(F.length("text")).alias("n_chars"), F.substring(F.min_by("text", "chunk"), 1, size).alias("preview"))
