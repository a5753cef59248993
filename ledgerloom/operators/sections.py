"""Sections of plain text, chunks that end at line breaks, and what of a section concerns an entity."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import let
from ..functions.textnorm import norm_ascii
from .structure import looks_like_markdown, split_markdown

# What a heading looks like, the name of a section without one, and words for money and time.
NUMBERED = r"^[0-9]+(\.[0-9]+){0,3}\s*[)\.\-]\s+\S"
ROMAN = r"^(?i)[IVXLCDM]{1,8}\s*[)\.\-]\s+\S"
LABEL = r"^(?iu)(PHẦN|CHƯƠNG|MỤC|CHUYÊN ĐỀ|GIỚI THIỆU)(?![\p{L}\p{N}_])"
NO_HEADING = "Thông tin chung"
MONEY_OR_TIME = r"(?iu)(₫|vnd|dong|trieu|tr|thang|tháng|tuan|tuần|ielts|toeic|a1|a2|b1|b2|c1|c2)"
CUT = "\n...[TRUNCATED]..."


def strip(col):
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def is_heading(line):
    """Numbered or labelled lines, lines of capitals, and short lines that end in a colon; none of more than 90 characters. ``line`` is stripped."""
    words = F.size(F.split(line, r"\s+"))
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    small = F.length(F.regexp_replace(line, r"[^\p{Ll}]", ""))
    capitals = (letters >= 6) & ((letters - small) * 100 >= letters * 85) & (words <= 12)
    looks = line.rlike(NUMBERED) | line.rlike(ROMAN) | line.rlike(LABEL) | capitals | (line.endswith(":") & (words <= 10))
    return (line != "") & (F.length(line) <= 90) & looks


def split_plaintext(df: DataFrame, key: str, text: str = "text", least: int = 80) -> DataFrame:
    """(key, idx, heading, body): cut at heading lines, which stay in the body; a section below ``least`` characters joins the one before it."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]")).alias("n", "line"))
    lines = lines.select(key, "n", F.regexp_replace("line", r"\s+$", "").alias("line"))
    order = Window.partitionBy(key).orderBy("n")
    lines = lines.withColumn("head", is_heading(strip(F.col("line")))).withColumn("s", F.sum(F.col("head").cast("int")).over(order))
    parts = lines.groupBy(key, "s").agg(F.array_sort(F.collect_list(F.struct("n", "line", "head"))).alias("ls"))
    first = F.col("ls")[0]
    heading = strip(F.regexp_replace(strip(first["line"]), "^#+|#+$", ""))
    parts = parts.select(key, "s", F.when(first["head"] & (heading != ""), heading).otherwise(NO_HEADING).alias("heading"), strip(F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("body")).where("body <> ''")
    order = Window.partitionBy(key).orderBy("s")
    own = (F.row_number().over(order) == 1) | (F.length("body") >= least)
    parts = parts.withColumn("own", own.cast("int")).withColumn("idx", F.sum("own").over(order) - 1)
    merged = parts.groupBy(key, "idx").agg(F.array_sort(F.collect_list(F.struct("s", "heading", "body"))).alias("p"))
    return merged.select(key, "idx", F.col("p")[0]["heading"].alias("heading"), F.array_join(F.transform("p", lambda x: x["body"]), "\n\n").alias("body"))


def split_sections(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, idx, heading, body): by markdown headings where a text looks like markdown, by heading lines otherwise."""
    markdown = F.coalesce(looks_like_markdown(F.col(text)), F.lit(False))
    return split_markdown(df.where(markdown), key, text).unionByName(split_plaintext(df.where(~markdown), key, text))


def render_markdown(sections: DataFrame, key: str) -> DataFrame:
    """(key, text): sections in order under their headings; a body's first line goes where it is the heading again."""
    plain = lambda c: F.lower(strip_marks(strip(c)))
    body = strip(F.col("body"))
    first = F.substring_index(body, "\n", 1)
    rest = F.when(plain(first) == plain(F.col("heading")), strip(F.substr(body, F.length(first) + 2))).otherwise(body)
    rows = sections.where(body != "").select(key, "idx", F.concat(F.lit("## "), strip(F.col("heading")), F.lit("\n\n"), rest, F.lit("\n")).alias("t"))
    joined = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "t"))), lambda x: x["t"]), "\n").alias("t"))
    return joined.select(key, F.concat(strip(F.concat(F.lit("# Extracted Markdown: "), F.col(key).cast("string"), F.lit("\n\n"), F.col("t"))), F.lit("\n")).alias("text"))


def strip_marks(col):
    from ..functions.textnorm import strip_accents

    return strip_accents(col)


def relevant_lines(text, entity, most: int = 16, cap: int = 2200):
    """Lines that name a word of the entity with the two after each; without any, the first ``most`` lines on money or time. Cut at ``cap`` characters."""
    # Every value that a lambda reads is bound: it would be worked out for each line again.
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]")
    words = F.filter(F.split(norm_ascii(entity), " "), lambda w: w != "")
    hits = lambda x: F.transform(x["lines"], lambda line: let(norm_ascii(line), lambda n: F.exists(x["words"], n.contains)))

    def chosen(x):
        near = lambda i, k: F.coalesce(F.get(x["hits"], i - k), F.lit(False))
        kept = F.filter(x["lines"], lambda line, i: near(i, 0) | near(i, 1) | near(i, 2))
        other = F.slice(F.filter(x["lines"], lambda line: line.rlike(MONEY_OR_TIME)), 1, most)
        told = F.when(F.exists(x["hits"], lambda hit: hit), kept).otherwise(other)
        return strip(F.array_join(F.filter(told, lambda line: strip(line) != ""), "\n"))

    cut = lambda out: F.when(F.length(out) > cap, F.concat(F.regexp_replace(F.substring(out, 1, cap), r"\s+$", ""), F.lit(CUT))).otherwise(out)
    bound = F.struct(lines.alias("lines"), words.alias("words"))
    return let(let(let(bound, lambda x: F.struct(x["lines"].alias("lines"), hits(x).alias("hits"))), chosen), cut)


def _units(paragraph, most: int):
    """A paragraph's sentences, those above ``most`` characters cut into pieces of that size."""
    sentences = F.filter(F.transform(F.split(paragraph, r"(?<=[.!?])\s+"), strip), lambda t: t != "")
    pieces = lambda t: F.transform(F.sequence(F.lit(0), F.ceil(F.length(t) / most).cast("int") - 1), lambda i: strip(F.substr(t, i * most + 1, F.lit(most))))
    return F.filter(F.flatten(F.transform(sentences, pieces)), lambda t: t != "")


def packed(col, most: int, least: int):
    """The pieces of a text: its paragraphs, or the sentences of a paragraph above ``most`` characters, put together in order while they fit.

    A unit is (text, what joins it to the one before, room that must be left, lane); units of different lanes don't join. One fold over the units grows the
    last piece or begins another. The last piece joins the one before it where it is below ``least`` characters.
    """
    t = strip(F.coalesce(col, F.lit("")))
    unit = lambda text, gap, room, lane: F.struct(text.alias("text"), F.lit(gap).alias("gap"), F.lit(room).alias("room"), lane.alias("lane"))
    paragraphs = F.filter(F.transform(F.split(t, r"\n{2,}"), strip), lambda p: p != "")
    whole = lambda p: F.array(unit(p, "\n\n", 2, F.lit(-1)))
    units = F.flatten(F.transform(paragraphs, lambda p, i: F.when(F.length(p) <= most, whole(p)).otherwise(F.transform(_units(p, most), lambda s: unit(s, " ", 0, i)))))

    def grow(acc, u):
        fits = (acc["lane"] == u["lane"]) & (F.length(acc["held"]) + F.length(u["gap"]) + F.length(u["text"]) + u["room"] <= most)
        done = F.when(fits | (acc["held"] == ""), acc["done"]).otherwise(F.array_append(acc["done"], acc["held"]))
        return F.struct(done.alias("done"), F.when(fits, F.concat(acc["held"], u["gap"], u["text"])).otherwise(u["text"]).alias("held"), u["lane"].alias("lane"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.lit(-2).alias("lane"))
    out = F.aggregate(units, start, grow, lambda acc: F.filter(F.array_append(acc["done"], acc["held"]), lambda x: x != ""))
    n = F.size(out)
    merged = F.array_append(F.slice(out, F.lit(1), n - 2), F.concat(F.get(out, n - 2), F.lit("\n\n"), F.get(out, n - 1)))
    return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) <= most, F.array(t)).when((n >= 2) & (F.length(F.get(out, n - 1)) < least), merged).otherwise(out)


def sentence_chunks(col, size: int, overlap: int):
    """The chunks of a text: sentences put together up to ``size`` characters. A chunk begins with the last whole sentences of the one before, up to
    ``overlap`` characters and as far as they leave room. A sentence above ``size`` characters is cut into windows that overlap, and nothing is carried on from it."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the chunk")
    none = F.array().cast("array<string>")
    sentences = F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), r"(?<=[.!?])\s+"), strip), lambda t: t != "")
    joined = lambda xs: F.array_join(xs, " ")
    windows = lambda t: F.transform(F.sequence(F.lit(0), F.ceil((F.length(t) - size) / (size - overlap)).cast("int")), lambda i: F.substr(t, i * (size - overlap) + 1, F.lit(size)))

    def step(acc, t):
        held = acc["held"]
        long, fits = F.length(t) > size, F.length(joined(F.array_append(held, t))) <= size
        tail = lambda i: F.length(joined(F.slice(held, i + 1, F.size(held))))
        carried = F.filter(held, lambda x, i: (tail(i) <= overlap) & (tail(i) + 1 + F.length(t) <= size))
        done = F.when(fits | (F.size(held) == 0), acc["done"]).otherwise(F.array_append(acc["done"], joined(held)))
        return F.struct(F.when(long, F.concat(done, windows(t))).otherwise(done).alias("done"), F.when(long, none).when(fits, F.array_append(held, t)).otherwise(F.array_append(carried, t)).alias("held"))

    end = lambda acc: F.when(F.size(acc["held"]) > 0, F.array_append(acc["done"], joined(acc["held"]))).otherwise(acc["done"])
    return F.aggregate(sentences, F.struct(none.alias("done"), none.alias("held")), step, end)


def _last(stops: np.ndarray, low: int, high: int) -> int:
    """The last of the sorted ``stops`` above ``low`` and not above ``high``, or 0."""
    i = int(np.searchsorted(stops, high, "right"))
    return int(stops[i - 1]) if i and stops[i - 1] > low else 0


def _windows(text: str, size: int, overlap: int, part: float = 0.6) -> list[str]:
    """Windows over the places after line breaks and after blanks: one ends at the last such place behind its first ``part``."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    breaks, blanks = np.flatnonzero(code == 10) + 1, np.flatnonzero((code == 32) | (code == 9)) + 1
    spans, at = [], 0
    while at + size < len(code):
        end = _last(breaks, at + int(size * part), at + size) or _last(blanks, at + int(size * part), at + size) or at + size
        spans.append((at, end))
        at = max(at + 1, end - overlap)
    return [piece for a, b in [*spans, (at, len(code))] if (piece := text[a:b].strip())]


def chunk_smart(df: DataFrame, key: str, text: str = "text", size: int = 800, overlap: int = 100) -> DataFrame:
    """(key, chunk, text): windows of ``size`` characters that end at the last line break, or else blank, of their last two fifths."""

    @F.arrow_udf("array<string>")
    def pieces(texts: pa.Array) -> pa.Array:
        return pa.array([_windows(re.sub(r"\r\n?", "\n", x.as_py() or "").strip(), size, overlap) for x in texts], pa.list_(pa.string()))

    return df.select(key, F.posexplode(pieces(F.col(text))).alias("chunk", "text"))


def chunk_sentences(df: DataFrame, key: str, text: str = "text", size: int = 800, overlap: int = 100) -> DataFrame:
    """(key, chunk, text): ``sentence_chunks`` of each text, numbered from 0; null and blank texts have none."""
    return df.select(key, F.posexplode(sentence_chunks(F.col(text), size, overlap)).alias("chunk", "text"))


def pack_paragraphs(df: DataFrame, key: str, text: str = "text", most: int = 4000, least: int = 800) -> DataFrame:
    """(key, chunk, text): paragraphs packed up to ``most`` characters, long ones by sentences, longer sentences cut; a last piece below ``least`` joins the one before."""
    return df.select(key, F.posexplode(packed(F.col(text), most, least)).alias("chunk", "text"))
