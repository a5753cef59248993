"""Knowledge maps: entities of a document from its sections, what of the sections concerns each, and one row for each entity and for the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.evidence import extract_evidence
from ..functions.extract import extract_partners, is_commercial
from ..functions.guards import any_of, format_vnd
from ..functions.spans import BEFORE, let
from ..functions.textnorm import slugify, strip_accents
from .courses import score_entity_sections, section_kind, top_sections
from .sections import CUT, relevant_lines, strip

# Headings that name nothing, words that show a course, how names stand in lines, the name of what concerns no entity, labels of added sections.
GENERIC_HEADINGS = (
    "hoc phi", "phi", "phi tai lieu", "lich khai giang", "lich hoc", "khai giang", "chinh sach", "quy dinh", "noi quy", "cam ket", "lien he", "gio hoat dong", "thong tin lien he",
    "thong tin lien he chung", "khung gio hoat dong", "doi ngu", "giao vien", "tai lieu", "uu dai", "hoc bong", "hoan phi", "bao luu", "muc luc", "gioi thieu", "thong tin chung",
)
ENTITY_WORDS = (
    "ielts", "toeic", "cefr", "cambridge", "starters", "movers", "flyers", "ket", "pet", "giao tiep", "business english", "thieu nhi", "mau giao", "tieng anh thieu nhi",
    "tieng anh thieu nien", "lop", "khoa", "chuong trinh", "khoa hoc",
)
NUMBERING = r"(?i)^\s*([0-9]+(\.[0-9]+){0,3}|[ivxlcdm]{1,8})\s*[).\-:]\s*"
NAMED = r"(khoa\s*hoc|chuong\s*trinh|lop)\s+([^\n]{3,80})$"
PRICED = r"(?md)^\s*[-*]?\s*([^\n:]{3,80})\s*:\s+\S.+$"
GENERAL = "thong_tin_chung_ve_to_chuc"
GENERAL_NAME = "Thông tin chung về tổ chức"
NO_HEADING = "Thông tin chung"
ADDED = {"tuition": "Học phí (trích lọc)", "schedule": "Lịch học / Khai giảng (trích lọc)", "policy": "Chính sách / Cam kết (trích lọc)"}
RULE = "\n\n---\n\n"
NOTHING = "(Không tìm thấy đoạn liên quan rõ ràng trong tài liệu.)"


def _unnumbered(col):
    return F.regexp_replace(strip(col), NUMBERING, "")


def names_entity(col):
    """A line that may name an entity: it holds a word for courses, or is short and has a letter; general headings don't."""
    n = F.lower(strip_accents(_unnumbered(col), map_d=True))
    short = (F.size(F.split(strip(n), r"\s+")) <= 8) & n.rlike(r"\p{L}")
    return (F.length(n) >= 3) & ~n.isin(*GENERIC_HEADINGS) & (any_of(n, ENTITY_WORDS) | short)


def discover_entities(sections: DataFrame, most: int = 24) -> DataFrame:
    """(doc, entity_id, entity): the first ``most`` names of each document by their slug.

    Names come from headings (without numbering), then from what follows the words for a course on a line, then from what stands before a colon; for
    each slug the first name in that order, the sections' order and the lines' order stays.
    """
    head = sections.select("doc", "idx", F.lit(1).alias("kind"), F.lit(0).alias("pos"), "heading", strip(_unnumbered(F.col("heading"))).alias("name")).where(names_entity(F.col("heading"))).drop("heading")
    found = lambda kind, pattern, group: sections.select("doc", "idx", F.lit(kind).alias("kind"), F.posexplode(F.regexp_extract_all(F.col("body"), F.lit(pattern), F.lit(group))).alias("pos", "name")).withColumn("name", strip(F.col("name"))).where(names_entity(F.col("name")))
    every = head.unionByName(found(2, rf"(?imd){BEFORE}{NAMED}", 2)).unionByName(found(3, PRICED, 1))
    named = every.withColumn("entity_id", slugify(F.col("name"))).where((F.col("entity_id") != "") & ~F.col("entity_id").isin(*GENERIC_HEADINGS))
    first = named.groupBy("doc", "entity_id").agg(F.min_by("name", F.struct("kind", "idx", "pos")).alias("entity"))
    return first.withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy("entity_id"))).where(F.col("r") <= most).drop("r")


def entity_sections(entities: DataFrame, sections: DataFrame, k: int = 6) -> DataFrame:
    """(doc, entity, idx, rank): the sections that fit each entity best."""
    names = entities.select("doc", "entity").distinct()
    return top_sections(score_entity_sections(names, sections), k).select("doc", "entity", "idx", "rank")


def _cut(col, size: int):
    return F.when(F.length(col) > size, F.concat(F.regexp_replace(F.substring(col, 1, size), r"\s+$", ""), F.lit(CUT))).otherwise(col)


def _joined(rows: DataFrame, keys: list[str], order: str, text: str, gap: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return rows.groupBy(*keys).agg(F.array_join(parts, gap).alias(text))


def supplement_kinds(picked: DataFrame, sections: DataFrame, cap: int = 2200) -> DataFrame:
    """(doc, entity, kind, heading, body): for each kind of tuition, schedule and policy that none of an entity's picked sections has, the lines that
    concern it from all sections of the kind in the document, in order, cut at ``cap`` characters. Kinds without such lines have no row."""
    kinds = sections.select("doc", "idx", "body", section_kind(F.col("heading")).alias("kind"))
    entities = picked.select("doc", "entity").distinct()
    wanted = entities.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in ADDED])))
    missing = wanted.join(picked.join(kinds.drop("body"), ["doc", "idx"]).select("doc", "entity", "kind"), ["doc", "entity", "kind"], "left_anti")
    lines = missing.join(kinds, ["doc", "kind"]).withColumn("body", relevant_lines(F.col("body"), F.col("entity"), most=14)).where("body <> ''")
    label = reduce(lambda a, k: a.when(F.col("kind") == k, ADDED[k]), ADDED, F.when(F.lit(False), ""))
    merged = _joined(lines, ["doc", "entity", "kind"], "idx", "body", "\n")
    return merged.select("doc", "entity", "kind", label.alias("heading"), _cut(strip(F.col("body")), cap).alias("body"))


def entity_context(picked: DataFrame, added: DataFrame, sections: DataFrame, cap: int | None = 12000) -> DataFrame:
    """(doc, entity, context): an entity's sections in their order and the added ones after them, each under its heading in brackets; of those on tuition,
    schedule and policy only the lines that concern the entity. Cut at ``cap`` characters where one is given."""
    own = picked.join(sections.select("doc", "idx", "heading", "body"), ["doc", "idx"]).select("doc", "entity", F.col("rank").alias("pos"), "heading", "body")
    order = reduce(lambda a, k: a.when(F.col("kind") == k[1], 1000 + k[0]), enumerate(ADDED), F.when(F.lit(False), 0))
    both = own.unionByName(added.select("doc", "entity", order.alias("pos"), "heading", "body"))
    body = F.when(section_kind(F.col("heading")) != "general", relevant_lines(F.col("body"), F.col("entity"))).otherwise(strip(F.col("body")))
    head = F.coalesce(F.nullif(strip(F.col("heading")), F.lit("")), F.lit(NO_HEADING))
    parts = both.select("doc", "entity", "pos", F.concat(F.lit("["), head, F.lit("]\n"), body).alias("context"))
    joined = _joined(parts, ["doc", "entity"], "pos", "context", RULE).withColumn("context", strip(F.col("context")))
    return joined.withColumn("context", _cut(F.col("context"), cap)) if cap else joined


def render_cluster(name, context):
    """An entity's text: its name, partners and figures, then its context."""
    return let(F.struct(context.alias("context"), extract_partners(context).alias("partners"), extract_evidence(context, split_fees=False).alias("e")), lambda x: _rendered(name, x["context"], x["partners"], x["e"]))


def _rendered(name, context, partners, e):
    listed = lambda col: F.array_join(F.transform(col, lambda x: x.cast("string")), ", ")
    months = F.concat(F.lit("thời lượng "), listed(e["duration_months"]), F.lit(" tháng"))
    prices = F.concat(F.lit("học phí "), F.array_join(F.transform(F.slice(e["tuition_vnd"], 1, 3), format_vnd), ", "), F.lit(" VND"))
    pieces = F.concat_ws("; ", months, prices, F.concat(F.lit("mục tiêu IELTS "), listed(e["ielts_target"])), F.concat(F.lit("mục tiêu TOEIC "), listed(e["toeic_target"])))
    lines = [
        F.concat(F.lit("Thực thể: "), name),
        F.when(F.size(partners) > 0, F.concat(F.lit("Đối tác liên quan: "), F.array_join(partners, ", "))),
        F.when(pieces != "", F.concat(F.lit("Tóm tắt nhanh: "), pieces, F.lit("."))),
        F.lit(""),
        F.lit("Thông tin liên quan (trích từ tài liệu):"),
        F.when(context != "", context).otherwise(NOTHING),
    ]
    return strip(F.concat_ws("\n", *lines))


def _rest(sections: DataFrame, picked: DataFrame, most: int) -> DataFrame:
    """(doc, context): the general sections that no entity uses; in documents that would have no row at all, the first ``most`` sections."""
    rendered = sections.withColumn("context", F.concat(F.lit("["), F.coalesce(F.nullif(strip(F.col("heading")), F.lit("")), F.lit(NO_HEADING)), F.lit("]\n"), F.col("body")))
    free = (section_kind(F.col("heading")) == "general") & (strip(F.col("body")) != "")
    general = rendered.where(free).join(picked.select("doc", "idx").distinct(), ["doc", "idx"], "left_anti")
    bare = rendered.join(picked.select("doc").distinct(), "doc", "left_anti").join(general.select("doc").distinct(), "doc", "left_anti")
    first = bare.withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy("idx"))).where(F.col("r") <= most).drop("r")
    return _joined(general.unionByName(first), ["doc"], "idx", "context", RULE).withColumn("context", strip(F.col("context")))


def heuristic_maps(entities: DataFrame, sections: DataFrame, fallback: int = 10) -> DataFrame:
    """(doc, entity_id, cluster, partners, evidence, commercial): a row for each entity with sections, and one for what is left of a document.

    Several entities of one name share its context. Every document with a section has a row.
    """
    entities = entities.where(F.col("entity_id") != GENERAL)
    picked = entity_sections(entities, sections)
    context = entity_context(picked, supplement_kinds(picked, sections), sections, cap=None)
    own = entities.select("doc", "entity_id", "entity").join(context, ["doc", "entity"]).withColumn("general", F.lit(False))
    rest = _rest(sections, picked, fallback).select("doc", F.lit(GENERAL).alias("entity_id"), F.lit(GENERAL_NAME).alias("entity"), "context", F.lit(True).alias("general"))
    rows = own.unionByName(rest)
    c = F.col("context")
    return rows.select("doc", "entity_id", render_cluster(F.col("entity"), c).alias("cluster"), extract_partners(c).alias("partners"), extract_evidence(c, split_fees=False).alias("evidence"), (is_commercial(c) & ~F.col("general")).alias("commercial"))


def normalize_maps(maps: DataFrame) -> DataFrame:
    """Maps with a slug for an id and a stripped text, rows without either left out; a missing flag is true for all but general rows, missing partners are none."""
    rows = maps.withColumns({"entity_id": slugify(F.col("entity_id")), "cluster": strip(F.coalesce("cluster", F.lit("")))}).where("entity_id <> '' and cluster <> ''")
    return rows.withColumns({"commercial": F.coalesce("commercial", F.col("entity_id") != GENERAL), "partners": F.coalesce("partners", F.array().cast("array<string>"))})


def run_stats(attempts: DataFrame) -> DataFrame:
    """One row for (doc, entity_id, called, succeeded): documents, those with a call, calls, successes, and entities that fell back to the rules."""
    called, good = F.coalesce("called", F.lit(False)), F.coalesce("succeeded", F.lit(False))
    return attempts.agg(
        F.count_distinct("doc").alias("docs_total"),
        F.count_distinct(F.when(called, F.col("doc"))).alias("docs_with_attempt"),
        F.count_if(called).alias("calls"),
        F.count_if(called & good).alias("success"),
        F.count_if(~(called & good) & F.col("entity_id").isNotNull()).alias("fallback_entities"),
    )
