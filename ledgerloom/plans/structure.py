"""Queries over pages, sections and chunks; pages stand for documents with headings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structure as ops
from ..registration import query
from ..tables import table

_MD = "html"
for _n in range(1, 7):
    _MD = f"regexp_replace(regexp_replace({_MD}, '<h{_n}[^>]*>', chr(10) || '{'#' * _n} ', 'g'), '</h{_n}>', chr(10), 'g')"
MD = f"md as (select page_id, regexp_replace({_MD}, '<[^>]+>', ' ', 'g') as text from pages)"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _md(spark, d):
    return table(spark, d, "pages").select("page_id", ops.html_to_markdown(F.col("html")).alias("text"))


PAGES = "pg as (select 'c' || (doc_id // 4) as source, 3 - doc_id % 4 as page_no, case when doc_id % 9 = 0 then ' ' else text end as text from documents)"


def _pages(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select(F.concat(F.lit("c"), F.floor(i / 4)).alias("source"), (3 - i % 4).alias("page_no"), F.when(i % 9 == 0, " ").otherwise(F.col("text")).alias("text"))


@query("merge_pages", f"with {PAGES} select source, string_agg(text, chr(10) || chr(10) order by page_no, text) as text, count(*) as n_pages from pg where trim(text) <> '' group by source")
def merge_pages(spark, d):
    return ops.merge_pages(_pages(spark, d))


@query("scanned_docs", f"with {PAGES} select source, round(avg(length(trim(text))), 6) as mean_chars, round(avg(length(trim(text))), 6) < 500 as scanned from pg group by source")
def scanned_docs(spark, d):
    return ops.scanned_docs(_pages(spark, d), 500)


@query("best_extraction", "select doc_id, case when length(trim(text)) > 100 then trim(text) when length(trim(lang)) > 100 then trim(lang) when trim(text) <> '' then trim(text) else trim(lang) end as best from documents")
def best_extraction(spark, d):
    return table(spark, d, "documents").select("doc_id", ops.best_extraction(F.col("text"), F.col("lang")).alias("best"))


@query("looks_like_markdown", f"with {MD} select page_id, regexp_matches(text, '(?m)^#{{1,6}} \\S') or contains(text, chr(10) || '- ') or contains(text, chr(10) || '* ') or contains(text, '|') as markdown from md")
def looks_like_markdown(spark, d):
    return _md(spark, d).select("page_id", ops.looks_like_markdown(F.col("text")).alias("markdown"))


LINES = rf"""{MD}, ln as (select page_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from md),
hd as (select *, regexp_matches(line, '^{{mark}}[ \t]+\S') as h from ln), se as (select *, sum(case when h then 1 else 0 end) over (partition by page_id order by n) as s from hd),
pt as (select page_id, s, bool_or(h) as headed, string_agg(line, chr(10) order by n) as part from se group by all),
kept as (select *, row_number() over (partition by page_id order by s) - 1 as idx from pt where trim(regexp_replace(part, '\s+', ' ', 'g')) <> '')"""


@query("split_markdown", f"with {LINES.format(mark='##')} select page_id, idx, case when headed then trim(regexp_extract(part, '^##[ \\t]+([^\\n]+)', 1)) else 'Document' end as heading, {STRIP.format('part')} as body from kept")
def split_markdown(spark, d):
    return ops.split_markdown(_md(spark, d), "page_id")


SECTIONS = f"with {LINES.format(mark='#{1,6}')}, sc as (select page_id, idx, case when headed then length(regexp_extract(part, '^(#{{1,6}})[ \\t]+([^\\n]+)', 1)) else 0 end as level, case when headed then trim(regexp_extract(part, '^(#{{1,6}})[ \\t]+([^\\n]+)', 2)) else '' end as heading, {STRIP.format(chr(39) + chr(39) + ' || case when headed then regexp_replace(part, ' + chr(39) + '^#{1,6}[ ' + chr(92) + 't]+[^' + chr(92) + 'n]+' + chr(39) + ', ' + chr(39) + chr(39) + ') else part end')} as body from kept)"


@query("parse_sections", SECTIONS + " select * from sc")
def parse_sections(spark, d):
    return ops.parse_sections(_md(spark, d), "page_id")


CHUNKS = rf"""t as (select doc_id, {STRIP.format('text')} as t from documents), n as (select *, case when length(t) <= 800 then 1 else cast(ceil((length(t) - 800) / 700) as int) + 1 end as n from t where t <> ''),
ch as (select doc_id, i as chunk, substring(t, i * 700 + 1, 800) as text from n, unnest(range(0, n)) as u(i))"""


def _chunks(spark, d):
    return ops.chunk_chars(table(spark, d, "documents"), "doc_id")


@query("chunk_chars", f"with {CHUNKS} select * from ch")
def chunk_chars(spark, d):
    return _chunks(spark, d)


@query("section_preview", f"with {CHUNKS} select doc_id, count(*) as n_nodes, cast(sum(length(text)) as bigint) as n_chars, left(arg_min(text, chunk), 800) as preview from ch group by doc_id")
def section_preview(spark, d):
    return ops.section_preview(_chunks(spark, d), "doc_id")


@query("assign_node_ids", f"with {CHUNKS} select source || ':' || (doc_id + 1) || ':' || (chunk + 1) as id, case when starts_with(ch.text, '[') then ch.text else '[' || source || ' > ' || lang || ']' || chr(10) || ch.text end as text from ch join documents using (doc_id)")
def assign_node_ids(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    nodes = _chunks(spark, d).join(docs, "doc_id")
    return nodes.select(ops.node_ids(F.col("source"), F.col("doc_id"), F.col("chunk")).alias("id"), ops.add_breadcrumb(F.col("source"), F.col("lang"), F.col("text")).alias("text"))


@query("attach_metadata", f"with {CHUNKS} select ch.doc_id, chunk, quality, toxic from ch left join labels using (doc_id)")
def attach_metadata(spark, d):
    return ops.attach_metadata(_chunks(spark, d).select("doc_id", "chunk"), table(spark, d, "labels"), "doc_id")


@query("merge_resume_metadata", "with f as (select doc_id as resume_id, toxic = 1 as is_ai from labels), e as (select doc_id as resume_id, case when doc_id % 5 = 0 then '' else source end as skills, doc_id % 30 as years from documents) select resume_id, is_ai, case when skills <> '' then skills end as skills, years from f full outer join e using (resume_id)")
def merge_resume_metadata(spark, d):
    i = F.col("doc_id")
    flags = table(spark, d, "labels").select(i.alias("resume_id"), (F.col("toxic") == 1).alias("is_ai"))
    entities = table(spark, d, "documents").select(i.alias("resume_id"), F.when(i % 5 == 0, "").otherwise(F.col("source")).alias("skills"), (i % 30).alias("years"))
    return ops.merge_resume_metadata(flags, entities)


@query("budget_sections", "with c as (select doc_id, source, least(n_chars, 8000) as c from documents), w as (select *, sum(c) over (partition by source) as total, sum(least(c, 1200)) over (partition by source) as small from c) select doc_id, cast(case when total <= 24000 then c else least(c, least(c, 1200) + floor(greatest(0, 24000 - small) * (c - least(c, 1200)) / greatest(total - small, 1))) end as bigint) as allowed from w")
def budget_sections(spark, d):
    return ops.budget_sections(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", "n_chars").select("doc_id", "allowed")
