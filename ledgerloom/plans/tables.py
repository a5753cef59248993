"""Queries over reading, resuming, checking and flattening tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registration import query
from ..sources import nodes
from ..tables import table


@query("pending_only", "select doc_id from documents where not exists (select 1 from labels where labels.doc_id = documents.doc_id)")
def pending_only(spark, d):
    return nodes.pending_only(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("validate_uploads", "with f as (select doc_id, row_number() over (partition by doc_id // 12 order by doc_id) as n, n_chars * 1000 as size, case doc_id % 4 when 0 then '.PDF' when 1 then '.md' when 2 then '.exe' else '.txt' end as kind, case when doc_id % 7 > 0 then text else ' ' end as text from documents) select doc_id, case when n > 10 then 'too many files' when size > 10485760 then 'too large' when lower(kind) = '.exe' then 'unknown kind' when trim(text) = '' then 'no text' end as error from f")
def validate_uploads(spark, d):
    i = F.col("doc_id")
    kind = F.when(i % 4 == 0, ".PDF").when(i % 4 == 1, ".md").when(i % 4 == 2, ".exe").otherwise(".txt")
    files = table(spark, d, "documents").select("doc_id", F.floor(i / 12).alias("batch"), i.alias("pos"), F.concat(F.lit("f"), kind).alias("name"), (F.col("n_chars") * 1000).alias("size"), F.when(i % 7 > 0, F.col("text")).otherwise(" ").alias("text"))
    return nodes.validate_uploads(files).select("doc_id", "error")


@query("split_good_bad", "select lang, n_chars < 200 as bad, count(*) as n from documents group by all")
def split_good_bad(spark, d):
    good, bad = nodes.split_good_bad(table(spark, d, "documents"), F.when(F.col("n_chars") < 200, "too short"))
    both = good.select("lang", F.lit(False).alias("bad")).unionByName(bad.select("lang", F.lit(True).alias("bad")))
    return both.groupBy("lang", "bad").agg(F.count("*").alias("n"))


@query("flatten_nodes_for_upload", "select source || ':' || doc_id as id, text as document, '{\"chars\":' || n_chars || '}' as evidence, lang || ', ' || source as partners from documents")
def flatten_nodes_for_upload(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("tenant_id"), F.col("doc_id").cast("string").alias("entity_id"), "text", F.struct(F.col("n_chars").alias("chars")).alias("evidence"), F.array("lang", "source").alias("partners"))
    return nodes.flatten_nodes_for_upload(rows)


@query("read_testset", "select item_id, '- ' || trim(text) || chr(10) || '- second' as grading_notes from benchmark")
def read_testset(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.lit("t").alias("tenant_id"), F.col("text").alias("question"), F.array("text", F.lit(" "), F.lit("second")).alias("keypoints"))
    return nodes.with_grading_notes(rows).select("item_id", "grading_notes")


@query("decode_text", "select doc_id, md5(text) as digest from documents")
def decode_text(spark, d):
    from ..functions.textnorm import decode_text as decode

    return table(spark, d, "documents").select("doc_id", F.md5(decode(F.encode("text", "UTF-8"))).alias("digest"))
