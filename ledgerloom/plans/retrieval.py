"""Queries over many questions at once: BM25, nearest vectors, fusion, candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion, lexical, vectors
from ..registration import query
from ..tables import table

TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')"
BM25 = f"""
tok as (select doc_id, {TOKENS.format('text')} as t from documents),
dl as (select doc_id, len(t) as dl from tok), corpus as (select count(*) as n, avg(dl) as avgdl from dl),
post as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from tok) group by all),
df as (select term, count(*) as df from post group by term),
q as (select item_id, term, count(*) as times from (select item_id, unnest({TOKENS.format('text')}) as term from benchmark) group by all),
bm as (select item_id, doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from q join post using (term) join df using (term) join dl using (doc_id), corpus group by item_id, doc_id),
lex as (select item_id as query, doc_id as node, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, score from bm where score > 0)
"""


def _bm25(spark, d, k):
    return lexical.bm25_topk(table(spark, d, "benchmark"), table(spark, d, "documents"), k=k, node="doc_id", query="item_id")


@query("bm25_index", f"with {BM25} select count(*) as n_postings, cast(sum(tf) as bigint) as n_tokens, (select count(*) from df) as n_terms, (select max(df) from df) as most_df, (select n from corpus) as n_docs, (select round(avgdl, 6) from corpus) as avgdl from post")
def bm25_index(spark, d):
    i = lexical.bm25_index(table(spark, d, "documents"), "doc_id")
    p = i.postings.agg(F.count("*").alias("n_postings"), F.sum("tf").alias("n_tokens"))
    t = i.terms.agg(F.count("*").alias("n_terms"), F.max("df").alias("most_df"))
    return p.crossJoin(t).crossJoin(i.corpus.select(F.col("n").alias("n_docs"), F.round("avgdl", 6).alias("avgdl")))


@query("bm25_topk", f"with {BM25} select query, node, rank, score from lex where rank <= 5")
def bm25_topk(spark, d):
    return _bm25(spark, d, 5)


VEC = """
v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
qv as (select vec_id as query, e from v where vec_id % 50 = 0),
near as (select query, vec_id as node, label, round(list_dot_product(qv.e, v.e) / (sqrt(list_dot_product(qv.e, qv.e)) * sqrt(list_dot_product(v.e, v.e)) + 1e-9), 6) as score from qv, v),
nn as (select query, node, cast(row_number() over (partition by query order by score desc, node) as int) as rank, score, label from near)
"""


def _nearest(spark, d, k):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec"), "label")
    return vectors.vector_topk(v.where("node % 50 = 0").withColumnRenamed("node", "query"), v, k), v


@query("vector_topk", f"with {VEC} select query, node, rank, score from nn where rank <= 5")
def vector_topk(spark, d):
    return _nearest(spark, d, 5)[0]


#: The second list of a fused pair: the other way round, by node within the same label.
LEX2 = "lx as (select q.vec_id as query, v.vec_id as node, cast(row_number() over (partition by q.vec_id order by v.vec_id) as int) as rank from v q join v on q.label = v.label where q.vec_id % 50 = 0)"
FUSE = f"""{VEC}, {LEX2},
fu as (select query, node, round(sum(s), 9) as score from (select query, node, 0.5::double / (60 + rank) as s from nn where rank <= 20 union all select query, node, 0.5::double / (60 + rank) from lx where rank <= 20) group by all),
fr as (select *, cast(row_number() over (partition by query order by score desc, node) as int) as rank from fu)
"""


def _lists(spark, d):
    near, v = _nearest(spark, d, 20)
    pairs = v.where("node % 50 = 0").select(F.col("node").alias("query"), "label").join(v.select("node", "label"), "label")
    return near, lexical.top_k(pairs, 20, ["node"]).select("query", "node", "rank"), v


@query("rrf_fuse", f"with {FUSE} select query, node, rank, score from fr where rank <= 10")
def rrf_fuse(spark, d):
    near, lex, _ = _lists(spark, d)
    return fusion.rrf_fuse(near, lex, top=10)


RERANK = f"""{FUSE},
pool as (select fr.query, fr.node, fr.score, coalesce(nn.score, 0) as cosine from fr left join nn on fr.query = nn.query and fr.node = nn.node where fr.rank <= 20),
mx as (select query, node, round(0.5 * case when max(score) over w > 0 then score / max(score) over w else 0 end + 0.5 * (cosine - min(cosine) over w) / case when max(cosine) over w > min(cosine) over w then max(cosine) over w - min(cosine) over w else 1 end, 6) as score from pool window w as (partition by query))
"""


@query("rerank_cosine", f"with {RERANK} select query, node, cast(row_number() over (partition by query order by score desc, node) as int) as rank, score from mx")
def rerank_cosine(spark, d):
    near, lex, v = _lists(spark, d)
    fused = fusion.rrf_fuse(near, lex, top=20)
    return fusion.rerank_cosine(fused, fusion.pooled_cosine(fused, v.withColumnRenamed("node", "query"), v))


@query("evidence_gate", f"with {VEC} select query, max(score) as best, max(score) >= 0.33 as matched from nn where rank between 2 and 5 group by query")
def evidence_gate(spark, d):
    return fusion.evidence_gate(_nearest(spark, d, 5)[0].where("rank > 1"))


@query("retrieval_metrics", f"with {FUSE} select query, (select count(*) from nn where nn.query = a.query and rank <= 20) as n_vector, (select count(*) from lx where lx.query = a.query and rank <= 20) as n_lexical, (select count(*) from fr where fr.query = a.query and rank <= 10) as n_fused from (select distinct query from fr) a")
def retrieval_metrics(spark, d):
    near, lex, _ = _lists(spark, d)
    return fusion.retrieval_metrics(near, lex, fusion.rrf_fuse(near, lex, top=10))


HITS = f"with {BM25}, hits as (select l.query, l.node, l.rank, l.score, d.source, d.text from lex l join documents d on l.node = d.doc_id where rank <= 15)"


def _hits(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("node"), "source", "text")
    return _bm25(spark, d, 15).join(docs, "node")


@query("group_candidates", HITS + ", g as (select query, source, max(score) as best, count(*) as n_chunks, string_agg(cast(node as varchar), ',' order by rank) as nodes from hits group by all), r as (select *, cast(row_number() over (partition by query order by best desc, source) as int) as rank from g) select * from r where rank <= 5")
def group_candidates(spark, d):
    return fusion.group_candidates(_hits(spark, d))


@query("dedupe_sources", HITS + " select query, string_agg(source, ',' order by a) as sources from (select query, source, min(rank) as a from hits group by all) group by query")
def dedupe_sources(spark, d):
    return fusion.dedupe_sources(_hits(spark, d))


@query("prompt_contexts", HITS + ", c as (select query, rank, left(text, 1000) as text from hits where trim(text) <> '' and rank <= 15), s as (select *, sum(length(text)) over (partition by query order by rank) as n from c) select query, rank, text from s where n <= 7800")
def prompt_contexts(spark, d):
    return fusion.prompt_contexts(_hits(spark, d), top=15)


@query("merge_contexts", HITS + r", b as (select query, rank as pos, text, 0 as side from hits where rank % 2 = 0 union all select query, rank, text, 1 from hits), r as (select *, row_number() over (partition by query, left(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 240) order by side, pos) as k from b) select query, pos, text, side from r where k = 1")
def merge_contexts(spark, d):
    hits = _hits(spark, d).select("query", F.col("rank").alias("pos"), "text")
    return fusion.merge_contexts(hits.where("pos % 2 = 0"), hits)


@query("result_key", "select doc_id, case when doc_id % 4 = 0 then 'n' || doc_id when doc_id % 4 = 1 then doc_id || ':' || length(text) when doc_id % 4 = 2 then source || '::' || left(text, 120) else left(text, 200) end as key from documents")
def result_key(spark, d):
    k = F.col("doc_id") % 4
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("row"), F.when(k == 0, F.concat(F.lit("n"), "doc_id")).alias("id"), F.when(k == 1, F.col("doc_id")).alias("doc_id"), F.when(k == 1, F.length("text")).alias("chunk_id"), F.when(k == 2, F.col("source")).alias("source"), "text")
    return fusion.result_key(rows).select(F.col("row").alias("doc_id"), "key")


@query("scope_filter", "select doc_id, source from documents where source in ('src1', 'src0') and lang = 'en'")
def scope_filter(spark, d):
    rows = table(spark, d, "documents").withColumn("tenant_id", F.when(F.col("source") == "src0", "global_public").otherwise(F.col("source"))).withColumn("branch_id", F.col("lang"))
    return fusion.scope_filter(rows, "src1", "en").select("doc_id", "source")


@query("experience_filter", "select p_partkey, p_size from part where p_size >= 20")
def experience_filter(spark, d):
    return fusion.experience_filter(table(spark, d, "part").select("p_partkey", "p_size"), 20, "p_size")


ANCHORS = "an as (select q.vec_id as query, a.vec_id as node, round(list_dot_product(q.e, a.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(a.e, a.e)) + 1e-9), 6) as score from v q, v a where q.vec_id % 50 = 0 and a.vec_id % 50 = 7), a1 as (select *, row_number() over (partition by query order by score desc, node) as r from an)"


def _asked(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec"))
    k = F.col("query") % 4
    text = F.when(k == 0, F.concat(F.lit("hoc phí "), F.col("query").cast("string"))).when(k == 2, F.concat(F.lit("cau "), F.col("query").cast("string"))).otherwise(" ")
    return e.where("node % 50 = 0").withColumnRenamed("node", "query").withColumn("text", text), e.where("node % 50 = 7")


@query("nearest_anchor", f"with {VEC}, {ANCHORS} select query, case when query % 4 = 2 then score when query % 4 = 0 then 1.0::double else 0.0::double end as score, case when query % 4 = 2 then cast(node as varchar) when query % 4 = 0 then 'học phí' end as anchor, case when query % 4 = 2 then score >= 0.25 else query % 4 = 0 end as in_domain, case query % 4 when 0 then 'keyword' when 2 then 'anchor' else 'empty' end as reason from a1 where r = 1")
def nearest_anchor(spark, d):
    asked, anchors = _asked(spark, d)
    return vectors.nearest_anchor(asked, anchors, ["học phí", "lịch"])


@query("smalltalk_match", f"with {VEC}, {ANCHORS} select query, node // 50 as bank, node as question, 'answer ' || (node // 50) as answer, score from a1 where r = 1 and score >= 0.2 and query % 4 in (0, 2)")
def smalltalk_match(spark, d):
    asked, bank = _asked(spark, d)
    bank = bank.select(F.floor(F.col("node") / 50).alias("bank"), F.concat(F.lit("answer "), F.floor(F.col("node") / 50).cast("string")).alias("answer"), F.array(F.struct(F.col("node").alias("question"), "vec")).alias("questions"))
    return vectors.smalltalk_match(asked, bank, 0.2)


@query("ranked_examples", f"with {VEC}, {ANCHORS} select query, cast(rank as int) as rank, node as example, score from (select query, node, score, row_number() over (partition by query order by score desc, node) as rank from an where node % 100 <> 7) where rank <= 3")
def ranked_examples(spark, d):
    """Examples whose question or answer is missing take no part."""
    asked, e = _asked(spark, d)
    e = e.select(F.col("node").alias("example"), "vec", F.lit("q").alias("question"), F.when(F.col("node") % 100 != 7, "a").alias("answer"))
    return vectors.ranked_examples(asked, e, 3)


PROMPT = """with q as (select doc_id as query, lang as text, doc_id % 5 as h, doc_id % 3 as e, doc_id % 4 as c from documents),
l as (select *, case when h > 0 then chr(10) || chr(10) || 'Conversation History:' || (select string_agg(chr(10) || case when i % 2 = 1 then 'User: m' else 'Assistant: m' end || i, '' order by i) from unnest(range(greatest(1, h - 2), h + 1)) u(i)) else '' end as hh, case when e > 0 then chr(10) || chr(10) || 'Examples:' || (select string_agg(chr(10) || 'Example ' || i || ' - Q: q' || chr(10) || 'Example ' || i || ' - A: a', '' order by i) from unnest(range(1, e + 1)) u(i)) else '' end as ee, case when c > 0 then chr(10) || chr(10) || 'Retrieved Knowledge:' || (select string_agg(chr(10) || '[Doc ' || i || '] t', '' order by i) from unnest(range(1, c + 1)) u(i)) else '' end as cc from q)
select query, 'SYS' || hh || ee || cc || chr(10) || chr(10) || 'User Question:' || chr(10) || text || chr(10) || chr(10) || case when h > 2 then 'The conversation goes on: answer directly and do not repeat what was said.' else 'Answer clearly and concisely. If unsure, say you are unsure.' end as prompt from l"""


@query("assemble_prompt", PROMPT)
def assemble_prompt(spark, d):
    """Documents ask in their language's name; their numbers say how many messages, examples and contexts they have."""
    q = table(spark, d, "documents").select(F.col("doc_id").alias("query"), F.col("lang").alias("text"))
    up_to = lambda n, name: q.where(F.col("query") % n > 0).select("query", F.explode(F.sequence(F.lit(1), (F.col("query") % n).cast("int"))).alias(name))
    said = up_to(5, "ts").select("query", "ts", F.when(F.col("ts") % 2 == 1, "user").otherwise("assistant").alias("role"), F.concat(F.lit("m"), F.col("ts").cast("string")).alias("content"))
    return fusion.assemble_prompt(q, said, up_to(3, "rank").withColumns({"question": F.lit("q"), "answer": F.lit("a")}), up_to(4, "rank").withColumn("text", F.lit("t")), "SYS", turns=3)
