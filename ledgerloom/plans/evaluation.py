"""Queries over corpus figures and evaluation sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import resumes as rs
from ..registration import query
from ..tables import table


def _docs(spark, d):
    return table(spark, d, "documents")


STATS = "count(*) as n, round(avg(c), 3) as mean, round(quantile_cont(c, 0.5), 3) as median, min(c) as least, max(c) as most, round(stddev_samp(c), 3) as deviation, cast(sum(w) as bigint) as words"


@query("corpus_text_stats", rf"with t as (select lang, length(text) as c, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) as w from documents) select lang, {STATS} from t group by rollup (lang)")
def corpus_text_stats(spark, d):
    return rs.corpus_text_stats(_docs(spark, d), "lang")


@query("extraction_quality", "with t as (select length(trim(text)) as n from documents) select count(*) as n, count(*) filter (n = 0) as empty, count(*) filter (n > 0 and n < 100) as scanned, count(*) filter (n >= 100) as text_based from t")
def extraction_quality(spark, d):
    return rs.extraction_quality(_docs(spark, d))


@query("page_histogram", "select n_chars // 3000 + 1 as pages, count(*) as n from documents group by 1")
def page_histogram(spark, d):
    return rs.page_histogram(_docs(spark, d).withColumn("p", F.floor(F.col("n_chars") / 3000) + 1), "p")


RATES = ", ".join(f"count(*) filter (regexp_matches(text, '{p}')) as n_{k}" for k, p in rs.ENTITIES.items()) + ", " + ", ".join(f"round(avg(case when regexp_matches(text, '{p}') then 1.0::double else 0 end) * 100, 3) as pct_{k}" for k, p in rs.ENTITIES.items())


@query("entity_rates", f"select {RATES} from documents")
def entity_rates(spark, d):
    return rs.entity_rates(_docs(spark, d))


TERMS = ["the", "and", "of", "der", "die", "und", "le", "la", "de", "que", "el", "los", "en", "is", "for"]


@query("top_skills", rf"with w as (select lang, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))) as term from documents), n as (select lang, term, count(*) as n from w where term in {tuple(TERMS)} group by all), r as (select *, cast(row_number() over (partition by lang order by n desc, term) as int) as rank from n) select * from r where rank <= 5")
def top_skills(spark, d):
    return rs.top_terms(_docs(spark, d), "lang", TERMS, 5)


@query("section_header_counts", "with l as (select unnest(list_distinct(string_split(text, chr(10)))) as line from documents) select line, count(*) as n from l where trim(line) <> '' group by line having count(*) >= 3")
def section_header_counts(spark, d):
    return rs.line_counts(_docs(spark, d), 3)


@query("quality_issues", "select lang, count(*) as n, count(*) filter (regexp_matches(text, '�|[*#$%&!]{3}')) as garbled, count(*) filter (length(text) < 200) as very_short, count(*) filter (length(text) > 20000) as very_long from documents group by lang")
def quality_issues(spark, d):
    return rs.quality_issues(_docs(spark, d), "lang")


@query("compare_sources", "with a as (select lang, count(*) as n_a, round(avg(n_chars), 3) as mean_a from documents where doc_id % 2 = 0 group by lang), b as (select lang, count(*) as n_b, round(avg(n_chars), 3) as mean_b from documents where doc_id % 2 = 1 group by lang) select lang, n_a, mean_a, n_b, mean_b from a full outer join b using (lang)")
def compare_sources(spark, d):
    docs = _docs(spark, d)
    return rs.compare_sources(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "lang", "n_chars")


@query("ai_flags", "select source, round(avg(case when toxic = 1 then 1.0::double else 0 end), 6) as share from labels join documents using (doc_id) group by source")
def ai_flags(spark, d):
    replies = table(spark, d, "labels").withColumn("reply", F.when(F.col("toxic") == 1, "I say true.").otherwise("False"))
    return rs.ai_flags(replies).join(_docs(spark, d).select("doc_id", "source"), "doc_id").groupBy("source").agg(F.round(F.avg(F.col("is_ai").cast("double")), 6).alias("share"))


@query("batch_inputs", "select cast(p // 5 as bigint) as batch, count(*) as n, cast(sum(p % 5) as bigint) as places from (select row_number() over (order by doc_id) - 1 as p from documents) group by 1")
def batch_inputs(spark, d):
    return rs.batch_inputs(_docs(spark, d), "doc_id").groupBy("batch").agg(F.count("*").alias("n"), F.sum("place").alias("places"))


@query("complete_batch", "select doc_id as id, case when quality is null then 'Candidate' else 'role' || quality end as role, coalesce(quality * 100, 50) as score from documents left join labels using (doc_id)")
def complete_batch(spark, d):
    scored = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"), F.concat(F.lit("role"), F.col("quality").cast("string")).alias("role"), (F.col("quality") * 100).alias("score"))
    return rs.complete_batch(_docs(spark, d).select(F.col("doc_id").alias("id")), scored)


@query("leaderboard", "select p_partkey, rank() over (partition by p_brand order by p_size desc) as place from part")
def leaderboard(spark, d):
    return rs.leaderboard(table(spark, d, "part"), "p_brand", "p_size").select("p_partkey", F.col("place").cast("long").alias("place"))


@query("validate_annotations", "select doc_id, 2 as n, substring(text, 1, 10) || '|' || substring(text, 6, 8) as kept from documents where length(text) > 20")
def validate_annotations(spark, d):
    note = lambda t, k, tip: F.struct(t.alias("text"), F.lit(k).alias("kind"), F.lit(tip).alias("tip"))
    docs = _docs(spark, d).where(F.length("text") > 20).select("doc_id", "text")
    notes = F.array(note(F.lower(F.substring("text", 1, 10)), "bonus", "a"), note(F.lit("nowhere at all"), "bonus", "b"), note(F.substring("text", 6, 8), "penalty", "c"), note(F.substring("text", 1, 4), "other", "d"), note(F.substring("text", 1, 4), "bonus", ""))
    kept = rs.validate_annotations(docs.withColumn("notes", notes), "text")
    first = F.element_at("notes", 1)["text"]
    second = F.substring("text", 6, 8)
    return kept.select("doc_id", F.size("notes").alias("n"), F.concat(first, F.lit("|"), second).alias("kept"))


QA = "q as (select item_id, 's' || (item_id % 4) as tenant_id, case when item_id % 3 > 0 then 'multi' end as query_type, text as question, case when item_id % 7 > 0 then text end as answer from benchmark)"


@query("coerce_qa", f"with {QA} select item_id, tenant_id, coalesce(query_type, 'factual') as query_type, tenant_id || '-' || lpad(cast(row_number() over (partition by tenant_id order by item_id) as varchar), 4, '0') as query_id from q where trim(question) <> '' and trim(coalesce(answer, '')) <> ''")
def coerce_qa(spark, d):
    i = F.col("item_id")
    rows = table(spark, d, "benchmark").select(i, F.concat(F.lit("s"), i % 4).alias("tenant_id"), F.when(i % 3 > 0, "multi").alias("query_type"), F.col("text").alias("question"), F.when(i % 7 > 0, F.col("text")).alias("answer"), F.array(F.lit(" "), F.lit("point")).alias("keypoints"))
    return ev.add_query_ids(ev.coerce_qa(rows), "tenant_id", "item_id").select("item_id", "tenant_id", "query_type", "query_id")


WS = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query("align_quotes", f"with n as (select doc_id, {WS.format('text')} as hay from documents), q as (select item_id, {WS.format('left(text, 60)')} as needle from benchmark), h as (select item_id, doc_id, case when contains(hay, needle) then 0 else 1 end as c from q join n on contains(lower(hay), lower(needle))) select item_id as quote_id, arg_min(doc_id, c * 1000000000 + doc_id) as node, min(c) = 0 as exact from h group by item_id")
def align_quotes(spark, d):
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.substring("text", 1, 60).alias("quote"))
    return ev.align_quotes(quotes, _docs(spark, d).select(F.col("doc_id").alias("node"), "text"))


TOK = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))"


@query("align_by_overlap", f"with a as (select item_id, unnest({TOK}) as t from benchmark), n as (select doc_id, unnest({TOK}) as t from documents), s as (select item_id, doc_id, count(*) as shared from a join n using (t) group by all) select item_id as answer_id, arg_max(doc_id, shared * 1000000000 - doc_id) as node, max(shared) as shared from s group by item_id")
def align_by_overlap(spark, d):
    return ev.align_by_overlap(table(spark, d, "benchmark").select(F.col("item_id").alias("answer_id"), "text"), _docs(spark, d).select(F.col("doc_id").alias("node"), "text"))


ITEMS = "it as (select l_orderkey, list_distinct(list(l_partkey) filter (l_linenumber % 2 = 1)) as a, list_distinct(list(l_partkey % 1000 * 2)) as b, any_value(l_orderkey % 4) as tenant, any_value(l_orderkey % 3) as kind from lineitem group by l_orderkey), pr as (select *, len(list_intersect(coalesce(a, []), b)) as hit from it)"


def _items(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_partkey"))).alias("retrieved"), F.collect_set(F.col("l_partkey") % 1000 * 2).alias("wanted"), F.first(F.col("l_orderkey") % 4).alias("tenant"), F.first(F.col("l_orderkey") % 3).alias("kind"))


@query("score_retrieval", f"with {ITEMS} select tenant, kind, count(*) as n, round(avg(hit / greatest(len(coalesce(a, [])), 1)), 6) as precision, round(avg(hit / greatest(len(b), 1)), 6) as recall from pr group by grouping sets ((), (tenant), (kind))")
def score_retrieval(spark, d):
    return ev.score_retrieval(_items(spark, d), ["tenant", "kind"])


@query("pass_rates", "select source, lang, count(*) as n, round(avg(case when quality = 1 then 1.0::double else 0 end), 6) as rate from labels join documents using (doc_id) group by grouping sets ((), (source), (lang))")
def pass_rates(spark, d):
    rows = table(spark, d, "labels").join(_docs(spark, d).select("doc_id", "source", "lang"), "doc_id").withColumn("passed", F.col("quality") == 1)
    return ev.pass_rates(rows, ["source", "lang"])


@query("keypoint_rates", "with v as (select event_type, user_id, case event_id % 3 when 0 then 'covered' when 1 then 'contradicted' else 'missing' end as v from events), q as (select event_type, user_id, avg(case when v = 'covered' then 1.0::double else 0 end) as c, avg(case when v = 'contradicted' then 1.0::double else 0 end) as h, avg(case when v = 'missing' then 1.0::double else 0 end) as i from v group by all) select event_type, round(avg(c), 6) as completeness, round(avg(h), 6) as hallucination, round(avg(i), 6) as irrelevance from q group by event_type")
def keypoint_rates(spark, d):
    k = F.col("event_id") % 3
    rows = table(spark, d, "events").select("event_type", F.col("user_id").alias("query_id"), F.when(k == 0, "covered").when(k == 1, "contradicted").otherwise("missing").alias("verdict"))
    return ev.keypoint_rates(rows, "event_type")


@query("judge_means", "select event_type, round(avg(case when event_id % 5 > 0 then event_id % 10 else 0 end), 6) as correctness, round(avg(case when event_id % 5 > 0 then 0.5::double else 0 end), 6) as relevance from events group by event_type")
def judge_means(spark, d):
    e = F.col("event_id")
    verdict = F.when(e % 5 > 0, F.concat(F.lit('{"correctness": '), (e % 10).cast("string"), F.lit(', "relevance": 0.5}'))).otherwise("no json")
    return ev.judge_means(table(spark, d, "events").select("event_type", verdict.alias("verdict")), "event_type")


@query("check_cases", "select o_orderkey as case_id, o_orderkey % 4 in (0, 3) as passed, case o_orderkey % 4 when 0 then 'ok' when 1 then 'no amount' when 2 then 'amount instead of an error' else 'ok' end as reason from orders")
def check_cases(spark, d):
    k = F.col("o_orderkey") % 4
    orders = table(spark, d, "orders")
    results = orders.select(F.col("o_orderkey").alias("case_id"), F.when(k.isin(0, 2), F.col("o_custkey")).alias("final"))
    return ev.check_cases(results, orders.select(F.col("o_orderkey").alias("case_id"), F.when(k.isin(0, 1), F.col("o_custkey")).alias("expected")))


@query("rouge_l")
def rouge_l(spark, d):
    """Every document against the one with the next id; tested against brute force."""
    docs = _docs(spark, d).select("doc_id", F.col("text").alias("answer"))
    return ev.rouge_l(docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("answer").alias("truth")), "doc_id"), "doc_id")


@query(
    "build_eval_items",
    """with q as (select source as tenant_id, doc_id as pos, lang, source || '-' || lpad(cast(row_number() over (partition by source order by doc_id) as varchar), 4, '0') as query_id from documents)
select tenant_id, query_id, 'q' || pos as question, case when pos % 3 = 0 then case when pos % 2 = 0 then 'n1' else 'n1,n2' end when pos % 3 = 1 then 'f' || pos else null end as doc_ids, case when pos % 3 = 0 then case when pos % 2 = 0 then 1 else 2 end when pos % 3 = 1 then 1 else 0 end as n_refs, case when pos % 5 > 0 then 'c' || (pos % 5) else '' end as predicted, least(pos % 5, 3) as n_contexts from q""",
)
def build_eval_items(spark, d):
    """Every document asks a question; a third has quotes with nodes, a third a fallback, a third neither."""
    p = F.col("pos")
    docs = table(spark, d, "documents").select(F.col("source").alias("tenant_id"), F.col("doc_id").alias("pos"), F.col("lang").alias("language"))
    qas = docs.select("tenant_id", "pos", "language", F.lit("d").alias("domain"), F.lit("factual").alias("query_type"), F.concat(F.lit("q"), p.cast("string")).alias("question"), F.lit("a").alias("answer"), F.array(F.lit("k")).alias("keypoints"))
    node = F.when(F.col("quote") == 0, "n1").when(F.col("quote") == 1, F.when(p % 2 == 0, "n1").otherwise("n2")).otherwise("n3")
    matched = docs.where(p % 3 == 0).select("tenant_id", "pos", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("quote")).withColumns({"node": node, "text": F.lit("t")})
    fallback = docs.where(p % 3 == 1).select("tenant_id", "pos", F.concat(F.lit("f"), p.cast("string")).alias("node"), F.lit("t").alias("text"))
    said = docs.where(p % 5 > 0).select("tenant_id", "pos", F.concat(F.lit("c"), (p % 5).cast("string")).alias("content"), F.array_repeat(F.lit("x"), (p % 5).cast("int")).alias("contexts"), F.array(F.lit("s")).alias("sources"), F.lit("r").alias("route"))
    items, _ = ev.build_eval_items(qas, matched, fallback, said, 3)
    ids = F.array_join("ground_truth.doc_ids", ",")
    return items.select("tenant_id", "query.query_id", F.col("query.content").alias("question"), ids.alias("doc_ids"), F.size("ground_truth.references").alias("n_refs"), F.col("prediction.content").alias("predicted"), F.size("prediction.references").alias("n_contexts"))
