"""Fusing ranked lists, reranking, gating and budgeting contexts, grouping chunks into candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lexical import top_k


def scope_filter(df: DataFrame, tenant: str | None, branch: str | None = None, required: bool = True) -> DataFrame:
    """Rows of the tenant and of ``global_public``, and of the branch if one is given; none where a tenant is required and missing."""
    if not tenant:
        return df.where("false") if required else df
    kept = df.where(F.col("tenant_id").isin(tenant, "global_public"))
    return kept.where(F.col("branch_id") == branch) if branch else kept


def experience_filter(df: DataFrame, least: int | None, years: str = "experience_years") -> DataFrame:
    return df.where(F.col(years) >= least) if least and least > 0 else df


def result_key(df: DataFrame, text: str = "text") -> DataFrame:
    """``key``: the first there is of id, doc_id:chunk_id, chunk_id, doc_id, source::text head, text head."""
    some = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    head = F.substring(F.coalesce(F.col(text), F.lit("")), 1, 120)
    return df.withColumn("key", F.coalesce(some("id"), F.concat(some("doc_id"), F.lit(":"), some("chunk_id")), some("chunk_id"), some("doc_id"), F.concat(some("source"), F.lit("::"), head), F.substring(F.col(text), 1, 200)))


def rrf_fuse(vector: DataFrame, lexical: DataFrame, alpha: float = 0.5, k: int = 60, top: int = 10) -> DataFrame:
    """(query, node, rank, score) from two lists (query, node, rank): alpha / (k + rank) + (1 - alpha) / (k + rank)."""
    alpha = alpha if 0 <= alpha <= 1 else 0.5
    part = lambda df, w: df.select("query", "node", (F.lit(w) / (k + F.col("rank"))).alias("s"))
    fused = part(vector, alpha).unionByName(part(lexical, 1 - alpha)).groupBy("query", "node").agg(F.round(F.sum("s"), 9).alias("score"))
    return top_k(fused, top, [F.col("score").desc(), "node"]).select("query", "node", "rank", "score")


def rerank_cosine(fused: DataFrame, cosine: DataFrame, weight: float = 0.5, pool: int = 20) -> DataFrame:
    """(query, node, rank, score) over the first ``pool`` of each query: (1 - w) * score / max + w * min-max of cosine."""
    w = Window.partitionBy("query")
    rows = fused.where(F.col("rank") <= pool).select("query", "node", "score").join(cosine.select("query", "node", F.col("score").alias("cosine")), ["query", "node"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
    top, lo, hi = F.max("score").over(w), F.min("cosine").over(w), F.max("cosine").over(w)
    first = F.when(top > 0, F.col("score") / top).otherwise(0.0)
    second = (F.col("cosine") - lo) / F.when(hi > lo, hi - lo).otherwise(1.0)
    mixed = rows.withColumn("mixed", F.round((1 - weight) * first + weight * second, 6))
    return top_k(mixed, pool, [F.col("mixed").desc(), "node"]).select("query", "node", "rank", F.col("mixed").alias("score"))


def pooled_cosine(fused: DataFrame, queries: DataFrame, vectors: DataFrame, pool: int = 20) -> DataFrame:
    """(query, node, score): the cosine of every query and node of a fused pool, whichever list it came from, from their stored vectors (query, vec) and (node, vec)."""
    pairs = fused.where(F.col("rank") <= pool).select("query", "node").join(queries.select("query", F.col("vec").alias("a")), "query").join(vectors.select("node", F.col("vec").alias("b")), "node")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    cosine = dot(F.col("a"), F.col("b")) / (F.sqrt(dot(F.col("a"), F.col("a"))) * F.sqrt(dot(F.col("b"), F.col("b"))) + 1e-9)
    return pairs.select("query", "node", F.round(cosine, 6).alias("score"))


def evidence_gate(hits: DataFrame, least: float = 0.33) -> DataFrame:
    """(query, best, matched): whether a query's best cosine reaches ``least``."""
    return hits.groupBy("query").agg(F.max("score").alias("best")).withColumn("matched", F.col("best") >= least)


def prompt_contexts(hits: DataFrame, top: int = 3, cut: int = 1000, budget: int = 7800) -> DataFrame:
    """(query, rank, text): the first ``top`` texts that aren't blank, cut, while their lengths add up to no more than ``budget``."""
    rows = hits.where(F.trim("text") != "").where(F.col("rank") <= top).withColumn("text", F.substring("text", 1, cut))
    so_far = F.sum(F.length("text")).over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__n", so_far).where(F.col("__n") <= budget).select("query", "rank", "text")


def group_candidates(hits: DataFrame, limit: int = 5) -> DataFrame:
    """(query, source, best, n_chunks, nodes, rank): the first 3 * limit chunks as one row for each source, the best sources first."""
    first = hits.where(F.col("rank") <= 3 * limit)
    rows = first.groupBy("query", "source").agg(F.max("score").alias("best"), F.count("*").alias("n_chunks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"].cast("string")), ",").alias("nodes"))
    return top_k(rows, limit, [F.col("best").desc(), "source"])


def dedupe_sources(hits: DataFrame) -> DataFrame:
    """(query, sources): distinct names in the order in which they are first seen, as one text."""
    first = hits.groupBy("query", "source").agg(F.min("rank").alias("at"))
    return first.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "source"))), lambda x: x["source"]), ",").alias("sources"))


def merge_contexts(primary: DataFrame, secondary: DataFrame, size: int = 240) -> DataFrame:
    """Both lists (query, pos, text), the first row for each signature: the text's first ``size`` characters, blanks collapsed, lower case."""
    both = primary.withColumn("side", F.lit(0)).unionByName(secondary.withColumn("side", F.lit(1)))
    sign = F.substring(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), 1, size)
    first = F.row_number().over(Window.partitionBy("query", sign).orderBy("side", "pos"))
    return both.withColumn("__r", first).where("__r = 1").drop("__r")


def retrieval_metrics(vector: DataFrame, lexical: DataFrame, fused: DataFrame) -> DataFrame:
    """(query, n_vector, n_lexical, n_fused)."""
    tag = lambda df, n: df.select("query", F.lit(n).alias("kind"))
    every = tag(vector, "v").unionByName(tag(lexical, "l")).unionByName(tag(fused, "f"))
    return every.groupBy("query").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{n}") for k, n in (("v", "vector"), ("l", "lexical"), ("f", "fused"))])


def assemble_prompt(questions: DataFrame, history: DataFrame, examples: DataFrame, contexts: DataFrame, system: str, turns: int = 6, cut: int = 400) -> DataFrame:
    """(query, prompt) for every question (query, text): the system's text, the last ``turns`` messages (query, ts, role, content) cut at ``cut`` characters, numbered
    examples (query, rank, question, answer) and contexts (query, rank, text), the question, and how to answer, shorter where there are more than two messages."""
    said = history.where(F.col("role").isin("user", "assistant") & (F.trim("content") != ""))
    last = said.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.col("ts").desc()))).withColumn("all", F.count("*").over(Window.partitionBy("query"))).where(F.col("n") <= turns)
    listed = lambda df, order, line, name: df.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n").alias(name), *([F.max("all").alias("all")] if "all" in df.columns else []))
    turn = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.substring(F.trim("content"), 1, cut))
    number = F.col("rank").cast("string")
    pair = F.concat(F.lit("Example "), number, F.lit(" - Q: "), "question", F.lit("\nExample "), number, F.lit(" - A: "), "answer")
    parts = [listed(last, "ts", turn, "said"), listed(examples, "rank", pair, "shown"), listed(contexts, "rank", F.concat(F.lit("[Doc "), number, F.lit("] "), "text"), "known")]
    rows = questions
    for part in parts:
        rows = rows.join(part, "query", "left")
    block = lambda head, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n{head}:\n"), c))
    brief = F.when(F.col("all") > 2, "\nThe conversation goes on: answer directly and do not repeat what was said.").otherwise("\nAnswer clearly and concisely. If unsure, say you are unsure.")
    return rows.select("query", F.concat_ws("\n", F.lit(system), block("Conversation History", "said"), block("Examples", "shown"), block("Retrieved Knowledge", "known"), F.concat(F.lit("\nUser Question:\n"), "text"), brief).alias("prompt"))
