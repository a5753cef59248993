"""Nearest vectors: numpy block products in tasks, with the best of each partition merged by a window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.textnorm import strip_accents


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, query: str = "query", node: str = "node", vec: str = "vec", block: int = 1024) -> DataFrame:
    """(query, node, rank, score): for each query the ``k`` vectors of highest cosine a.b / (|a||b| + 1e-9); ties go to the smaller node.

    Queries are taken in blocks of ``block`` rows; each block is one task's broadcast, so any number of queries works with bounded memory, and a
    partition of vectors gives at most ``k`` rows for each query to the final window.
    """
    spark = vectors.sparkSession
    found = None
    rows, batch = queries.select(F.col(query).cast("long").alias("q"), F.col(vec).alias("v")).where("v is not null").toLocalIterator(), []
    blocks = []
    for r in rows:
        batch.append((r.q, r.v))
        if len(batch) == block:
            blocks.append(batch)
            batch = []
    if batch:
        blocks.append(batch)
    for part in blocks:
        ids = np.array([q for q, _ in part], np.int64)
        matrix = np.array([v for _, v in part], np.float64)
        near = _near(vectors.select(F.col(node).cast("long").alias("node"), F.col(vec).cast("array<double>").alias("v")), spark.sparkContext.broadcast((ids, matrix)), k)
        found = near if found is None else found.unionByName(near)
    if found is None:
        return spark.createDataFrame([], "query long, node long, rank int, score double")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "node"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query", "node", "rank", "score")


def _near(vectors: DataFrame, shared, k: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]):
        ids, queries = shared.value
        norms = np.linalg.norm(queries, axis=1)
        nodes = np.empty((len(ids), 0), np.int64)
        scores = np.empty((len(ids), 0))
        for b in batches:
            keep = b.filter(b.column(1).is_valid())
            if not keep.num_rows:
                continue
            m = keep.column(1).flatten().to_numpy().reshape(keep.num_rows, -1)
            s = np.round(queries @ m.T / (norms[:, None] * np.linalg.norm(m, axis=1)[None, :] + 1e-9), 6)
            nodes = np.hstack([nodes, np.broadcast_to(keep.column(0).to_numpy(), s.shape)])
            scores = np.hstack([scores, s])
            order = np.lexsort((nodes, -scores), axis=1)[:, :k]
            nodes, scores = np.take_along_axis(nodes, order, 1), np.take_along_axis(scores, order, 1)
        if scores.shape[1]:
            yield pa.RecordBatch.from_pydict({"query": np.repeat(ids, scores.shape[1]), "node": nodes.ravel(), "score": scores.ravel()})

    return vectors.mapInArrow(scan, "query long, node long, score double")


def nearest_anchor(queries: DataFrame, anchors: DataFrame, keywords: list[str], least: float = 0.25) -> DataFrame:
    """(query, score, anchor, in_domain, reason) for (query, text, vec): a blank text is outside; one with a keyword, accents and case apart, is inside;
    otherwise the anchor (node, vec) of highest cosine decides, and without any anchor the query is inside."""
    text = F.lower(strip_accents(F.trim(F.coalesce("text", F.lit("")))))
    word = F.coalesce(*[F.when(text.contains(strip_accents(F.lit(k.lower()))), k) for k in keywords if k], F.lit(None).cast("string"))
    asked = queries.select("query", "vec", text.alias("__t"), word.alias("__w"))
    near = vector_topk(asked.where("__t <> '' and __w is null").select("query", "vec"), anchors, 1).select("query", "node", F.col("score").alias("__s"))
    told = asked.join(near, "query", "left")
    reason = F.when(F.col("__t") == "", "empty").when(F.col("__w").isNotNull(), "keyword").when(F.col("node").isNull(), "no_anchors").otherwise("anchor")
    told = told.withColumn("reason", reason)
    score = F.when(F.col("reason") == "anchor", F.col("__s")).when(F.col("reason") == "empty", 0.0).otherwise(1.0)
    anchor = F.when(F.col("reason") == "anchor", F.col("node").cast("string")).otherwise(F.col("__w"))
    return told.select("query", score.alias("score"), anchor.alias("anchor"), F.when(F.col("reason") == "empty", False).when(F.col("reason") == "anchor", F.col("__s") >= least).otherwise(True).alias("in_domain"), "reason")


def smalltalk_match(queries: DataFrame, bank: DataFrame, least: float = 0.78) -> DataFrame:
    """(query, bank, question, answer, score): the answer of the bank's entry (bank, answer, questions of (question, vec)) with the nearest question, where it is near enough. Blank texts match nothing."""
    each = bank.select("bank", "answer", F.explode("questions").alias("q")).select("bank", "answer", F.col("q.question").alias("node"), F.col("q.vec").alias("vec"))
    asked = queries.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("query", "vec")
    best = vector_topk(asked, each.select("node", "vec"), 1).where(F.col("score") >= least)
    return best.join(each.select("node", "bank", "answer"), "node").select("query", "bank", F.col("node").alias("question"), "answer", "score")


def ranked_examples(queries: DataFrame, examples: DataFrame, k: int = 3) -> DataFrame:
    """(query, rank, example, score): the nearest examples (example, vec, question, answer) of those with a question and an answer."""
    whole = examples.where(F.col("question").isNotNull() & F.col("answer").isNotNull()).select(F.col("example").alias("node"), "vec")
    return vector_topk(queries.select("query", "vec"), whole, k).select("query", "rank", F.col("node").alias("example"), "score")
