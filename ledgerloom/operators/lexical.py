"""BM25 over a table of nodes: postings, document and term statistics, and scores of many queries at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.textnorm import tokenize


@dataclass
class Bm25Index:
    postings: DataFrame  # node, term, tf
    lengths: DataFrame  # node, dl
    terms: DataFrame  # term, df
    corpus: DataFrame  # one row: n, avgdl


def bm25_index(nodes: DataFrame, node: str = "node", text: str = "text") -> Bm25Index:
    """Statistics of ``nodes``; blank nodes count in n and have length 0. One pass of text for each part that is used."""
    rows = nodes.select(F.col(node).alias("node"), tokenize(F.col(text)).alias("tokens"))
    postings = rows.select("node", F.explode("tokens").alias("term")).groupBy("node", "term").agg(F.count("*").alias("tf"))
    lengths = rows.select("node", F.size("tokens").cast("long").alias("dl"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return Bm25Index(postings, lengths, terms, corpus)


def bm25_scores(queries: DataFrame, index: Bm25Index, query: str = "query", text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, node, score) for every pair with a shared term. A term that a query repeats counts as often.

    Postings are reduced to the queries' terms before anything is joined, so frequent terms that nobody asks for are not moved.
    """
    asked = queries.select(F.col(query).alias("query"), F.explode(tokenize(F.col(text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    wanted = asked.select("term").distinct()
    found = index.postings.join(wanted, "term", "left_semi")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighed = asked.join(df, "term").crossJoin(F.broadcast(index.corpus)).select("query", "term", "times", idf.alias("idf"), "avgdl")
    length = F.when(F.col("dl") == 0, 1).otherwise(F.col("dl"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length / F.col("avgdl")))
    return found.join(weighed, "term").join(index.lengths, "node").groupBy("query", "node").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int, by: list, query: str = "query", rank: str = "rank") -> DataFrame:
    return scores.withColumn(rank, F.row_number().over(Window.partitionBy(query).orderBy(*by))).where(F.col(rank) <= k)


#: Cells of the matrix of terms and queries that is broadcast at once.
CELLS = 4_000_000


def bm25_topk(queries: DataFrame, nodes: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75, **cols) -> DataFrame:
    """(query, node, rank, score): the ``k`` best nodes with a score above 0; ties go to the smaller node.

    Statistics take one pass over the nodes, in which only asked terms are counted. Scores take another: a batch of nodes is scored against a block of queries at
    once, and of each batch only the nodes that reach its own ``k``-th best score go on, so that pairs of queries and nodes are never shuffled.
    Blocks hold so many queries that their matrix has at most ``CELLS`` cells, one query at least. Queries without an id take no part; empty tables give no rows.
    """
    spark = nodes.sparkSession
    key, node = cols.get("query", "query"), cols.get("node", "node")
    rows = nodes.select(F.col(node).alias("node"), tokenize(F.col(cols.get("node_text", "text"))).alias("tokens"))
    asked = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("query"), F.explode(tokenize(F.col(cols.get("query_text", "text")))).alias("term")).groupBy("query", "term").agg(F.count("*").cast("int").alias("times"))
    known = asked.groupBy("term").agg(F.lit(0).alias("x"))
    terms = rows.select(F.explode(F.array_distinct("tokens")).alias("term")).join(known.select("term"), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    corpus = rows.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl")).first()
    idf = F.log((F.lit(corpus.n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighed = asked.join(terms, "term").select("query", "term", (F.col("times") * idf).alias("weight"))
    size = weighed.agg(F.count_distinct("query").alias("q"), F.count_distinct("term").alias("t")).first()
    parts = min(max(1, -(-size.q * size.t // CELLS)), max(1, size.q))
    best = None
    for part in range(parts):
        told = weighed.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).toArrow()
        found = _best_of_batches(rows, told, corpus.avgdl or 1.0, k, k1, b)
        names = spark.createDataFrame(pa.table({"__q": pa.array(range(len(found[1])), pa.int32()), "query": found[1]}))
        one = found[0].join(F.broadcast(names), "__q").select("query", "node", "score")
        best = one if best is None else best.unionByName(one)
    return top_k(best, k, [F.col("score").desc(), "node"]).select("query", "node", "rank", "score")


def _best_of_batches(rows: DataFrame, told: pa.Table, avgdl: float, k: int, k1: float, b: float) -> tuple[DataFrame, pa.Array]:
    """((__q, node, score) of the best nodes of each batch, the queries by ``__q``)."""
    names, terms = told["query"].combine_chunks().dictionary_encode(), told["term"].combine_chunks().dictionary_encode()
    matrix = np.zeros((len(terms.dictionary), len(names.dictionary)))
    matrix[terms.indices.to_numpy(), names.indices.to_numpy()] = told["weight"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast((terms.dictionary.to_pylist(), matrix))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weight = shared.value
        value_set = pa.array(words, pa.string())
        for batch in (x.slice(i, 512) for x in batches for i in range(0, x.num_rows, 512)):
            tokens = batch.column(1)
            length = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
            place = pc.index_in(tokens.flatten(), value_set=value_set).fill_null(-1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(length)), length)
            pair, tf = np.unique(row[place >= 0] * len(words) + place[place >= 0], return_counts=True)
            if not len(pair):
                continue
            row, term = pair // len(words), pair % len(words)
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * np.maximum(length[row], 1) / avgdl))
            dense = np.zeros((len(length), len(words)))
            dense[row, term] = part
            scores = np.round(dense @ weight, 6)
            least = np.partition(scores, -k, axis=0)[-k] if len(scores) > k else np.zeros(scores.shape[1])
            at, q = np.nonzero((scores >= least) & (scores > 0))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), batch.column(0).take(pa.array(at)), pa.array(scores[at, q])], ["__q", "node", "score"])

    return rows.mapInArrow(scan, f"__q int, node {rows.schema['node'].dataType.simpleString()}, score double"), names.dictionary
