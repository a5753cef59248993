"""Ranked lexical search by blocks of similar documents: posting lists are cut geometrically, each block has the largest weight of each of its terms, and a block is read unless those bound it out.

Documents are counted once, clustered around a bounded number of centroids, and cut into segments of some thousand similar documents. In a segment each
term's posting list is clustered again into blocks. A block's summary is the coordinatewise maximum of its documents' term weights, for the terms
that some query asks for together with the list's own. What a query can score in a block is at most its product with the summary, so that
leaving out the blocks below the best 50 found so far loses nothing. Scores are sums of whole numbers and don't depend on the cutting.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written

#: Bytes of terms: digits, letters (upper case as lower case) and all bytes of other characters; the rest are blanks.
_BYTES = bytes.maketrans(bytes(range(256)), bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)))
#: Centroids, documents of a segment, documents of a block, queries looked up at once, dimensions in which lists are clustered.
CENTROIDS, SEGMENT, BLOCK, QUERIES, SPACE = 256, 1024, 128, 1024, 64

VECTORS = "n long, terms array<int>, tf array<int>"
#: A segment's lists, each kept as packed numbers: its documents with their forward lists, then blocks with their term, documents and summary.
LISTS = ("docs", "ptr", "terms", "impacts", "block_term", "block_ptr", "block_docs", "sum_ptr", "sum_terms", "sum_max")
INDEX = "cluster int, part int, " + ", ".join(f"{x} binary" for x in LISTS)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: how many, how wide they are, and their bytes compressed."""
    width = 8 if len(values) and (values.max() > 0x7FFFFFFF or values.min() < -0x80000000) else 4
    planes = np.asarray(values, f"<i{width}").view(np.uint8).reshape(-1, width).T
    return len(values).to_bytes(8, "little") + bytes([width]) + pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), blob[8]
    planes = np.frombuffer(pa.decompress(blob[9:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<i{width}").ravel().astype(np.int64)


@dataclass(frozen=True)
class Asked:
    """A block of queries on the executors: their ids, their terms as numbers, and the number of each term."""

    items: list
    terms: list[np.ndarray]
    place: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple]) -> Asked:
        """Rows (item, text): those that share an item are one query with all their terms."""
        found: dict = {}
        for item, text in rows:
            found.setdefault(item, set()).update(terms_of(text))
        place = {t: i for i, t in enumerate(sorted(set().union(*found.values())))} if found else {}
        return cls(list(found), [np.array(sorted(place[t] for t in ts), np.int64) for ts in found.values()], place)

    def together(self) -> list[np.ndarray]:
        """For each term the terms that queries ask for together with it, itself included."""
        met: list[set] = [set() for _ in self.place]
        for ts in self.terms:
            for t in ts:
                met[t].update(ts.tolist())
        return [np.array(sorted(x), np.int64) for x in met]


@dataclass(frozen=True)
class Corpus:
    """How many documents have a term, how many terms they have, and the weight of each asked term."""

    n: int
    total: int
    weights: np.ndarray

    def impacts(self, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        m = 100 - 50 + (50 * size * self.n) // max(self.total, 1)
        return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def count_terms(docs: DataFrame, asked: Broadcast, key: str, text: str) -> DataFrame:
    """(doc, n, terms, tf): each row's number of terms, and the asked ones with their occurrences, written."""

    @F.arrow_udf(f"struct<{', '.join(x.replace(' ', ': ', 1) for x in VECTORS.split(', '))}>")
    def count(texts: pa.Array) -> pa.Array:
        place = asked.value.place
        n, ends, terms, tf = [], [0], [], []
        for x in texts:
            words = terms_of(x.as_py())
            counted = Counter(words)
            for t in counted.keys() & place.keys():
                terms.append(place[t])
                tf.append(counted[t])
            n.append(len(words))
            ends.append(len(terms))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (terms, tf)]
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), *lists], ["n", "terms", "tf"])

    return written(docs.select(F.col(key).cast("long").alias("doc"), count(F.col(text)).alias("v")).select("doc", "v.*").where("n > 0"), "terms")


def corpus_of(counted: DataFrame, n_terms: int) -> Corpus:
    told = counted.agg(F.count("*").alias("n"), F.sum("n").alias("total")).first()
    df = np.zeros(n_terms, np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each asked term at most
        df[r.t] = r["count"]
    return Corpus(told.n, told.total or 0, np.array([math.floor(1000 * math.log((2 * told.n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64))


def _rows(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each value, values)."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after the other."""
    sizes = ends - starts
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _clusters(counted: DataFrame, corpus: Broadcast, n_terms: int) -> DataFrame:
    """``counted`` with ``cluster``: the nearest by cosine of ``CENTROIDS`` documents, those of the smallest hashes."""
    spark = counted.sparkSession
    picked = counted.orderBy(F.xxhash64("doc", "n"), "doc", "n").limit(CENTROIDS).toArrow()
    row, term = _rows(picked["terms"].combine_chunks())
    size = picked["n"].to_numpy()
    weighed = (corpus.value.impacts(_rows(picked["tf"].combine_chunks())[1], size[row]) * corpus.value.weights[term]).astype(np.float32)
    centroids = np.zeros((n_terms, picked.num_rows), np.float32)
    centroids[term, row] = weighed
    shared = spark.sparkContext.broadcast(centroids / np.maximum(np.linalg.norm(centroids, axis=0), 1e-9))

    @F.arrow_udf("int")
    def near(n: pa.Array, terms: pa.Array, tf: pa.Array) -> pa.Array:
        known, told = corpus.value, shared.value
        row, term = _rows(terms)
        value = (known.impacts(_rows(tf)[1], n.to_numpy(zero_copy_only=False).astype(np.int64)[row]) * known.weights[term]).astype(np.float32)
        ends = np.searchsorted(row, np.arange(len(n) + 1))
        return pa.array([int((value[a:b] @ told[term[a:b]]).argmax()) for a, b in zip(ends, ends[1:], strict=False)], pa.int32())

    return counted.withColumn("cluster", near("n", "terms", "tf"))


def build_index(counted: DataFrame, asked: Broadcast, corpus: Broadcast) -> DataFrame:
    """One row a segment: the forward lists of its documents, and for each term its blocks with their documents and summaries. Written."""
    n_terms = len(asked.value.place)
    rows = _clusters(counted.where("doc is not null and size(terms) > 0"), corpus, n_terms)
    sizes = {r.cluster: r["count"] for r in rows.groupBy("cluster").count().collect()}
    parts = F.array(*[F.lit(max(1, math.ceil(sizes.get(c, 0) / SEGMENT))) for c in range(CENTROIDS)])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc", "n"), F.element_at(parts, F.col("cluster") + 1)).cast("int"))
    held: dict = {}

    def build(group: pa.Table) -> pa.Table:
        if not held:
            held.update(near=asked.value.together(), space=np.random.default_rng(7).choice(np.float32([-1, 1]), (n_terms, SPACE)))
        known = corpus.value
        group = group.sort_by([("doc", "ascending"), ("n", "ascending")])
        row, term = _rows(group["terms"].combine_chunks())
        impact = known.impacts(_rows(group["tf"].combine_chunks())[1], group["n"].to_numpy()[row])
        present, local = np.unique(term, return_inverse=True)
        dense = np.zeros((group.num_rows, len(present)), np.int32)
        dense[row, local] = impact
        weighed = dense * known.weights[present].astype(np.float32)
        points = (weighed / np.maximum(np.linalg.norm(weighed, axis=1, keepdims=True), 1e-9)) @ held["space"][present]
        by_term = np.lexsort((row, local))
        lists = np.split(row[by_term], np.cumsum(np.bincount(local, minlength=len(present)))[:-1])
        block_term, block_docs, sum_terms, sum_max = [], [], [], []
        at = np.full(n_terms, -1)
        at[present] = np.arange(len(present))
        for t, docs in zip(present, lists, strict=True):
            near = held["near"][t]
            cols = at[near]
            near, cols = near[cols >= 0], cols[cols >= 0]
            n = math.ceil(len(docs) / BLOCK)
            if n > 1:
                best = (points[docs] @ points[docs[:: math.ceil(len(docs) / n)]].T).argmax(1)
                blocks = [docs[best == k] for k in np.unique(best)]
            else:
                blocks = [docs]
            for own in blocks:
                top = dense[np.ix_(own, cols)].max(0)
                block_term.append(t)
                block_docs.append(own)
                sum_terms.append(near[top > 0])
                sum_max.append(top[top > 0])
        ends = lambda xs: np.cumsum([0, *map(len, xs)])
        columns = [group["doc"].to_numpy(), np.searchsorted(row, np.arange(group.num_rows + 1)), term, impact, block_term, ends(block_docs), np.concatenate(block_docs), ends(sum_terms), np.concatenate(sum_terms), np.concatenate(sum_max)]
        blobs = [pa.array([pack(np.asarray(v))], pa.binary()) for v in columns]
        return pa.Table.from_arrays([group["cluster"].slice(0, 1), group["part"].slice(0, 1), *blobs], ["cluster", "part", *LISTS])

    return written(rows.groupBy("cluster", "part").applyInArrow(build, INDEX), "blocks")


class Segment:
    """A row of the index as arrays."""

    def __init__(self, columns: dict):
        for name in LISTS:
            setattr(self, name, unpack(columns[name].as_py()))
        self.first = np.searchsorted(self.block_term, np.unique(self.block_term))
        own = self.sum_terms == np.repeat(self.block_term, np.diff(self.sum_ptr))
        tops = np.zeros(len(self.block_term), np.int64)
        tops[np.repeat(np.arange(len(self.block_term)), np.diff(self.sum_ptr))[own]] = self.sum_max[own]
        self.top = dict(zip(self.block_term[self.first].tolist(), zip(np.maximum.reduceat(tops, self.first).tolist(), self.first.tolist(), [*self.first[1:].tolist(), len(tops)], strict=True), strict=True))

    @staticmethod
    def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        edges = np.concatenate([[0], np.cumsum(ends - starts)])
        return sums[edges[1:]] - sums[edges[:-1]]

    def bounds(self, blocks: np.ndarray, weight: np.ndarray) -> np.ndarray:
        a, b = self.sum_ptr[blocks], self.sum_ptr[blocks + 1]
        at = _ranges(a, b)
        return self._sums(weight[self.sum_terms[at]] * self.sum_max[at], a, b)

    def scores(self, blocks: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents of ``blocks`` and their scores."""
        rows = np.unique(self.block_docs[_ranges(self.block_ptr[blocks], self.block_ptr[blocks + 1])])
        a, b = self.ptr[rows], self.ptr[rows + 1]
        at = _ranges(a, b)
        return self.docs[rows], self._sums(weight[self.terms[at]] * self.impacts[at], a, b)

    def lists(self, terms: np.ndarray, weight: np.ndarray, least: int) -> list[tuple[int, int, int]]:
        """(most, first block, end) of the lists of a query that must be looked at: without them no document reaches ``least``. Largest first."""
        told = sorted(((int(weight[t]) * self.top[t][0], *self.top[t][1:]) for t in terms.tolist() if t in self.top), key=lambda x: x[0])
        so_far = 0
        for k, (most, _, _) in enumerate(told):
            so_far += most
            if so_far >= least:
                return told[k:][::-1]
        return []


def _scan(index: DataFrame, asked: Broadcast, corpus: Broadcast, k: int, least: dict | None) -> DataFrame:
    """(item, doc, score): the best ``k`` of each task. Without ``least`` only the most promising block of each query in each segment is looked at."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = asked.value, corpus.value.weights
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries.items)
        floor = [max(1, (least or {}).get(i, 1)) for i in range(len(queries.items))]
        weight = np.zeros(len(weights), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                segment = Segment({name: batch.column(i)[r] for i, name in enumerate(batch.schema.names)})
                for i, terms in enumerate(queries.terms):
                    weight[terms] = weights[terms]
                    lists = segment.lists(terms, weight, floor[i])
                    if lists:
                        blocks = np.concatenate([np.arange(a, b) for _, a, b in (lists if least is not None else lists[:1])])
                        bounds = segment.bounds(blocks, weight)
                        blocks = blocks[bounds >= floor[i]] if least is not None else blocks[[bounds.argmax()]]
                        if len(blocks):
                            docs, scores = segment.scores(blocks, weight)
                            kept = scores >= floor[i]
                            docs, scores = np.concatenate([best[i][0], docs[kept]]), np.concatenate([best[i][1], scores[kept]])
                            order = np.lexsort((docs, -scores))[:k]
                            best[i] = docs[order], scores[order]
                            if len(order) == k:
                                floor[i] = max(floor[i], int(scores[order[-1]]))
                    weight[terms] = 0
        sizes = [len(d) for d, _ in best]
        if sum(sizes):
            yield pa.RecordBatch.from_pydict({"item": pa.array(np.repeat(np.arange(len(best)), sizes), pa.int32()), "doc": np.concatenate([d for d, _ in best]), "score": np.concatenate([s for _, s in best])})

    return index.mapInArrow(scan, "item int, doc long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "doc"))).where(F.col("rank") <= k)


def search(queries: DataFrame, docs: DataFrame, k: int = 50, query: str = "item_id", query_text: str = "text", doc: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents of every query with a score above 0; ties go to the smaller id.

    Statistics are those of all ``docs``. Null texts have no terms and queries without terms no rows. Documents without an id count in the statistics and
    are not ranked; rows that share an id are ranked each. Queries without an id take no part; those that share one are one query. Queries are
    looked up in blocks of ``QUERIES`` ids; a block of queries is all that is broadcast, with a number for each of its terms.
    """
    spark = docs.sparkSession
    asked = queries.where(F.col(query).isNotNull()).select(F.col(query).alias("item"), F.col(query_text).alias("text"))
    blocks = max(1, math.ceil(asked.select("item").distinct().count() / QUERIES))
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item")
        told = Asked.of([(r.item, r.text) for r in rows.collect()])
        shared = spark.sparkContext.broadcast(told)
        counted = count_terms(docs, shared, doc, doc_text)
        corpus = spark.sparkContext.broadcast(corpus_of(counted, len(told.place)))
        index = build_index(counted, shared, corpus)
        first = _ranked(_scan(index, shared, corpus, k, None), k).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        least = {r.item: r.least for r in first.collect() if r.n == k}
        found = _ranked(_scan(index, shared, corpus, k, least), k)
        names = spark.createDataFrame(list(enumerate(told.items)), f"item int, name {asked.schema['item'].dataType.simpleString()}")
        found = found.join(F.broadcast(names), "item").select(F.col("name").alias(query), "rank", F.col("doc").alias("doc_id"), "score")
        out = found if out is None else out.unionByName(found)
    return out


def op11_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
with d as (select doc_id, {_TERMS} as t from documents), c as (select count(*) as nn, sum(len(t)) as l from d where len(t) > 0),
q as (select distinct item_id, unnest({_TERMS}) as term from benchmark where item_id is not null),
p as (select doc_id, len(t) as n, term, count(*) as tf from (select doc_id, t, unnest(t) as term from d) group by doc_id, t, term),
a as (select * from p semi join q using (term)), f as (select term, cast(floor(1000 * ln((2 * any_value(nn) + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from a, c group by term),
s as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // l)))) as bigint) as score from q join a using (term) join f using (term), c group by item_id, doc_id),
r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 50
"""
