"""Hard negatives from zone maps: rows in the order of a Hilbert curve, in Parquet blocks with each dimension's least and largest value, of which only those are read that an anchor's windows can meet.

A block holds rows of one label that follow each other on the curve. Interval arithmetic over its zone map bounds every inner product with an anchor, so a
block whose bounds lie outside all windows of all anchors is not read. Scores are whole numbers; the result doesn't depend on the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import small, table, written

#: Rows of a block, bits of a dimension on the curve, anchors that are broadcast at once, anchors of one product.
BLOCK, BITS, ANCHORS, SLICE = 512, 3, 16384, 1024
LEAST, MOST = -(1 << 62), 1 << 62
BLOCKS = "block long, label long, lo array<int>, hi array<int>, ids array<long>, asked array<boolean>, vectors binary"


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The places of ``points`` (rows of whole numbers below 2 ** bits) on the Hilbert curve, as bytes that sort like it: Skilling's transform, then the bits of all dimensions in turn."""
    x = points.astype(np.int64).T.copy()
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
    x ^= turn
    return np.packbits(np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)]).reshape(bits * len(x), -1).T.astype(np.uint8), axis=1)


def whole_rows(rows: DataFrame, key: str, label: str, vec: str, asked: Column, scale: int = 256) -> DataFrame:
    """(id, label, v, asked) of the rows that take part, components as floor(scale * x). Of rows that share an id the one of the least label and vector stays."""
    x = F.transform(F.col(vec), lambda c: c.cast("double"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vec).isNotNull() & ~odd)
    told = good.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(x, lambda c: F.floor(scale * c).cast("int")).alias("v"), asked.alias("asked"))
    return told.groupBy("id").agg(F.min(F.struct("label", "v", "asked")).alias("r")).select("id", "r.*")


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Lists as rows of ``dims`` numbers, with zeros after shorter ones."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dims), np.int32)
    out[np.arange(dims)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def blocks_of(rows: DataFrame, size: int = BLOCK) -> tuple[DataFrame, int, int]:
    """The table of blocks of ``whole_rows``, written, the number of dimensions and the largest absolute component. ``block`` is a block's first id."""
    rows = written(rows, "vectors")
    told = rows.agg(F.max(F.size("v")).alias("dims"), F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi")).first()
    dims, lo, hi = told.dims or 0, told.lo or 0, told.hi or 0
    step = (max(hi, 0) - min(lo, 0)) / (1 << BITS) + 1e-9

    @F.arrow_udf("binary")
    def place(v: pa.Array) -> pa.Array:
        cells = np.minimum((_matrix(v, dims) - min(lo, 0)) / step, (1 << BITS) - 1).astype(np.int64)
        return pa.array([k.tobytes() for k in hilbert_keys(cells)] if dims else [b""] * len(v), pa.binary())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            labels, a = t["label"].to_numpy(), 0
            while a < len(labels):
                b = min(a + size, len(labels), a + int(np.searchsorted(labels[a : a + size], labels[a], "right")))
                if b == len(labels) and not last:
                    held.extend(t.slice(a).to_batches())
                    return
                part = t.slice(a, b - a).sort_by("id")
                m = _matrix(part["v"].combine_chunks(), dims)
                row = {"block": part["id"][0].as_py(), "label": int(labels[a]), "lo": m.min(0).tolist(), "hi": m.max(0).tolist(), "ids": part["id"].to_pylist(), "asked": part["asked"].to_pylist(), "vectors": m.astype("<i4").tobytes()}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int64()), ("label", pa.int64()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("asked", pa.list_(pa.bool_())), ("vectors", pa.binary())]))
                a = b

        for batch in batches:
            held.append(batch)
            yield from blocks(False)
        yield from blocks(True)

    order = ["label", "place", "id"]
    placed = rows.withColumn("place", place("v")).repartitionByRange(*order).sortWithinPartitions(*order).drop("place")
    return written(placed.mapInArrow(pack, BLOCKS), "blocks"), dims, max(abs(lo), abs(hi))


def _numbers(blob: bytes, dims: int, kind) -> np.ndarray:
    return np.frombuffer(blob, "<i4").reshape(-1, dims).astype(kind) if dims else np.zeros((0, 0), kind)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each row, highest first, equal scores by smaller id."""
    return np.lexsort((ids, -scores), axis=1)[:, :k]


class Windows:
    """Anchors with the score windows in which each looks for its best rows; ``same`` label, or another."""

    def __init__(self, ids, labels, vectors, low, high, same: bool):
        self.ids, self.labels, self.vectors, self.low, self.high, self.same = ids, labels, vectors, low, high, same

    def may(self, label: int) -> np.ndarray:
        return (self.labels == label) if self.same else (self.labels != label)

    def met(self, label: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Anchors for which a block with this zone map can hold a row: some window meets the interval of possible scores."""
        at = np.flatnonzero(self.may(label))
        up, down = np.maximum(self.vectors[at], 0), np.minimum(self.vectors[at], 0)
        most, least = (up @ hi + down @ lo)[:, None], (up @ lo + down @ hi)[:, None]
        return at[((self.low[at] <= most) & (self.high[at] >= least)).any(1)]


def best_in_windows(blocks: DataFrame, windows: Windows, dims: int, k: int, kind) -> DataFrame:
    """(anchor, slot, id, score, rank): the ``k`` best rows of each window. First the zone maps alone are read, then the blocks that some window meets."""
    shared = blocks.sparkSession.sparkContext.broadcast(windows)

    def zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, label, lo, hi = b.columns
            los, his = _matrix(lo, dims).astype(kind), _matrix(hi, dims).astype(kind)
            needed = [len(shared.value.met(t, x, y)) > 0 for t, x, y in zip(label.to_pylist(), los, his, strict=True)]
            yield pa.RecordBatch.from_arrays([block.filter(pa.array(needed, pa.bool_()))], ["block"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        slots = w.low.shape[1] if len(w.ids) else 0
        scores, found = np.full((len(w.ids), slots, k), LEAST), np.full((len(w.ids), slots, k), MOST)
        for b in batches:
            label, los, his, ids_of, blobs = (b.column(b.schema.get_field_index(c)) for c in ("label", "lo", "hi", "ids", "vectors"))
            los, his = _matrix(los, dims).astype(kind), _matrix(his, dims).astype(kind)
            for r in range(b.num_rows):
                ids, m = ids_of[r].values.to_numpy(zero_copy_only=False), _numbers(blobs[r].as_py(), dims, kind)
                met = w.met(label[r].as_py(), los[r], his[r])
                for at in (met[i : i + SLICE] for i in range(0, len(met), SLICE)):
                    s = (w.vectors[at] @ m.T).astype(np.int64) if dims else np.zeros((len(at), len(ids)), np.int64)
                    for j in range(slots):
                        least = np.maximum(w.low[at, j], scores[at, j, -1])[:, None]
                        ok = (s >= least) & (s <= w.high[at, j][:, None]) & (ids[None, :] != w.ids[at][:, None])
                        some = np.flatnonzero(ok.any(1))
                        if len(some):
                            new = np.where(ok[some], s[some], LEAST)
                            first = np.argsort(-new, axis=1, kind="stable")[:, :k]  # rows are in the order of ids, so equal scores keep the smaller one
                            new, own = np.take_along_axis(new, first, 1), ids[first]
                            own = np.where(new == LEAST, MOST, own)
                            to = at[some]
                            both, names = np.hstack([scores[to, j], new]), np.hstack([found[to, j], own])
                            order = _best(both, names, k)
                            scores[to, j], found[to, j] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        anchor, slot, _ = got = np.nonzero(scores > LEAST)
        if len(anchor):
            yield pa.RecordBatch.from_pydict({"anchor": w.ids[anchor], "slot": slot.astype(np.int32), "id": found[got], "score": scores[got]})

    needed = written(blocks.select("block", "label", "lo", "hi").mapInArrow(zones, "block long"), "needed")
    read = blocks.join(small(needed), "block", "left_semi").select("label", "lo", "hi", "ids", "vectors")
    best = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id"))
    return read.mapInArrow(scan, "anchor long, slot int, id long, score long").withColumn("rank", best).where(F.col("rank") <= k)


def _anchors(blocks: DataFrame, dims: int, positives: int, kind) -> DataFrame:
    """(id, label, v, least): the asked rows; none of an anchor's first positives scores below ``least``, the last of those that its own block has."""

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                label, ids, asked, blob = (b.column(b.schema.get_field_index(c))[r] for c in ("label", "ids", "asked", "vectors"))
                at = np.flatnonzero(asked.values.to_numpy(zero_copy_only=False))
                if len(at):
                    m = _numbers(blob.as_py(), dims, kind)
                    s = (m[at] @ m.T).astype(np.int64) if dims else np.zeros((len(at), len(ids)), np.int64)
                    s[np.arange(len(at)), at] = LEAST
                    least = np.sort(s, axis=1)[:, -positives] if s.shape[1] >= positives else np.full(len(at), LEAST)
                    yield pa.RecordBatch.from_pydict({"id": ids.values.take(pa.array(at)), "label": [label.as_py()] * len(at), "v": [x.astype("<i4").tobytes() for x in m[at]], "least": least})

    return written(blocks.select("label", "ids", "asked", "vectors").mapInArrow(home, "id long, label long, v binary, least long"), "anchors")


def mine(rows: DataFrame, asked: Column, key: str = "vec_id", label: str = "label", vec: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that ``asked`` holds for and each of its first ``positives`` rows
    of the same label, the first ``negatives`` rows of another label that score between ``low`` and ``high`` hundredths of the positive.

    Rows with a null id, label, vector or component, or a component that isn't finite, take no part. Higher scores come first, ties by smaller id. Shorter
    vectors count as if zeros followed. Components are whole numbers below 2 ** 24 after scaling. Rows that share an id count once.
    An empty table, or one without anchors, gives an empty result. Anchors go to the executors ``ANCHORS`` at a time, in blocks.
    """
    spark = rows.sparkSession
    blocks, dims, largest = blocks_of(whole_rows(rows, key, label, vec, asked))
    kind = np.float64 if dims * largest * largest < 1 << 52 else np.int64  # products of doubles are exact as long as sums stay below 2 ** 53
    anchors = _anchors(blocks, dims, positives, kind)
    parts, out = max(1, math.ceil(anchors.count() / ANCHORS)), None
    for part in range(parts):
        told = anchors.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toArrow().sort_by("id")
        ids, labels = told["id"].to_numpy(), told["label"].to_numpy()
        vectors = _numbers(b"".join(told["v"].to_pylist()), dims, kind) if dims else np.zeros((len(ids), 0), kind)
        least = told["least"].to_numpy()[:, None]
        near = best_in_windows(blocks, Windows(ids, labels, vectors, least, np.full_like(least, MOST), True), dims, positives, kind)
        near = written(near.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive"), F.col("score").alias("positive_score")), "positives")
        got = near.toArrow()  # at most ``positives`` rows an anchor of this part
        at, slot, score = np.searchsorted(ids, got["anchor"].to_numpy()), got["slot"].to_numpy() - 1, got["positive_score"].to_numpy()
        lows, highs = np.full((len(ids), positives), MOST), np.full((len(ids), positives), LEAST)
        lows[at, slot], highs[at, slot] = -(-low * score // 100), high * score // 100
        far = best_in_windows(blocks, Windows(ids, labels, vectors, lows, highs, False), dims, negatives, kind)
        far = far.select("anchor", (F.col("slot") + 1).alias("slot"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        found = near.join(far, ["anchor", "slot"]).select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", "negative_id", "positive_score", "negative_score")
        out = found if out is None else out.unionByName(found)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; where it is divisible by 7, the label is one further on."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP13_SQL = """
with v as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id as a, a.label as al, b.id as b, b.label as bl, cast(list_dot_product(a.e, b.e) as bigint) as s from v a join v b on a.id <> b.id where a.id % 100 = 0),
p as (select a, b as p, s as ps from s where al = bl qualify row_number() over (partition by a order by s desc, b) <= 5)
select p.a as anchor_id, p as positive_id, cast(row_number() over (partition by p.a, p order by s.s desc, s.b) as int) as rank, s.b as negative_id, ps as positive_score, s.s as negative_score
from p join s on p.a = s.a and al <> bl and 30 * ps <= 100 * s.s and 100 * s.s <= 90 * ps qualify row_number() over (partition by p.a, p order by s.s desc, s.b) <= 10
"""
