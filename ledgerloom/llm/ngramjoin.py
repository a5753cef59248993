"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles, each a 64-bit hash. XORing shingles into bits (one bit a shingle) gives a parity sketch, and
the Hamming distance of two sketches never exceeds the symmetric difference of the sets. Sets with Jaccard similarity t or
more differ in at most d = (a + b)(1 - t)/(1 + t) shingles, so sets meet in size bands: a set joins its own band and the next
one up. In a band whose largest set allows d differences the hash range is cut into m > d blocks; every difference spoils one
block's parity at most, so at least m - d blocks agree (pigeonhole), and sets meet on (band, block, parity) keys. A block's parity is
kept as the XOR of its 64-bit hashes, a linear hash of its parity bits. Empty blocks tell nothing and are left out where
fewer than m - d are empty, since then one that isn't must agree.

Groups of many copies stay linear. Equal sets are one node (their hash sum is the node's id). In each bucket all nodes pair with the
smallest only; pairs pass the sketches' Hamming bound and are verified on the whole sets. Buckets that this leaves in more than one
connected group first lose the nodes that may leave them: linked sets agree in more blocks than one, so each may miss its largest open buckets, by the
size of which all are ordered. What is still open is joined to clusters over shared nodes; a cluster's nodes of different groups are compared by their sketches, in
blocks that spread over tasks, and what passes is verified too. So no link that joins two groups is lost, and pairs inside a group that already hangs together are never made.

Cases: null and empty texts have no shingles and are linked with nothing; fewer words than a shingle give one shingle of all of them; repeated
rows are linked with each other; null ids get a component like others, under the smallest id that isn't null; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import connected, small, table, written

_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_UPPER = bytes(range(65, 91))
#: Blocks beyond the differences allowed: so many and one in so many more. Linked sets agree in as many blocks, some of them empty.
SPARE, SPARE_IN = 6, 16
_LOWERED = bytes.maketrans(_UPPER, _UPPER.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, kept for words that come again; emptied when it grows."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(raw: bytes, k: int, words: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence where it has fewer words."""
    found = raw.translate(_LOWERED).split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter((words[w] for w in found), np.uint64, len(found))
    k = min(k, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = (s ^ h[i : len(h) - k + 1 + i]) * _A + _C
        s ^= s >> np.uint64(29)
    return np.unique(_mix(s))


def node_of(u: np.ndarray) -> int:
    """The signed 64-bit id of a set: the sum of its elements, spread anew."""
    h = (int(_mix(u ^ _C).sum(dtype=np.uint64)) + len(u) * int(_C)) % (1 << 64)
    return h - (1 << 64) if h >> 63 else h


class Bands:
    """Size bands for links of num/den or more: a pair's larger set is in the smaller one's band or in the next."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.top = [1]
        while self.top[-1] < 1 << 40:
            self.top.append(max(self.top[-1] + 1, (self.top[-1] + 1) * den // num))

    def band(self, n: int) -> int:
        return bisect_left(self.top, n)

    def most_differences(self, total: int) -> int:
        """Largest symmetric difference of two linked sets whose sizes add up to ``total``."""
        return total * (self.den - self.num) // (self.den + self.num)

    @lru_cache(maxsize=512)  # noqa: B019
    def cut(self, band: int) -> tuple[int, np.ndarray]:
        """Differences allowed in the band, and the lower edges of its blocks."""
        d = self.most_differences(2 * self.top[band])
        m = d + SPARE + d // SPARE_IN
        return d, np.array([(b << 64) // m for b in range(1, m)], np.uint64)

    def keys(self, u: np.ndarray, band: int) -> np.ndarray:
        """Bucket keys of a set in a band, whose lowest bit is the band's; none where only equal sets can be linked."""
        d, edges = self.cut(band)
        if d == 0:
            return np.empty(0, np.uint64)
        ends = np.concatenate([[0], np.searchsorted(u, edges), [len(u)]])
        parity = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(u)])[ends]
        block = np.arange(len(edges) + 1, dtype=np.uint64)
        keys = _mix((parity[1:] ^ parity[:-1]) + _mix((np.uint64(band) << np.uint64(32)) + block + _C))
        keys = keys & ~np.uint64(1) | np.uint64(band & 1)
        filled = ends[1:] > ends[:-1]
        return keys[filled] if len(filled) - int(filled.sum()) < len(edges) + 1 - d else keys

    def spare(self, u: np.ndarray) -> list[int]:
        """For even and odd bands: how many buckets a set may leave and still meet every set that it is linked with.

        Of m blocks m - d agree at least, so the filled ones of a set that do are m - d less its empty ones, or more.
        """
        out = [0, 0]
        for band in self.home_and_next(len(u)):
            d, edges = self.cut(band)
            filled = len(np.unique(np.searchsorted(edges, u, "right")))
            out[band & 1] = max(0, filled - d - 1)
        return out

    def home_and_next(self, n: int) -> list[int]:
        b = self.band(n)
        return [b, b + 1] if n * self.den // self.num > self.top[b] else [b]

    def sketch(self, u: np.ndarray) -> bytes:
        """Parity bits, at least four for each difference that the next band allows, folded to fit when compared."""
        width = 256
        while width < 4 * self.most_differences(2 * self.top[self.band(len(u)) + 1]) and width < 1 << 20:
            width *= 2
        at = (_mix(u + _B) >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)
        return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8)).tobytes()


def fold(sketch: np.ndarray, width: int) -> np.ndarray:
    """The sketch at a smaller power of two: bits are numbered by leading hash bits, so neighbours meet."""
    bits = np.unpackbits(sketch)
    return np.packbits(np.bitwise_xor.reduce(bits.reshape(width, -1), axis=1))


def distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    w = min(len(x), len(y))
    x, y = (fold(z, 8 * w) if len(z) > w else z for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def set_table(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(row_id, text_key, n, node, sketch, spare) for every row; ``node`` is null for empty sets."""

    def batch(texts: pa.Array) -> pa.Array:
        words, bands, n, node, sketch, spare = Words(), Bands(num, den), [], [], [], []
        for x in texts.cast(pa.binary()):
            u = shingles(x.as_py() or b"", k, words)
            n.append(len(u))
            node.append(node_of(u) if len(u) else None)
            sketch.append(bands.sketch(u) if len(u) else None)
            spare.append(bands.spare(u) if len(u) else None)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.binary()), pa.array(spare, pa.list_(pa.int32()))], ["n", "node", "sketch", "spare"])

    made = F.arrow_udf(batch, "struct<n:long,node:long,sketch:binary,spare:array<int>>")(F.col("text"))
    return docs.select("row_id", "text_key", made.alias("s")).select("row_id", "text_key", "s.*")


def bucket_rows(docs: DataFrame, k: int, num: int, den: int, text_col: str = "text") -> DataFrame:
    """(bucket, node) for every block key of every set; sets that a task has met already are left out, to pre-aggregate copies."""

    def rows(batches):
        words, bands, met = Words(), Bands(num, den), set()
        for batch in batches:
            keys, nodes, held = [], [], 0
            for x in batch.column(0).cast(pa.binary()):
                u = shingles(x.as_py() or b"", k, words)
                if not len(u) or (node := node_of(u)) in met:
                    continue
                if len(met) > 250_000:
                    met.clear()
                met.add(node)
                own = [bands.keys(u, b) for b in bands.home_and_next(len(u))]
                keys += own
                nodes.append((node, sum(map(len, own))))
                held += nodes[-1][1]
                if held > 500_000:
                    yield _pairs_batch(keys, nodes)
                    keys, nodes, held = [], [], 0
            if held:
                yield _pairs_batch(keys, nodes)

    return docs.select(text_col).mapInArrow(rows, "bucket long, node long")


def _pairs_batch(keys: list, nodes: list) -> pa.RecordBatch:
    node = np.repeat(np.array([n for n, _ in nodes], np.int64), [c for _, c in nodes])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(node)], ["bucket", "node"])


def _scan_buckets(batches):
    """From rows sorted by bucket and node: (0, smallest node, node) for the others, and (1, bucket, node) in buckets of three or more.

    What a bucket needs to go on in the next batch is its first two nodes, their number and the last one, however large it is.
    """
    bucket = first = second = last = None
    count = 0
    for batch in batches:
        k, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
        fresh[0] = not (count and k[0] == bucket and v[0] == last)
        k, v = k[fresh], v[fresh]
        if not len(k):
            continue
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.concatenate([start, [len(k)]]))
        lead, total = v[start].copy(), size.copy()
        goes_on = bool(count) and k[0] == bucket
        if goes_on:
            lead[0], total[0] = first, size[0] + count
        of = np.repeat(np.arange(len(start)), size)
        pair = v != lead[of]
        member = (total >= 3)[of]
        extra: list = []
        if goes_on and count < 3 <= total[0]:
            extra = [first, second][:count]
        out_kind = np.concatenate([np.zeros(pair.sum(), np.int8), np.ones(member.sum() + len(extra), np.int8)])
        out_a = np.concatenate([lead[of][pair], k[member], np.full(len(extra), bucket if extra else 0, np.int64)])
        out_b = np.concatenate([v[pair], v[member], np.array(extra, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(out_kind), pa.array(out_a), pa.array(out_b)], ["kind", "a", "b"])
        tail = v[start[-1] :]
        if len(start) == 1 and goes_on:
            second, count = (second if count > 1 else tail[0]), count + len(tail)
        else:
            first, second, count = tail[0], (tail[1] if len(tail) > 1 else None), len(tail)
        bucket, last = k[-1], v[-1]


def near_enough(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sketches' Hamming distance and sizes allow a link."""

    def passes(na: pa.Array, nb: pa.Array, sa: pa.Array, sb: pa.Array) -> pa.Array:
        bands = Bands(num, den)
        return pa.array([distance(x.as_py(), y.as_py()) <= bands.most_differences(p.as_py() + q.as_py()) for p, q, x, y in zip(na, nb, sa, sb, strict=True)], pa.bool_())

    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    joined = pairs.join(a, "a").join(b, "b").where((F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num))
    return joined.where(F.arrow_udf(passes, "boolean")("na", "nb", "sa", "sb")).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, chosen: DataFrame, k: int, num: int, den: int, text_col: str = "text") -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are linked. ``chosen``: (row_id, node), a row to read for each node; ``docs`` has row_id."""

    def sets(ids: pa.Array, texts: pa.Array) -> pa.Array:
        words, out = Words(), []
        for node, x in zip(ids.to_pylist(), texts.cast(pa.binary()), strict=True):
            u = shingles(x.as_py() or b"", k, words)
            out.append(u.tobytes() if len(u) and node_of(u) == node else None)
        return pa.array(out, pa.binary())

    def linked(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y, strict=True):
            u, v = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
            both = len(u) + len(v) - len(np.union1d(u, v))
            out.append(den * both >= num * (len(u) + len(v) - both))
        return pa.array(out, pa.bool_())

    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(chosen, "node")
    read = docs.select("row_id", F.col(text_col).alias("t")).join(needed, "row_id").select("node", F.arrow_udf(sets, "binary")("node", "t").alias("u")).where("u is not null")
    read = written(read.dropDuplicates(["node"]), "sets")
    both = pairs.join(read.select(F.col("node").alias("a"), F.col("u").alias("ua")), "a").join(read.select(F.col("node").alias("b"), F.col("u").alias("ub")), "b")
    return both.where(F.arrow_udf(linked, "boolean")("ua", "ub")).select("a", "b")


def apart(members: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(head, node, component): the nodes of every bucket that links leave in several groups, with the bucket's smallest node and the node's group.

    Linked nodes of different groups share no bucket that hangs together, so all that they must agree in are open. Each node leaves its largest
    open buckets, as many as it may: the smallest that two linked ones share is none of them, since larger ones that both are in come first.
    """
    told = members.join(labels.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))

    def still_open(rows: DataFrame, *more) -> DataFrame:
        return rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), *more).where("lo <> hi").drop("lo", "hi")

    rows = written(told.join(still_open(told, F.count("*").alias("size")), "bucket"), "opened")
    band = F.col("bucket").bitwiseAND(F.lit(1))
    place = F.row_number().over(Window.partitionBy("node", band).orderBy(F.col("size").desc(), "bucket"))
    rows = rows.withColumn("place", place).join(nodes.select("node", "spare"), "node").where(F.col("place") > F.get("spare", band.cast("int")))
    rows = written(rows.select("bucket", "node", "component"), "kept")
    return written(rows.join(still_open(rows, F.min("node").alias("head")), "bucket").select("head", "node", "component").distinct(), "apart")


def open_pairs(members: DataFrame, labels: DataFrame, nodes: DataFrame, num: int, den: int, block: int = 2048) -> DataFrame:
    """Pairs of nodes in different groups so far that buckets hold together and whose sketches allow a link.

    Buckets that hang together go. The others are joined to clusters over the nodes they share, so that a pair is looked at once and not in
    every bucket; a cluster's nodes are dealt into blocks by hash and each pair of blocks is one group of rows.
    """
    held = apart(members, labels, nodes)
    cluster = connected(held, "head", "node").select(F.col("id").alias("node"), F.col("component").alias("bucket"))
    told = held.select("node", "component").distinct().join(cluster, "node")
    sizes = told.groupBy("bucket").agg((F.count("*") / block).cast("int").alias("last"))
    dealt = told.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("last") + 1).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component")
    rows = dealt.join(nodes.select("node", "n", "sketch"), "node")

    def compare(batches):
        """Groups come sorted and one after another; none is larger than two blocks, so one group is held at a time."""
        bands, held = Bands(num, den), None
        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            ends = np.flatnonzero(np.any([np.diff(rows.column(c).to_numpy()) != 0 for c in range(3)], axis=0)) + 1 if rows.num_rows else []
            start = 0
            for end in ends:
                yield from _cross(rows.slice(start, end - start), bands)
                start = end
            held = rows.slice(start)
        if held is not None and held.num_rows:
            yield from _cross(held, bands)

    grouped = rows.select("bucket", "i", "j", "own", "node", "component", "n", "sketch").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    return grouped.mapInArrow(compare, "a long, b long").distinct()


def _cross(rows: pa.RecordBatch, bands: Bands, most: int = 100_000):
    """Batches (a, b) of the node pairs of one pair of blocks that are in different groups so far and whose sizes and sketches allow a link.

    Rows are taken in the order of their sizes, so that a row's partners by size are one run. Sketches get wider with size: a
    pair is compared at its smaller set's width, to which the other one is folded.
    """
    i, j, own, node, group, n = (rows.column(c).to_numpy() for c in (1, 2, 3, 4, 5, 6))
    one = i[0] == j[0]
    if len(node) < 2 or (one and len(node) == 2 and group[0] == group[1]):
        return
    raw = [np.frombuffer(s.as_buffer(), np.uint8) for s in rows.column(7)]
    size = np.array([len(x) for x in raw])
    order = np.lexsort((node, n, size))
    held: list = []
    count = 0
    for width in np.unique(size):
        # Partners of this width's sets that are as large or larger, at this width.
        most_n = int(n[size == width].max()) * bands.den // bands.num
        rank = order[(size[order] >= width) & (n[order] <= most_n)]
        rank = rank[np.argsort(n[rank], kind="stable")]
        bits = np.stack([fold(raw[x], 8 * width) if size[x] > width else raw[x] for x in rank])
        sizes = n[rank]
        for k in np.flatnonzero(size[rank] == width):
            r = rank[k]
            stop = np.searchsorted(sizes, sizes[k] * bands.den // bands.num, "right")
            # Of equal width, later ones only; wider ones always, for they don't come round to this row.
            other = np.arange(np.searchsorted(sizes, sizes[k], "left"), stop)
            x = rank[other]
            ok = (group[x] != group[r]) & ((other > k) | (size[x] > width))
            if not one:
                ok &= own[x] != own[r]
            other = other[ok]
            if not len(other):
                continue
            far = np.bitwise_count(bits[other] ^ bits[k]).sum(axis=1, dtype=np.int64)
            x = rank[other[far <= (sizes[other] + sizes[k]) * (bands.den - bands.num) // (bands.den + bands.num)]]
            if len(x):
                held.append(np.stack([np.minimum(node[x], node[r]), np.maximum(node[x], node[r])]))
                count += len(x)
            if count >= most:
                yield _two(held)
                held, count = [], 0
    if held:
        yield _two(held)


def _two(held: list) -> pa.RecordBatch:
    a, b = np.concatenate(held, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def grouped_rows(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(row_id, text_key, n, component) for every row of ``docs`` (row_id, text): ``component`` is a number for each group, null for empty sets."""
    made = written(set_table(docs.withColumn("text_key", F.xxhash64("text")), k, num, den), "sets")
    nodes = written(made.where("node is not null").groupBy("node").agg(F.min("row_id").alias("row_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("spare").alias("spare")), "nodes")
    scanned = bucket_rows(docs, k, num, den).repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_scan_buckets, "kind byte, a long, b long")
    scanned = written(scanned, "buckets")
    stars = scanned.where("kind = 0").select("a", "b").distinct()
    links = written(verified(written(near_enough(stars, nodes, num, den), "near"), docs, nodes, k, num, den), "links")
    labels = connected(links)
    more = written(open_pairs(scanned.where("kind = 1").select(F.col("a").alias("bucket"), F.col("b").alias("node")), labels, nodes, num, den), "open")
    if more.limit(1).count():
        late = written(verified(more, docs, nodes, k, num, den), "late")
        labels = connected(links.unionByName(late))
    told = made.join(labels.select(F.col("id").alias("node"), "component"), "node", "left")
    return told.select("row_id", "text_key", "n", F.coalesce("component", "node").alias("component"))


def _keyed(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """(row_id, doc_id, text): ``row_id`` is the id as a string that no null matches."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.select(_row_id(F.col("doc_id")).alias("row_id"), "doc_id", "text")


def _row_id(key):
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))


def components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: its set's size and the smallest id reachable over links of num/den or more."""
    keyed = _keyed(docs, key, text_col)
    told = grouped_rows(keyed, k, num, den).join(keyed.select("row_id", "doc_id").distinct(), "row_id")
    least = told.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return told.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every group of near copies, with the columns of ``docs``: the smallest id's (null last), of its texts that of the least hash,
    and of rows equal in both the least one. Rows without shingles all stay."""
    keyed = _keyed(docs, key, text_col)
    told = grouped_rows(keyed, k, num, den).where("component is not null").groupBy("component", "row_id", "text_key").agg(F.count("*").alias("times"))
    told = written(told.join(keyed.select("row_id", "doc_id").distinct(), "row_id"), "rows")
    first = told.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first"))
    told = written(told.join(first, "component").select("row_id", "text_key", "times", (F.struct("doc_id", "text_key").eqNullSafe(F.struct("first.doc_id", "first.text_key"))).alias("stays")), "stays")
    own = [_row_id(F.col(f"`{key}`")).alias("__row"), F.xxhash64(F.col(f"`{text_col}`")).alias("__text")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__r"), *own)
    picked = lambda where: small(told.where(where).select(F.col("row_id").alias("__row"), F.col("text_key").alias("__text")))
    left = rows.join(picked("not stays"), ["__row", "__text"], "left_anti")
    if told.where("stays and times > 1").limit(1).count():
        many = picked("stays and times > 1")
        once = left.join(many, ["__row", "__text"], "left_semi").groupBy("__row", "__text").agg(F.min("__r").alias("__r"))
        left = left.join(many, ["__row", "__text"], "left_anti").select("__r").unionByName(once.select("__r"))
    return left.select("__r.*")


def op5_parity_sketch_join(spark, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), 3, 90, 100)


def brute_force(rows: list[tuple], k: int = 3, num: int = 90, den: int = 100) -> list[tuple]:
    """The query's rows by comparing all pairs of word-shingle sets; for tests."""
    sets = []
    for d, t in rows:
        w = (t or "").encode().translate(_LOWERED).split()
        sets.append((d, frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and min(len(a), len(b)) * den >= max(len(a), len(b)) * num and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets)]
