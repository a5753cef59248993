"""Removal of repeated 100-byte strings by bucket-pointer refinement of a sampled suffix array.

Two 100-byte strings are equal when they stand in one bucket of the suffix array at depth 100. A bucket's identifier at depth 2d is made of the
identifiers at depth d of the suffix itself and of the one d bytes later, so the identifiers of 50-byte grams are used again for
depth 100. What is sorted across the cluster is a sample: in every 100-byte string the smallest 50-gram identifier marks one
suffix, and equal strings mark the same place. Strings that follow one another and share their mark form one entry, one for about
26 bytes, with the mark's bucket and, as its refinement, a digest of the entry's whole text.

Pass 1 sorts entries by bucket, refinement and place. Buckets with one entry are done, like most. Entries with the same refinement
are the same text: all but the first repeat. The first ones of a bucket with several refinements go on.
Pass 2 refines those alone: their strings' depth-100 identifiers are sorted with their places, and all but the first of each repeat.
Copies within one task's block of rows leave only their first entry to the sort, so a passage that stands in a third
of all documents reaches the sort once for each block. Identifiers are 64-bit hashes.

Cases: null and empty texts keep nothing; texts under 100 bytes are kept whole unless they are empty; rows with equal ids and texts are one
document and get the same result; equal ids with other texts order by a hash of the text; null ids come first; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import table, written

LENGTH, GRAM = 100, 50
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_CODE = _RANDOM.integers(0, 1 << 64, 256, np.uint64)  # a random number for each byte value
_BASE = 0xD6E8FEB86659FD93
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 2 << 20
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _BLOCK + 4096)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


class Block:
    """Several texts laid end to end, with the identifiers of their suffixes."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.start = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        up, self.down = _powers(len(self.data) + 1)
        self.sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_CODE[self.data] * up[: len(self.data)], out=self.sums[1:])

    def digest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A hash of the bytes from a to b, the same wherever they stand."""
        return _mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64) * _C)

    def grams(self) -> np.ndarray:
        """Bucket identifiers at depth 50 for each place where 50 bytes follow."""
        n = len(self.data) - GRAM + 1
        return _mix((self.sums[GRAM:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.empty(0, np.uint64)

    def strings(self, grams: np.ndarray) -> np.ndarray:
        """Identifiers at depth 100 from those at depth 50, by doubling the depth."""
        ids, depth = grams, GRAM
        while depth < LENGTH:
            ids = _mix(ids[: len(ids) - depth] + _C * ids[depth:]) if len(ids) > depth else ids[:0]
            depth *= 2
        return ids

    def valid(self) -> np.ndarray:
        """Places whose 100 bytes lie within one text."""
        ok = np.zeros(max(0, len(self.data) - LENGTH + 1), bool)
        for a, b in zip(self.start[:-1], self.start[1:], strict=True):
            if b - a >= LENGTH:
                ok[a : b - LENGTH + 1] = True
        return np.flatnonzero(ok)

    def entries(self) -> tuple[np.ndarray, ...]:
        """(bucket, refinement, first place, last place) of every run of strings with the same mark."""
        at = self.valid()
        if not len(at):
            return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
        grams = self.grams()
        low = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        span, width = low, 1
        reach = LENGTH - GRAM + 1  # as many grams as start in a string
        while width * 2 <= reach:
            span = np.minimum(span[:-width], span[width:])
            width *= 2
        rest = reach - width
        mark = (np.minimum(span[: len(span) - rest], span[rest:])[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (mark[1:] != mark[:-1]) | (at[1:] != at[:-1] + 1)]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        m, a, b = mark[first], at[first], at[last]
        # The refinement covers the entry's text and where the mark stands in it.
        return grams[m], _mix(self.digest(a, b + LENGTH) + (m - a).astype(np.uint64) * _A), a, b


def _blocks(batches):
    """(row numbers in the block, ids, texts) with about ``_BLOCK`` bytes of text."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            raw = t.as_py() or b""
            if held and held + len(raw) > _BLOCK:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(raw)
            held += len(raw)
    if ids:
        yield ids, texts


ENTRY = "bucket long, refined long, row_id long, place long"


def _entry_rows(batches):
    """All entries, their first place and their length in ``place``. Those that repeat an earlier entry of their block are settled: they travel apart
    from their bucket, with a negative place."""
    for ids, texts in _blocks(batches):
        block = Block(texts)
        bucket, refined, a, b = block.entries()
        if not len(a):
            continue
        text = np.searchsorted(block.start, a, side="right") - 1
        row = np.array(ids, np.int64)[text]
        place = (a - block.start[text]) * 128 + (b - a)
        order = np.lexsort((place, row, refined, bucket))
        same = np.zeros(len(a), bool)
        x, y = bucket[order], refined[order]
        same[order[1:]] = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
        bucket = np.where(same, _mix(row.astype(np.uint64) + _B), bucket)
        yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(refined.view(np.int64)), pa.array(row), pa.array(np.where(same, -1 - place, place))], ["bucket", "refined", "row_id", "place"])


FOUND = "row_id long, first int, last int, repeats boolean"


def _sort_entries(batches):
    """From entries sorted by bucket, refinement and place: those that repeat, and the first ones of buckets with several refinements.

    All that is kept from one batch to the next is the bucket at hand, its last refinement and its first entry.
    """
    bucket = refined = head = None
    several = False
    for batch in batches:
        k, r, row, place = (batch.column(c).to_numpy() for c in range(4))
        settled = place < 0
        place = np.where(settled, -1 - place, place)
        a = (place // 128).astype(np.int32)
        b = a + (place % 128).astype(np.int32)
        if settled.any():
            yield _found(row[settled], a[settled], b[settled], np.ones(int(settled.sum()), bool))
            k, r, row, a, b = (x[~settled] for x in (k, r, row, a, b))
        if not len(k):
            continue
        goes_on = bucket is not None and k[0] == bucket
        new_k = np.concatenate([[not goes_on], k[1:] != k[:-1]])
        new_r = new_k | np.concatenate([[not (goes_on and r[0] == refined)], r[1:] != r[:-1]])
        of = np.cumsum(new_k) - (0 if goes_on else 1)  # number of the bucket in the batch; 0 is the one that goes on
        kinds = np.bincount(of, weights=new_r, minlength=of[-1] + 1)
        before = several
        if goes_on:
            kinds[0] += 2 if before else 1
        opened = (kinds >= 2)[of] & new_r
        repeats = ~new_r
        extra = [head] if goes_on and not before and kinds[0] >= 2 else []
        # The last bucket may go on: its first entry waits until a second refinement shows.
        start = np.flatnonzero(of == of[-1])[0]
        keep = repeats | opened
        out = [np.concatenate([x[keep], np.array([e[c] for e in extra], x.dtype)]) for c, x in enumerate((row, a, b))]
        yield _found(*out, np.concatenate([repeats[keep], np.zeros(len(extra), bool)]))
        if not (goes_on and of[-1] == 0):
            head = (row[start], a[start], b[start])
        several = bool(kinds[-1] >= 2)
        bucket, refined = k[-1], r[-1]


def _found(row, a, b, repeats):
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(repeats, pa.bool_())], ["row_id", "first", "last", "repeats"])


def _string_rows(batches):
    """(string, row_id, place, settled) for the strings of the entries that go on; batch columns: row_id, text, entries."""
    for batch in batches:
        entries = {i: e for i, e in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)}
        for ids, texts in _blocks([batch]):
            block = Block(texts)
            string = block.strings(block.grams())
            places, rows, offsets = [], [], []
            for i, s in zip(ids, block.start, strict=False):
                own = np.concatenate([np.arange(e["first"], e["last"] + 1) for e in entries[i]])
                places.append(own + s)
                offsets.append(own)
                rows.append(np.full(len(own), i, np.int64))
            at, row, off = np.concatenate(places), np.concatenate(rows), np.concatenate(offsets)
            ids_of = string[at]
            order = np.lexsort((off, row, ids_of))
            same = np.zeros(len(at), bool)
            same[order[1:]] = ids_of[order][1:] == ids_of[order][:-1]
            key = np.where(same, _mix(row.astype(np.uint64) + _B), ids_of)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(row), pa.array(off.astype(np.int32)), pa.array(same)], ["string", "row_id", "place", "settled"])


def _sort_strings(batches):
    """Runs of strings that repeat, from rows sorted by string and place."""
    last = None
    for batch in batches:
        s = batch.column(0).to_numpy()
        settled = batch.column(3).to_numpy(zero_copy_only=False)
        row, place = batch.column(1).to_numpy()[settled], batch.column(2).to_numpy()[settled]
        if len(row):
            yield _found(row, place, place, np.ones(len(row), bool))
        rest = ~settled
        s = s[rest]
        if not len(s):
            continue
        again = np.concatenate([[last is not None and s[0] == last], s[1:] == s[:-1]])
        row, place = batch.column(1).to_numpy()[rest][again], batch.column(2).to_numpy()[rest][again]
        last = s[-1]
        yield _found(row, place, place, np.ones(len(row), bool))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(row_id, runs): for each row of ``docs`` (row_id, text) with repeated strings, the places where they start, as [first, last] runs."""
    entries = docs.select("row_id", "text").mapInArrow(_entry_rows, ENTRY)
    found = entries.repartition("bucket").sortWithinPartitions("bucket", "refined", "row_id", "place").mapInArrow(_sort_entries, FOUND)
    found = written(found, "entries", free=True)
    going_on = found.where("not repeats").groupBy("row_id").agg(F.collect_list(F.struct("first", "last")).alias("entries"))
    strings = docs.select("row_id", "text").join(going_on, "row_id").select("row_id", "text", "entries").mapInArrow(_string_rows, "string long, row_id long, place int, settled boolean")
    late = strings.repartition("string").sortWithinPartitions("string", "row_id", "place").mapInArrow(_sort_strings, FOUND)
    late = written(late, "strings", free=True)
    every = found.where("repeats").select("row_id", "first", "last").unionByName(late.select("row_id", "first", "last"))
    return every.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def cut_runs(raw: bytes, runs: list, length: int = LENGTH) -> tuple[bytes, int, int]:
    """The bytes that no repeated string covers, the number of bytes removed, and of maximal removed runs."""
    kept, at, removed, spans = [], 0, 0, 0
    for r in runs:
        a, b = r["first"], r["last"] + length
        if b <= at and spans:
            continue
        if not spans or a > at:
            kept.append(raw[at:a])
            spans += 1
            at = a
        removed += b - at
        at = b
    kept.append(raw[at:])
    return b"".join(kept), removed, spans


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``row_id`` from 0 in this order: sorted ranges count their rows, and only the ranges' counts are added up."""
    ranged = written(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__part").count()
    before = counts.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    return ranged.withColumn("__in", inside).join(before, "__part").withColumn("row_id", F.col("__before") + F.col("__in") - 1).drop("__part", "__in", "__before")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``key``, n_bytes, n_removed, n_spans, kept) for every row; ``kept`` is binary, since a cut may fall within a character.

    Earlier means a smaller ``key``, then an earlier start. Where all keys are longs and differ they number the rows; else rows with equal
    keys and texts count as one document, and documents are numbered by key and then a hash of the text.
    """
    rows = docs.select(F.col(key), F.col(text_col).alias("text"))
    plain = dict(rows.dtypes)[key] in ("bigint", "int", "smallint", "tinyint")
    if plain:
        again = rows.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1))
        plain = again.limit(1).count() == 0
    if plain:
        return _cut(rows.select(F.col(key).cast("long").alias("row_id"), "text"), key)
    rows = rows.withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    numbers = numbered(rows.select(key, "__hash").distinct(), key, "__hash").select(F.col(key).alias("__key"), F.col("__hash").alias("__of"), "row_id")
    told = rows.join(numbers, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("__of")))
    told = written(told.select(key, "row_id", "text"), "numbered")
    made = _cut(told.select("row_id", "text").dropDuplicates(["row_id"]), "__row")
    return told.select(key, F.col("row_id").alias("__row")).join(made, "__row").drop("__row")


def _cut(rows: DataFrame, key: str) -> DataFrame:
    runs = repeated_runs(rows)

    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, r in zip(texts.cast(pa.binary()), found, strict=True):
            raw = t.as_py() or b""
            kept, removed, spans = cut_runs(raw, r.as_py() or [])
            out.append({"n_bytes": len(raw), "n_removed": removed, "n_spans": spans, "kept": kept})
        return pa.array(out, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))

    made = F.arrow_udf(cut, "struct<n_bytes:long,n_removed:long,n_spans:long,kept:binary>")("text", "runs")
    return rows.join(runs, "row_id", "left").select(F.col("row_id").alias(key), made.alias("m")).select(key, "m.*")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], length: int = LENGTH) -> list[tuple]:
    """The query's rows by looking at every string in order; for tests."""
    seen: set = set()
    out = []
    for d, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
