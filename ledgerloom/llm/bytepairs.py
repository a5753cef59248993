"""Byte-level BPE over tables: words are split in Spark, every distinct word is encoded once, ids are joined back by position, and decoding joins ids to pieces.

The distinct words and their ids are a table. Its most frequent words, at most ``HOT`` rows of at most ``HOT_BYTES`` bytes, are broadcast, so that
nearly every word of a text is replaced where the text is read; all others come back through a join by word and then by row and position.
Every text, of any length, takes both ways at once: nothing depends on how many words there are.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType

from .shared import table, written

#: How the public byte-level vocabularies cut text into words, a fixed value; white space is Unicode's.
SPACE = r"\s\x85\p{Z}"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Rows of the broadcast part of the word table, and bytes of a word in it.
HOT, HOT_BYTES = 1 << 20, 32


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary file of the tokenizers library: byte-level BPE without normaliser, prefix space or post-processor."""

    source: str

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        """Reads the file on the driver; it goes to the executors as a broadcast of some megabytes, the size of the vocabulary."""
        with open(path, encoding="utf-8") as f:
            source = f.read()
        told = json.loads(source)
        steps = told["pre_tokenizer"] or {}
        plain = steps.get("type") == "ByteLevel" and steps.get("use_regex", True) and not steps.get("add_prefix_space") and not told["normalizer"] and not told["post_processor"]
        if not plain or told["model"]["type"] != "BPE":
            raise ValueError("only byte-level BPE files without normaliser, prefix space and post-processor are read")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in told["added_tokens"]):
            raise ValueError("added tokens must be plain strings")
        return cls(source)

    def added(self) -> dict[str, int]:
        return {t["content"]: t["id"] for t in json.loads(self.source)["added_tokens"]}

    def pieces(self) -> list[tuple[int, bytes]]:
        """(id, bytes) of every piece. Pieces are written in an alphabet in which each byte that isn't a printable Latin-1 character is one from U+0100 on."""
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        vocabulary, added = json.loads(self.source)["model"]["vocab"], self.added()
        return sorted([(i, bytes(byte[c] for c in p)) for p, i in vocabulary.items() if p not in added] + [(i, p.encode()) for p, i in added.items()])


def words(col, added: list[str] = ()):
    """The array of a text's words in order, whose concatenation is the text; an added token is a word of its own."""
    cut = lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0))
    if not added:
        return cut(col)
    mark = "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))
    marks = F.regexp_extract_all(col, F.lit(mark), F.lit(0))
    several = F.flatten(F.transform(F.split(col, mark, -1), lambda s, i: F.concat(cut(s), F.slice(marks, i + 1, F.lit(1)))))
    return F.when(col.rlike(mark), several).otherwise(cut(col))


@lru_cache(maxsize=1)
def _library(source: str):
    """The library's tokenizer, made once for each Python worker; a task is one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    library = tokenizers.Tokenizer.from_str(source)
    library.no_truncation()
    library.no_padding()
    return library


def word_table(spark: SparkSession, split: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(word, n, ids, hot): each distinct word of ``split`` (words) with its count and its ids as little-endian numbers of 32 bits, written."""
    source = spark.sparkContext.broadcast(tokenizer.source)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(source.value)
        for b in batches:
            coded = library.encode_batch(b.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.array(c.ids, "<u4").tobytes() for c in coded], pa.binary())], ["word", "n", "ids"])

    counted = split.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return written(counted.mapInArrow(encode, "word string, n long, ids binary"), "words")


def _often(coded: DataFrame, most: int):
    """The condition of the broadcast part: words of few bytes, from the least count at which no more than ``most`` are left. Counts are looked at by eighths of powers of two."""
    level = F.floor(8 * F.log2("n"))
    sizes = sorted(((r.level, r["count"]) for r in coded.where(F.octet_length("word") <= HOT_BYTES).groupBy(level.alias("level")).count().collect()), reverse=True)
    least, so_far = 1 << 30, 0
    for at, n in sizes:
        so_far += n
        if so_far > most:
            break
        least = at
    return (level >= least) & (F.octet_length("word") <= HOT_BYTES)


def _in_slices(f, *columns: pa.Array, rows: int = 256) -> pa.Array:
    """``f`` of some rows at a time, so that what it makes on the way stays small."""
    return pa.concat_arrays([f(*[c.slice(a, rows) for c in columns]) for a in range(0, max(len(columns[0]), 1), rows)])


def _shared(spark: SparkSession, column: pa.ChunkedArray):
    """A broadcast of a column as Arrow bytes."""
    sink = pa.BufferOutputStream()
    part = pa.table({"c": column})
    with pa.ipc.new_stream(sink, part.schema) as out:
        out.write_table(part)
    return spark.sparkContext.broadcast(sink.getvalue().to_pybytes())


def _coder(spark: SparkSession, words_of_hot: pa.ChunkedArray):
    """An Arrow function of an array of words. It gives the codes as one value, places in the broadcast table from 1 on and 0 for words that aren't there, and after it those words in order, packed."""
    hot = _shared(spark, words_of_hot)

    def codes_of(col: pa.Array) -> pa.Array:
        got, ends = col.flatten().dictionary_encode(), _ends(col)
        place = pc.index_in(got.dictionary, value_set=pa.ipc.open_stream(hot.value).read_all()["c"].combine_chunks())
        codes = (place.fill_null(-1).to_numpy(zero_copy_only=False) + 1).astype("<u4")[got.indices.to_numpy(zero_copy_only=False)]
        missing = codes == 0
        rest = got.dictionary.take(got.indices.filter(pa.array(missing))).cast(pa.binary())
        seen = np.concatenate([[0], np.cumsum(missing)])[ends]
        zstd = pa.Codec("zstd", compression_level=7)
        out = []
        for a, b, c, d in zip(ends, ends[1:], seen, seen[1:], strict=False):
            planes = np.ascontiguousarray(codes[a:b].view(np.uint8).reshape(-1, 4).T[:3]).tobytes()
            own = rest.slice(c, d - c)
            sizes = pc.binary_length(own).to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            packed = sizes + b"".join(own.to_pylist())
            out.append([int(b - a).to_bytes(4, "little") + zstd.compress(planes, asbytes=True), *([int(d - c).to_bytes(4, "little") + len(packed).to_bytes(8, "little") + zstd.compress(packed, asbytes=True)] if d > c else [])])
        return pa.array(out, pa.list_(pa.binary()))

    @F.arrow_udf("array<binary>")
    def code(col: pa.Array) -> pa.Array:
        return _in_slices(codes_of, col, rows=2000)

    return code


@F.arrow_udf(ArrayType(StringType()))
def _rare(packed: pa.Array) -> pa.Array:
    """The words that ``_coder`` packed, in order."""
    out = []
    for x in packed.to_pylist():
        if x is None:
            out.append(None)
            continue
        n, size = int.from_bytes(x[:4], "little"), int.from_bytes(x[4:12], "little")
        blob = pa.decompress(x[12:], size, "zstd", asbytes=True)
        ends = 4 * n + np.concatenate([[0], np.cumsum(np.frombuffer(blob[: 4 * n], "<u4").astype(np.int64))])
        out.append([blob[a:b].decode() for a, b in zip(ends, ends[1:], strict=False)])
    return pa.array(out, pa.list_(pa.string()))


def _ends(lists: pa.ListArray) -> np.ndarray:
    """Where each list ends in the flattened values, after a first 0; null lists are empty."""
    return np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)])).astype(np.int64)


def _joiner(spark: SparkSession, ids_of_hot: pa.ChunkedArray):
    """An Arrow function that puts a text's ids together from its codes and the ids of its other words in order."""
    shared = _shared(spark, ids_of_hot)
    held: list[np.ndarray] = []

    def ids_of(codes: pa.Array, cold: pa.Array) -> pa.Array:
        if not held:
            told = pa.ipc.open_stream(shared.value).read_all()["c"]
            sizes = np.concatenate([[0], pc.binary_length(told).to_numpy() // 4]).astype(np.int32)
            held.extend([sizes, np.frombuffer(b"".join(c.take(pa.array(range(len(c)))).buffers()[2].to_pybytes() if len(c) else b"" for c in told.chunks), "<u4").astype(np.int32)])
        sizes, flat = held
        starts = np.concatenate([[0], np.cumsum(sizes)])
        out, ends = [], [0]
        for packed, rest in zip(codes.to_pylist(), cold.to_pylist(), strict=True):
            size = int.from_bytes(packed[:4], "little")
            planes = np.frombuffer(pa.decompress(packed[4:], 3 * size, "zstd", asbytes=True), np.uint8).reshape(3, size).astype(np.int64)
            code = planes[0] | planes[1] << 8 | planes[2] << 16
            length, other = sizes[code].astype(np.int64), code == 0
            rest = rest or []
            if other.sum() != len(rest):
                raise RuntimeError("words without ids")
            length[other] = [len(x) // 4 for x in rest]
            ends_of = np.cumsum(length)
            total = int(ends_of[-1]) if size else 0
            at = np.arange(total) + np.repeat(starts[code] - (ends_of - length), length)
            ids = flat[np.minimum(at, max(len(flat) - 1, 0))] if len(flat) else np.empty(total, np.int32)
            if rest:
                ids[np.repeat(other, length)] = np.frombuffer(b"".join(rest), "<u4").astype(np.int32)
            out.append(ids)
            ends.append(ends[-1] + total)
        return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.concatenate(out) if out else np.empty(0, np.int32)))

    @F.arrow_udf("array<int>")
    def join(codes: pa.Array, cold: pa.Array) -> pa.Array:
        return _in_slices(ids_of, codes, cold)

    return join


def _rows(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """(__row, key, __text), and whether the row is the key itself: where that is a whole number that no two rows share. Else rows are numbered once, in a written table."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    if isinstance(docs.schema[key].dataType, LongType):
        seen = rows.agg(F.count("*").alias("n"), F.count_distinct(key).alias("k")).first()
        if seen.n == seen.k:
            return rows.where(F.col(key).isNotNull()).select(F.col(key).alias("__row"), key, "__text"), True
    return written(rows.select(F.monotonically_increasing_id().alias("__row"), key, "__text"), "numbered"), False


def encode(docs: DataFrame, tokenizer: Tokenizer, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(key, ids): every row of ``docs`` with the ids of its whole text, in order.

    Null and empty texts have no ids. Keys may be null or repeated, and repeated rows stay; other columns of ``docs`` take no part. Added tokens
    in a text are encoded as such. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows, named = _rows(docs, key, text)
    rows = rows.withColumn("words", words(F.col("__text"), list(tokenizer.added()))).drop("__text")
    coded = word_table(spark, rows, tokenizer)
    often = _often(coded, hot)
    top = coded.where(often).select("word", "n", "ids").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    split = rows.select("__row", _coder(spark, top["word"])("words").alias("c")).repartition("__row")  # one exchange, read twice
    cold = split.select("__row", F.posexplode(_rare(F.get("c", F.lit(1)))).alias("at", "word")).join(coded.where(~often).select("word", "ids"), "word")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])
    cold = cold.groupBy("__row").agg(ordered.alias("cold"))
    both = split.join(cold, "__row", "left").select("__row", _joiner(spark, top["ids"])(F.get("c", F.lit(0)), "cold").alias("ids"))
    return both.select(F.col("__row").alias(key), "ids") if named else both.join(rows.select("__row", key), "__row").select(key, "ids")


def decode(tokens: DataFrame, tokenizer: Tokenizer, ids: str = "ids", text: str = "text") -> DataFrame:
    """``tokens`` with the text of its ``ids``, through a join of ids with the piece table, which has one row for each id of the vocabulary and is broadcast.

    Ids that the vocabulary lacks and null ids give nothing; bytes that are no UTF-8 become U+FFFD; null ids arrays give empty texts.
    """
    table = tokenizer.pieces()
    size = 1 + max(i for i, _ in table)
    pieces = [b""] * size
    for i, p in table:
        pieces[i] = p
    shared = tokens.sparkSession.sparkContext.broadcast(pieces)
    held: list[pa.Array] = []

    def texts(col: pa.Array) -> pa.Array:
        if not held:
            held.append(pa.array([*shared.value, b""], pa.large_binary()))
        flat = col.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        flat = np.where((flat >= 0) & (flat < size), flat, size)
        ends = _ends(col)
        met = held[0].take(pa.array(flat))
        at = np.frombuffer(met.buffers()[1], np.int64)[met.offset : met.offset + len(met) + 1]
        data = met.buffers()[2]
        return pa.array([data[int(at[a]) : int(at[b])].to_pybytes().decode("utf-8", "replace") if b > a else "" for a, b in zip(ends, ends[1:], strict=False)], pa.string())

    @F.arrow_udf("string")
    def join(col: pa.Array) -> pa.Array:
        return _in_slices(texts, col)

    return tokens.withColumn(text, join(ids))


@F.arrow_udf(BinaryType())
def packed(ids: pa.Array) -> pa.Array:
    """Ids as little-endian numbers of 32 bits."""

    def blobs(col: pa.Array) -> pa.Array:
        flat, ends = col.flatten().to_numpy(zero_copy_only=False).astype("<u4"), _ends(col)
        return pa.array([flat[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())

    return _in_slices(blobs, ids)


def op12_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the public byte-level vocabulary and decoded again."""
    import public_tokenizers

    tokenizer = Tokenizer.load(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = decode(encode(table(spark, sf_dir, "documents"), tokenizer), tokenizer).select("doc_id", packed("ids").alias("ids"), "text")
    return tokens.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
