"""Quality classifier: supervised subword embeddings trained by numpy stochastic gradient descent.

Every word of a text gives itself and its character n-grams (over UTF-8 bytes, word ends marked) as features, hashed into a fixed number of
buckets; a word that repeats the one before it also gives the word bigram of equal words, which has one bucket for all words. A document is the average of its features' learned vectors, with ``blank`` zero vectors added so that a few words don't decide alone;
a softmax over two classes gives its score, the probability of label 1. Whole texts are read, in training too.

Training runs on a bounded sample of the labelled rows: the ``max_train`` smallest by a hash of the id among the rows in the learning fold, as far
as their texts have no more than ``max_train_chars`` characters together. Only these rows reach the driver. Scoring is a column over all rows: at
inference the two class weights of a bucket collapse into one number, so the broadcast model is ``buckets`` floats, whatever the input. A batch's
distinct words are scored once, by array operations over their bytes, and documents add up their words' scores.

Cases: null and empty texts have no features and score 0.5, undecided; null ids count as not held out; labels that are null or
contradict each other are left out; of rows that share an id the least text is learned; with no labels, or one class only, every score is the
smoothed share of label 1; extra columns pass through, and the score replaces a column of its name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import table

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
#: Its inverse modulo 2**64.
_BACK = pow(_BASE, -1, 1 << 64)
#: The bucket (modulo their number) of the bigram of two equal words.
TWICE = 1_000_003
#: Bytes of text that a task splits into words at once.
SLICE = 1 << 20


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 18
    dims: int = 8
    grams: tuple = (1, 3, 4)
    epochs: int = 4
    rate: float = 0.5
    max_train: int = 4000
    max_train_chars: int = 64_000_000
    seed: int = 11
    threshold: float = 0.3
    blank: int = 80


@dataclass
class Model:
    """``weight``: for each bucket the difference of the two classes' scores; ``bias``: not 0 only where nothing could be learned."""

    params: Params
    weight: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text."""
        out = np.empty(len(texts))
        for a, b in _slices(texts):
            ends, codes, words = split_words(texts.slice(a, b - a))
            total, count = word_sums(words, self.weight, self.params)
            again = _by_document(repeats(codes, ends, words), ends)
            z = _by_document(total[codes], ends) + again * self.weight[TWICE % self.params.buckets]
            z /= _by_document(count[codes], ends) + again + self.params.blank
            out[a:b] = 1 / (1 + np.exp(-np.clip(self.bias + z, -50, 50)))
        return out


def _slices(texts: pa.Array):
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= SLICE:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _by_document(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])[ends])


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where each text's words start in the list of all words (and the end), the words' numbers among the distinct ones, and those.

    Words are runs of anything but the six ASCII white-space characters; the empty strings that splitting leaves at the ends are words
    without features.
    """
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    ends = parts.offsets.to_numpy()
    found = parts.flatten().dictionary_encode()
    return ends - ends[0], found.indices.to_numpy(), found.dictionary


def repeats(codes: np.ndarray, ends: np.ndarray, words: pa.Array) -> np.ndarray:
    """1 for every word that equals the one before it in its text."""
    same = np.zeros(len(codes))
    filled = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    same[1:] = (codes[1:] == codes[:-1]) & filled[codes[1:]]
    same[ends[:-1][ends[:-1] < len(codes)]] = 0
    return same


class _Padded:
    """Distinct words laid out as 0 word 0 word ... 0: ``at`` is each word's first zero, ``size`` its length."""

    def __init__(self, words: pa.Array):
        raw = words.cast(pa.large_binary())
        buffers = raw.buffers()
        ends = np.frombuffer(buffers[1], np.int64, len(raw) + 1, raw.offset * 8)
        data = np.frombuffer(buffers[2] or b"", np.uint8)[ends[0] : ends[-1]]
        self.size = np.diff(ends)
        self.at = np.concatenate([[0], np.cumsum(self.size + 1)])[:-1].astype(np.int64)
        self.bytes = np.zeros(len(data) + len(raw) + 1, np.uint8)
        self.bytes[np.arange(len(data)) + np.repeat(np.arange(1, len(raw) + 1), self.size)] = data

    def grams(self, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all n-byte strings, and for each word the first of its own and how many they are; single bytes leave the zeros out."""
        wide = self.bytes.astype(np.uint64)
        u = np.full(max(0, len(wide) - n + 1), n, np.uint64)
        for i in range(n):
            u = (u << np.uint64(8)) | wide[i : i + len(u)]
        inner = n == 1
        start, count = self.at + inner, np.maximum(0, self.size + (0 if inner else 3 - n))
        return _bucket(u, buckets), start, np.where(self.size > 0, count, 0)

    def whole(self, buckets: int) -> np.ndarray:
        """Each word's own bucket: a polynomial of its bytes."""
        wide = self.bytes.astype(np.uint64) + np.uint64(1)
        wide[self.at] = 0
        wide[-1] = 0
        power = np.cumprod(np.full(len(wide), _BASE, np.uint64))
        back = np.cumprod(np.full(len(wide), _BACK, np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wide * power)])
        return _bucket((total[self.at + self.size + 1] - total[self.at]) * back[self.at], buckets)


def _bucket(u: np.ndarray, buckets: int) -> np.ndarray:
    u = (u ^ (u >> np.uint64(29))) * _SPREAD
    return ((u ^ (u >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def word_sums(words: pa.Array, weight: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct word the sum of its features' weights and their number."""
    padded = _Padded(words)
    total = np.where(padded.size > 0, weight[padded.whole(p.buckets)], 0.0)
    count = (padded.size > 0).astype(np.float64)
    for n in p.grams:
        ids, start, many = padded.grams(n, p.buckets)
        sums = np.concatenate([[0.0], np.cumsum(weight[ids])])
        start = np.minimum(start, len(ids))
        total += sums[start + many] - sums[start]
        count += many
    return total, count


def document(text: str, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares of its features."""
    ends, codes, words = split_words(pa.array([text], pa.string()))
    padded, times = _Padded(words), np.bincount(codes, minlength=len(words))
    ids, of = [padded.whole(p.buckets)[padded.size > 0]], [np.flatnonzero(padded.size > 0)]
    for n in p.grams:
        found, start, many = padded.grams(n, p.buckets)
        word = np.repeat(np.arange(len(words)), many)
        ids.append(found[np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)])
        of.append(word)
    again = int(repeats(codes, ends, words).sum())
    ids = np.concatenate([*ids, np.full(min(again, 1), TWICE % p.buckets)])
    weight = np.concatenate([times[np.concatenate(of)], np.full(min(again, 1), again)]).astype(np.float64)
    u, where = np.unique(ids, return_inverse=True)
    return u, (np.bincount(where, weight, len(u)) / (weight.sum() + p.blank)).astype(np.float32)


def train(rows: list[tuple[str, int]], p: Params = Params()) -> Model:
    """``rows``: (text, label). Classes weigh the same, so that a rare class is learned as well."""
    ones = sum(y for _, y in rows)
    if not rows or ones in (0, len(rows)):
        return Model(p, np.zeros(p.buckets), float(np.log((ones + 1) / (len(rows) - ones + 1))))
    rng = np.random.default_rng(p.seed)
    vectors = rng.uniform(-1 / p.dims, 1 / p.dims, (p.buckets, p.dims)).astype(np.float32)
    out = np.zeros((2, p.dims), np.float32)
    docs = [(*document(text, p), y) for text, y in rows]
    share = {1: len(rows) / (2 * ones), 0: len(rows) / (2 * (len(rows) - ones))}
    steps, done = p.epochs * len(docs), 0
    for _ in range(p.epochs):
        for k in rng.permutation(len(docs)):
            ids, part, y = docs[k]
            rate = p.rate * (1 - done / steps) * min(share[y], 4.0)
            done += 1
            mean = part @ vectors[ids] if len(ids) else np.zeros(p.dims, np.float32)
            z = out @ mean
            e = np.exp(z - z.max())
            g = e / e.sum()
            g[y] -= 1
            back = g @ out
            out -= rate * np.outer(g, mean)
            if len(ids):
                # Averaging shrinks a feature's gradient by the text's length; the square root keeps long texts teachable.
                vectors[ids] -= (rate * np.sqrt(len(ids))) * part[:, None] * back[None, :]
    return Model(p, (vectors @ (out[1] - out[0])).astype(np.float64), 0.0)


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text_col: str = "text", p: Params = Params()) -> list[tuple[str, int]]:
    """The bounded sample: ids are chosen among the labels first, so texts are read for at most ``max_train`` rows, without a shuffle of texts."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("__y")).where("y = __y")
    chosen = known.where(~held_out(F.col(key))).orderBy(F.xxhash64(key), key).limit(p.max_train).select(F.col(key).alias("__id"), "y")
    rows = docs.select(F.col(key).alias("__id"), F.coalesce(text_col, F.lit("")).alias("t")).join(F.broadcast(chosen), "__id")
    least = rows.groupBy("__id", "y").agg(F.min("t").alias("t"))
    held = F.sum(F.length("t").cast("long")).over(Window.orderBy(F.xxhash64("__id"), "__id"))  # max_train rows at most
    return [(r[1], int(r[2])) for r in least.select("__id", "t", "y", held.alias("held")).where(F.col("held") <= p.max_train_chars).orderBy("__id").collect()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", **how) -> Model:
    return train(training_rows(docs, labels, label, **how), how.get("p", Params()))


def score_column(model: Model, text, spark):
    shared = spark.sparkContext.broadcast(model)

    def batch(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts), pa.float64())

    return F.arrow_udf(batch, "double")(text)


def score_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", out: str = "score", model: Model | None = None) -> DataFrame:
    """``docs`` with the score of every whole text, by a model fitted on the labels unless one is given."""
    model = model or fit(docs, labels, text_col=text_col)
    return docs.withColumn(out, score_column(model, F.col(text_col), docs.sparkSession))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = Params.threshold) -> DataFrame:
    """The documents scored at ``threshold`` or more, with the columns of ``docs``."""
    return score_quality(docs, labels, text_col, "__score").where(F.col("__score") >= threshold).drop("__score")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= Params.threshold).cast("int").alias("predicted"))


def brute_force(text: str | None, model: Model) -> float:
    """The score of one text, word by word and n-gram by n-gram; for tests."""
    p, m = model.params, (1 << 64) - 1

    def weight(u: int) -> float:
        u = ((u ^ (u >> 29)) * int(_SPREAD)) & m
        return float(model.weight[(u ^ (u >> 32)) % p.buckets])

    total, count, before = 0.0, 0, None
    for word in (text or "").encode().split():
        if word == before:
            total += float(model.weight[TWICE % p.buckets])
            count += 1
        before = word
        padded = b"\0" + word + b"\0"
        total += weight(sum((b + 1) * pow(_BASE, i + 1, 1 << 64) for i, b in enumerate(word)) & m)
        count += 1
        for n in p.grams:
            inside = word if n == 1 else padded
            for i in range(len(inside) - n + 1):
                total += weight(int.from_bytes(inside[i : i + n], "big") | n << 8 * n)
                count += 1
    return float(1 / (1 + np.exp(-np.clip(model.bias + total / (count + p.blank), -50, 50))))
