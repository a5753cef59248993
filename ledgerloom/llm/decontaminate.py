"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The automaton of all items is built once (its size is bounded: see ``max_words``) and every document's
words are streamed through it. The state after a word tells the longest run of words that ends there
and also stands in some item; a run of ``window`` words or more marks its words as hit. Items shorter
than the window count as one window of their own length.

Beyond ``max_words`` item words the items are cut into shards with an automaton each, and a
document's hits are merged over the shards, so no broadcast outgrows the bound.

Cases: null or empty texts have no words and no hits; null items have no window; repeated items count once for each id;
items with a null id are ignored; empty tables give empty or unmarked results; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table

#: Words of the lower-cased UTF-8 bytes: digits, a-z and every non-ASCII character.
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
HIT = "struct<n_words:long,hits:array<struct<first:int,last:int,start:int,stop:int>>,items:array<string>>"


class ItemAutomaton:
    """Generalised suffix automaton over item words, with what a state means for windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.names = window, [name for name, _ in items]
        self.step: list[dict] = [{}]
        self.link, self.size = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._grow(last, w)
        n = len(self.size)
        self.full: list[set] = [set() for _ in range(n)]  # items that hold the window of this state
        self.short: dict[int, list[tuple[int, int]]] = {}  # state -> (length, item) of whole short items
        self.up = [-1] * n  # the nearest state at or above with the window-long suffix
        order = sorted(range(n), key=self.size.__getitem__)
        for s in order:
            p = self.link[s]
            if self.size[s] >= window:
                self.up[s] = s if p < 0 or self.size[p] < window else self.up[p]
        for k, (_, words) in enumerate(items):
            s = 0
            for i, w in enumerate(words):
                s = self.step[s][w]
                if i + 1 >= window:
                    self.full[self.up[s]].add(k)
            if 0 < len(words) < window:
                self.short.setdefault(s, []).append((len(words), k))
        self.least = [0] * n  # shortest match that completes a window here; a large number: none does
        self.above = [-1] * n  # nearest state at or above where a short item ends
        for s in order:
            p = self.link[s]
            own = min((length for length, _ in self.short.get(s, ())), default=1 << 30)
            self.above[s] = s if s in self.short else self.above[p] if p >= 0 else -1
            self.least[s] = min(own, window if self.size[s] >= window else 1 << 30, self.least[p] if p >= 0 else 1 << 30)

    def _new(self, size: int, step: dict, link: int) -> int:
        self.size.append(size)
        self.step.append(step)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """State for the strings of q that are no longer than those of p and w."""
        if self.size[q] == self.size[p] + 1:
            return q
        copy = self._new(self.size[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = copy
            p = self.link[p]
        return copy

    def _grow(self, last: int, w: bytes) -> int:
        if w in self.step[last]:
            return self._split(last, w, self.step[last][w])
        now, p = self._new(self.size[last] + 1, {}, 0), last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = now
            p = self.link[p]
        if p >= 0:
            self.link[now] = self._split(p, w, self.step[p][w])
        return now

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal hit runs (first and last word) and the items with a window in ``words``."""
        step, link, size, least, window = self.step, self.link, self.size, self.least, self.window
        runs: list[list[int]] = []
        ends: set[tuple[int, int]] = set()
        s = n = 0
        for i, w in enumerate(words):
            t = step[s].get(w)
            if t is None:
                while t is None and s > 0:
                    s = link[s]
                    t = step[s].get(w)
                if t is None:
                    n = 0
                    continue
                n = size[s] + 1
            else:
                n += 1
            s = t
            if n < least[s]:
                continue
            ends.add((s, min(n, window)))
            reach = window if n >= window else max(length for length, _ in self._short(s, n))
            if runs and i - reach <= runs[-1][1]:
                runs[-1][0], runs[-1][1] = min(runs[-1][0], i - reach + 1), i
            else:
                runs.append([i - reach + 1, i])
        items: set[int] = set()
        for s, n in ends:
            if n >= window:
                items |= self.full[self.up[s]]
            items.update(k for _, k in self._short(s, n))
        return _merge(runs), items

    def _short(self, s: int, n: int):
        s = self.above[s]
        while s >= 0:
            yield from ((length, k) for length, k in self.short[s] if length <= n)
            s = self.above[self.link[s]] if self.link[s] >= 0 else -1


def _merge(runs: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, runs)):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def words_of(text: str | None) -> list[bytes]:
    return TOKEN.findall((text or "").encode("utf-8", "surrogatepass").lower())


def shards_of(benchmark: DataFrame, id_col: str, text_col: str, max_words: int):
    """Lists of (id, words) with at most ``max_words`` words each (one longer item makes a shard of its own)."""
    rows = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).distinct()
    shard: list = []
    held = 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        if words := words_of(r.t):
            if shard and held + len(words) > max_words:
                yield shard
                shard, held = [], 0
            shard.append((r.i, words))
            held += len(words)
    if shard:
        yield shard


def _marker(automaton):
    @F.arrow_udf(HIT)
    def mark(texts: pa.Array) -> pa.Array:
        sam, out = automaton.value, []
        for raw in texts.cast(pa.binary()):
            data = (raw.as_py() or b"").lower()
            words = TOKEN.findall(data)
            runs, items = sam.stream(words) if sam else ([], ())
            hits = []
            if runs:
                at = [m.span() for m in TOKEN.finditer(data)]
                hits = [{"first": a, "last": b, "start": at[a][0], "stop": at[b][1]} for a, b in runs]
            out.append({"n_words": len(words), "hits": hits, "items": sorted({sam.names[k] for k in items})} if hits else {"n_words": len(words), "hits": [], "items": []})
        kind = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([(k, pa.int32()) for k in ("first", "last", "start", "stop")]))), ("items", pa.list_(pa.string()))])
        return pa.array(out, kind)

    return mark


def mark_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, max_words: int = 1_000_000, out: str = "contamination") -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, hits (word numbers and UTF-8 byte ranges of maximal runs), items."""
    spark = docs.sparkSession
    found = []
    for shard in shards_of(benchmark, item_id, item_text, max_words):
        found.append(_marker(spark.sparkContext.broadcast(ItemAutomaton(shard, window))))
    marks = found or [_marker(spark.sparkContext.broadcast(None))]
    if len(marks) == 1:
        return docs.withColumn(out, marks[0](F.col(text_col)))
    parts = [f"__{out}_{k}" for k in range(len(marks))]
    for name, mark in zip(parts, marks, strict=True):
        docs = docs.withColumn(name, mark(F.col(text_col)))
    hits = F.array_sort(F.concat(*[F.col(p)["hits"] for p in parts]))
    # Runs of different shards may overlap or touch: a fold over the sorted runs joins them.
    kind = "array<struct<first:int,last:int,start:int,stop:int>>"

    def fold(acc, x):
        last = F.element_at(acc, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        return F.when((F.size(acc) > 0) & (x["first"] <= last["last"] + 1), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    merged = F.aggregate(hits, F.array().cast(kind), fold)
    items = F.array_sort(F.array_distinct(F.concat(*[F.col(p)["items"] for p in parts])))
    return docs.withColumn(out, F.struct(F.col(parts[0])["n_words"].alias("n_words"), merged.alias("hits"), items.alias("items"))).drop(*parts)


def n_hit(mark) -> "F.Column":
    return F.aggregate(mark["hits"], F.lit(0).cast("long"), lambda a, x: a + (x["last"] - x["first"] + 1))


def is_contaminated(mark, share_of: int = 20):
    """At least one hit, and one word in ``share_of`` or more is hit."""
    return (n_hit(mark) > 0) & (n_hit(mark) * share_of >= mark["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", action: str = "drop", min_run: int = 13, **how) -> DataFrame:
    """Documents without benchmark passages, with the columns of ``docs``.

    ``action`` "drop": contaminated documents go, others stay as they are. "cut": hit runs of ``min_run`` words or more are
    cut out of every text, and contaminated documents keep what is left.
    """
    marked = mark_hits(docs, benchmark, text_col, out="__mark", **how)
    if action == "drop":
        return marked.where(~is_contaminated(F.col("__mark"))).select(*[F.col(f"`{c}`") for c in docs.columns])
    if action != "cut":
        raise ValueError(f"unknown action {action!r}")
    raw = F.encode(F.col(text_col), "UTF-8")
    runs = F.filter(F.col("__mark")["hits"], lambda x: x["last"] - x["first"] + 1 >= min_run)
    edges = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("kept"))
    piece = lambda a, b: F.decode(F.substring(raw, a + 1, b - a), "UTF-8")
    walk = F.aggregate(runs, edges, lambda s, x: F.struct(x["stop"].alias("at"), F.concat(s["kept"], F.array(piece(s["at"], x["start"]))).alias("kept")))
    rest = F.array_join(F.concat(walk["kept"], F.array(piece(walk["at"], F.length(raw)))), "")
    return marked.withColumn(text_col, F.when(F.size(runs) > 0, rest).otherwise(F.col(text_col))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_hits(docs, table(spark, sf_dir, "benchmark"), out="mark")
    m = F.col("mark")
    return marked.select(
        "doc_id",
        m["n_words"].alias("n_words"),
        n_hit(m).alias("n_hit"),
        F.size(m["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(m["items"], ","), 256).alias("items_sha256"),
        is_contaminated(m).alias("contaminated"),
    )


def brute_force(texts: list[tuple], items: list[tuple], window: int = 13) -> list[tuple]:
    """The query's rows by comparing word windows; for tests."""
    wanted: dict[tuple, set] = {}
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wanted.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    lengths = sorted({len(k) for k in wanted})
    out = []
    for d, t in texts:
        w, hit, seen = words_of(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if found := wanted.get(tuple(w[k : k + n])):
                    seen |= found
                    hit |= set(range(k, k + n))
        ids = ",".join(sorted(seen))
        out.append((d, len(w), len(hit), len(seen), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out
