"""Block search, words of byte-level BPE and hard negatives, against plain restatements on odd input."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bytepairs, hardnegatives, lexicalblocks

# --- ranked lexical search


def ranked(queries, docs, k):
    """Every score of every document, as the contract states it."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    rows = [(i, Counter(terms(t))) for i, t in docs]
    rows = [(i, c) for i, c in rows if c]
    n_docs, total, df = len(rows), sum(sum(c.values()) for _, c in rows), Counter(t for _, c in rows for t in c)
    asked = {}
    for i, t in queries:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        found = []
        for i, c in rows:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def text_of(r, n):
    return " ".join(r.choice(["Alpha", "beta", "x9", "été", "ÉTÉ", "the", "THE", "of"] + [f"w{r.randrange(60)}" for _ in range(4)]) for _ in range(n))


def odd_docs():
    r = random.Random(5)
    docs = [(i, text_of(r, r.randrange(1, 40))) for i in range(150)]
    docs += [(i + 1000, docs[3][1]) for i in range(60)]  # copies: equal scores
    docs += [(7000, None), (7001, ""), (7002, "!?"), (7003, "alpha " * 30000), (None, "alpha beta"), (5, "alpha x9"), (5, "alpha x9")]
    return docs


ASKED = [(1, "Alpha, beta w3 w4"), (2, "the of"), (3, None), (4, "nowhere"), (5, "w1 w2 w3 w4 w5 w6 w7 w8 été"), (None, "alpha"), (6, "x9"), (6, "w9")]


@pytest.mark.parametrize(("segment", "block"), [(1024, 128), (24, 4)])
def test_block_search(spark, monkeypatch, segment, block):
    monkeypatch.setattr(lexicalblocks, "SEGMENT", segment)
    monkeypatch.setattr(lexicalblocks, "BLOCK", block)
    docs = spark.createDataFrame([(i, t, 0) for i, t in odd_docs()], "doc_id long, text string, item_id int")
    queries = spark.createDataFrame([(i, t, 1) for i, t in ASKED], "item_id long, text string, doc_id int")
    for k in (5, 50):
        assert sorted(tuple(r) for r in lexicalblocks.search(queries, docs, k).collect()) == ranked(ASKED, odd_docs(), k)


def test_block_search_in_several_blocks_of_queries_and_empty(spark, monkeypatch):
    docs = spark.createDataFrame(odd_docs(), "doc_id long, text string")
    queries = spark.createDataFrame(ASKED, "item_id long, text string")
    assert lexicalblocks.search(queries, docs.where("false")).count() == 0
    assert lexicalblocks.search(queries.where("false"), docs).count() == 0
    monkeypatch.setattr(lexicalblocks, "QUERIES", 2)
    assert sorted(tuple(r) for r in lexicalblocks.search(queries, docs, 7).collect()) == ranked(ASKED, odd_docs(), 7)


def test_blocks_are_left_out_only_by_their_bounds(spark):
    """Every document's score is at most the bound of each block that holds it, and blocks leave out most of the work for a rare term."""
    shared = spark.sparkContext.broadcast(lexicalblocks.Asked.of(ASKED[:2] + ASKED[4:5]))
    counted = lexicalblocks.count_terms(spark.createDataFrame(odd_docs(), "doc_id long, text string"), shared, "doc_id", "text")
    corpus = spark.sparkContext.broadcast(lexicalblocks.corpus_of(counted, len(shared.value.place)))
    batch = lexicalblocks.build_index(counted, shared, corpus).toArrow().combine_chunks().to_batches()[0]
    for r in range(batch.num_rows):
        s = lexicalblocks.Segment({n: batch.column(i)[r] for i, n in enumerate(batch.schema.names)})
        for terms in shared.value.terms:
            weight = np.zeros(len(corpus.value.weights), np.int64)
            weight[terms] = corpus.value.weights[terms]
            for b in range(len(s.block_term)):
                if s.block_term[b] in terms:
                    assert s.scores(np.array([b]), weight)[1].max() <= s.bounds(np.array([b]), weight)[0]


# --- byte-level BPE

TEXTS = ["", None, "hello  world\n\n  x", "a<|endoftext|>  <|endoftext|>b !<|endoftext|>", "don't 'sx I'LL we'll", "   x　\u0085y", "emoji 👩‍👩‍👧 é ñ 中文字 ١٢٣ ½", "=" * 500 + " x" * 3, "tab\t\tq \t\n", "   ", " ", "'''s", "hello  world\n\n  x", "\x00\x1c a\x1f", "x" * 70000, "ab " * 20000]


@pytest.mark.parametrize("hot", [0, 3, bytepairs.HOT])
def test_bpe_as_the_library_does(spark, hot):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, library = bytepairs.Tokenizer.load(path), Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    keys = [None if i == 3 else 5 if i == 6 else i for i in range(len(TEXTS))]
    docs = spark.createDataFrame([(k, t, "c", 1) for k, t in zip(keys, TEXTS, strict=True)], "doc_id long, text string, ids string, word int")
    got = bytepairs.decode(bytepairs.encode(docs, tokenizer, hot=hot), tokenizer).collect()
    want = [(k, library.encode(t or "", add_special_tokens=False).ids, t or "") for k, t in zip(keys, TEXTS, strict=True)]
    assert sorted(map(repr, ((r.doc_id, list(r.ids), r.text) for r in got))) == sorted(map(repr, want))
    assert bytepairs.encode(docs.where("false"), tokenizer, hot=hot).count() == 0
    unique = docs.where("doc_id > 6").select("doc_id", "text")  # the way without numbering
    assert {r.doc_id: list(r.ids) for r in bytepairs.encode(unique, tokenizer, hot=hot).collect()} == {k: w for k, w, _ in want if k is not None and k > 6}


def test_decoding_odd_ids(spark):
    tokenizer = bytepairs.Tokenizer.load(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, [50256, 0, None, 99999999, -1]), (2, None), (3, []), (4, [447])]
    got = {r.k: r.text for r in bytepairs.decode(spark.createDataFrame(rows, "k int, ids array<int>"), tokenizer).collect()}
    assert got == {1: "<|endoftext|>!", 2: "", 3: "", 4: dict(tokenizer.pieces())[447].decode("utf-8", "replace")}


def test_bpe_query(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = bytepairs.op12_bpe_words(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bytepairs.Tokenizer.load(public_tokenizers.path("word_bpe_49k.json"))


# --- hard negatives


def mined(rows, asked, positives, negatives):
    good = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i] = min(good.get(i, (label, q := [math.floor(256 * x) for x in v])), (label, q)) if i in good else (label, [math.floor(256 * x) for x in v])
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in filter(asked, good):
        scored = sorted((-dot(good[a][1], v), b, label) for b, (label, v) in good.items() if b != a)
        for p, pos, _ in [x for x in scored if x[2] == good[a][0]][:positives]:
            hits = [(s, b) for s, b, label in scored if label != good[a][0] and 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(a, pos, r, b, -p, -s) for r, (s, b) in enumerate(hits, 1)]
    return sorted(out)


def odd_vectors():
    r = random.Random(2)
    vec = lambda n=6: [r.choice([-1, 1]) * r.random() for _ in range(n)]
    rows = [(i, 0 if i % 3 else i % 4, vec()) for i in range(400)]
    rows += [(500 + i, i % 2, rows[10][2]) for i in range(60)]  # copies of one vector in both labels
    rows += [(700, None, vec()), (701, 1, None), (702, 1, [1.0, None]), (703, 1, [math.nan] * 6), (704, 1, [math.inf] * 6), (705, 1, []), (706, 2, vec(3)), (None, 1, vec()), (20, 9, vec()), (20, 0, vec()), (710, 5, vec())]
    return rows


@pytest.mark.parametrize(("block", "chunk"), [(512, 16384), (16, 7)])
def test_hard_negatives(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(hardnegatives.blocks_of, "__defaults__", (block,))
    monkeypatch.setattr(hardnegatives, "ANCHORS", chunk)
    df = spark.createDataFrame([(*x, 1) for x in odd_vectors()], "vec_id long, label int, embedding array<double>, id int")
    got = hardnegatives.mine(df, F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == mined(odd_vectors(), lambda i: i % 10 == 0, 5, 10)
    assert hardnegatives.mine(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0
    assert hardnegatives.mine(df, F.lit(False)).count() == 0


def test_hilbert_curve_visits_every_cell_by_single_steps():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = cells[sorted(range(len(cells)), key=lambda i, keys=hardnegatives.hilbert_keys(cells, 3): keys[i].tobytes())]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_zone_maps_leave_blocks_out():
    """Blocks whose bounds lie outside every window are not asked for; those that hold a row inside one are."""
    r = np.random.default_rng(1)
    anchors = r.integers(-50, 50, (20, 4)).astype(float)
    rows = np.repeat(r.integers(-50, 50, (40, 4)), 8, axis=0) + r.integers(-2, 3, (320, 4))
    low = r.integers(0, 3000, (20, 1))
    w = hardnegatives.Windows(np.arange(20), np.zeros(20, int), anchors, low, low + 300, False)
    asked = 0
    for b in rows.reshape(40, 8, 4):
        met = set(w.met(1, b.min(0).astype(float), b.max(0).astype(float)).tolist())
        s = anchors @ b.T
        assert set(np.flatnonzero(((s >= low) & (s <= low + 300)).any(1)).tolist()) <= met
        asked += len(met)
    assert asked < 400


# --- lines


def test_lines_of_tables_with_clashing_names(spark):
    from ledgerloom.llm import fuzzylines

    names = ["__id", "__text", "__gone", "__t", "__d", "n_lines"]
    rows = [(i, "same line of some length\nown line number %d is here" % (i * 7919), *["x"] * 6) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = {r.doc_id: r for r in fuzzylines.dedup_lines(df).collect()}
    assert [got[i].n_gone for i in range(4)] == [0, 1, 1, 1] and got[1].text == "own line number 7919 is here" and got[2]["__id"] == "x"


def test_lines_of_the_same_words_in_other_orders(spark, monkeypatch):
    """They share every minimum, but few of their pairs are compared; the near copy among them is found."""
    import random

    from ledgerloom.llm import fuzzylines

    r = random.Random(11)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
    lines = [" ".join(r.sample(words, 40)) for _ in range(100)]
    lines.append(lines[0].replace(lines[0][60], "z", 1))
    compared, similar = [], fuzzylines.similar

    def counted(pairs, *more):
        compared.append(pairs.count())
        return similar(pairs, *more)

    monkeypatch.setattr(fuzzylines, "similar", counted)
    got = {x.doc_id for x in fuzzylines.dropped_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == {100} and sum(compared) < 100 * 99 / 2 / 2
