"""The ten operators and the pipeline: contracts on small tables, brute force, round trips, edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import decontaminate, fuzzylines, licenses, matroska, mixing, ngramjoin, quality, replytrees, secrets, shared, suffixdedup  # noqa: E402

SMALL = "/root/testdata/sf0.001"
EDGE = "doc_id long, text string, lang string, source string, n_chars long, `key` string, node long, bucket string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def edge(spark):
    """Null, empty, blank and long texts, repeated rows, null ids, columns with clashing names."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 7)))
    long = " ".join(word() for _ in range(3000))
    base = " ".join(word() for _ in range(60))
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, base), (6, base), (6, base), (7, base + " more"), (8, "one"), (None, base), (9, "x" * 5000), (10, base.upper())]
    return spark.createDataFrame([(i, t, "en", s, None, "k", 1, "b") for k, (i, t) in enumerate(texts) for s in [None if k % 3 == 0 else f"s{k % 3}"]], EDGE)


@pytest.fixture(scope="module")
def none(edge):
    return edge.where("false")


def test_matroska_round_trip(spark, docs, rows):
    found = {r.doc_id: r for r in matroska.op1_matroska(spark, SMALL).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        r = found[i]
        assert matroska.brute_force(t) == (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) and r.feature.endswith("error=")


@pytest.mark.parametrize("size", [0, 1, 576, 577, 576 * 130, 200_001])
def test_matroska_tables(size):
    payload = random.Random(size).randbytes(size + -size % 576 or 576)
    data = matroska.write_audio(payload)
    got = matroska.parse(data)
    assert got["error"] is None and b"".join(data[p[4] : p[4] + p[5]] for p in got["packets"]) == payload
    assert [p[3] for p in got["packets"][:3]] == [k * 72_000_000 for k in range(min(3, len(got["packets"])))]
    for cue in got["cues"]:
        assert data[cue["cluster_start"] :].startswith(b"\x1f\x43\xb6\x75")


@pytest.mark.parametrize("kind", [1, 2, 3])
def test_matroska_lacing_of_unequal_frames(kind):
    frames = [bytes([k]) * n for k, n in enumerate((300, 255, 700, 1, 40))]
    flags, head = matroska._lace(frames, kind)
    block = b"\x81" + b"\0\0" + bytes([flags]) + head + b"".join(frames)
    out = {"packets": []}
    matroska._block(memoryview(block), 0, len(block), True, {"block": -1, "time": 0, "scale": 1, "cluster": 0}, {}, out)
    assert [block[p[4] : p[4] + p[5]] for p in out["packets"]] == frames


def test_matroska_broken_files(spark):
    good = matroska.write_audio(b"a" * 5760)
    rows = [(1, good), (2, good[: len(good) // 2]), (3, b""), (4, None), (5, b"not a file"), (6, good)]
    got = {r.k: r.mkv for r in matroska.parse_files(spark.createDataFrame(rows, "k int, content binary")).collect()}
    assert got[1].error is None and len(got[1].packets) == 10 and got[6] == got[1] and got[4] is None
    assert all(got[k].error for k in (2, 3, 5))
    assert matroska.packet_table(spark.createDataFrame(rows[:1], "k int, content binary"), "k").count() == 10
    assert matroska.cue_table(spark.createDataFrame(rows[:1], "k int, content binary"), "k").count() == 1


def test_matroska_unknown_sizes():
    cluster = matroska._id(matroska.CLUSTER) + b"\x01" + b"\xff" * 7
    block = lambda t: matroska._element(matroska.SIMPLE_BLOCK, b"\x81" + t.to_bytes(2, "big") + b"\x80" + b"data")
    track = matroska._element(matroska.TRACKS, matroska._element(matroska.TRACK_ENTRY, matroska._number(matroska.TRACK_NUMBER, 1)))
    data = matroska._id(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + track + (cluster + matroska._number(matroska.TIMESTAMP, 5) + block(1)) + (cluster + matroska._number(matroska.TIMESTAMP, 9) + block(2))
    got = matroska.parse(data)
    assert got["error"] is None and [(p[0], p[3]) for p in got["packets"]] == [(0, 6_000_000), (1, 11_000_000)]


def test_suffix_dedup(spark, rows):
    assert sorted(map(tuple, suffixdedup.op2_suffix_dedup(spark, SMALL).collect())) == sorted(suffixdedup.brute_force(rows))


def test_suffix_dedup_edges(spark, edge, none):
    got = suffixdedup.remove_repeats(edge).collect()
    assert len(got) == edge.count() and suffixdedup.remove_repeats(none).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_bytes, r.n_removed))
    assert by[1] == by[2] == {(0, 0)} and by[None].pop()[1] == 0 and all(a == b for a, b in by[6]) and len(by[6]) == 1
    run = by[9].pop()
    assert run == (5000, 4999)
    plain = edge.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    want = suffixdedup.brute_force([tuple(r) for r in plain.collect()])
    have = suffixdedup.remove_repeats(plain).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, have)) == sorted(want)


def test_license_rules(spark):
    mit = "\n".join(licenses.SENTENCES[s] for s in ("mit-title", "mit-grant", "mit-notice", "mit-as-is"))
    docs = spark.createDataFrame([(1, mit), (2, "Text.\nReleased under the  MIT   License.\nMore"), (3, None), (4, ""), (5, licenses.SENTENCES["mit-notice"]), (6, "released UNDER the mit license. Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.match_rules(licenses.sentence_hits(docs)).collect()}
    assert got[1] == "MIT" and got[2] == "MIT" and got[5] == "" and got[6] == "CC-BY-NC-4.0,MIT" and 3 not in got and 4 not in got
    assert licenses.match_rules(licenses.sentence_hits(docs.where("false"))).count() == 0


def test_license_wrapped(spark):
    import textwrap

    s = licenses.SENTENCES
    wrap = lambda *ids, mark="", between="\n\n": between.join(textwrap.fill(s.get(i, i), 60, initial_indent=mark, subsequent_indent=mark) for i in ids)
    gpl2 = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License; either version 2\nof the License, or (at your option) any later version."
    texts = {
        "MIT": wrap("mit-short", "Copyright (c) 2020 Someone", "mit-grant", "mit-notice", "mit-as-is"),
        "BSD-2-Clause": wrap("Copyright 2020 Someone", "bsd-grant", "bsd-source", "bsd-binary", mark="# ", between="\n"),
        "BSD-3-Clause": wrap("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", mark=" * ", between="\n *\n"),
        "ISC": wrap("isc-grant"),
        "Apache-2.0": wrap(s["apache-grant-the"] + "; " + s["apache-use"], "apache-copy", "http://www.apache.org/licenses/LICENSE-2.0", "apache-basis", "apache-see"),
        "GPL-3.0-or-later": wrap("gpl-free", "gpl-hope"),
        "": gpl2 + "\n\n" + wrap("gpl-hope"),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    assert {r.doc_id: r.licenses for r in licenses.match_rules(licenses.sentence_hits(docs)).collect()} == {k: k for k in texts}


def test_license_edges(edge):
    assert licenses.match_rules(licenses.sentence_hits(edge)).count() == 0


def test_mixing(spark):
    got = mixing.op4_mix_sources(spark, "/root/testdata/sf0.01").toPandas()
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    again = mixing.op4_mix_sources(spark, "/root/testdata/sf0.01").toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_mixing_ceiling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 40), ("d", 0)], "source string, size long")
    got = {r.source: (r.source_size, r.target) for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == (10, 30.0) and got["d"] == (0, 0.0) and got[None][1] <= 120
    assert abs(sum(t for _, t in got.values()) - 1550) < 1e-6


def test_mixing_edges(edge, none):
    sized = mixing.sized(edge).select("doc_id", "source", "size")
    got = mixing.balance(sized).collect()
    assert len(got) == edge.count() and all(r.taken <= 3 * r.size for r in got) and mixing.balance(sized.where("false")).count() == 0


def test_ngram_join(spark, rows):
    assert sorted(map(tuple, ngramjoin.op5_parity_sketch_join(spark, SMALL).collect())) == sorted(ngramjoin.brute_force(rows))


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_ngram_join_of_drifting_copies(spark, k, num, den):
    """Chains of copies, each a few words from the one before: links that the smallest node doesn't have."""
    r = random.Random(k)
    words = [f"w{r.randrange(10**6)}" for _ in range(400)]
    made = []
    for i in range(120):
        if i % 3:
            words[r.randrange(len(words))] = f"v{i}"
        made.append((i, " ".join(words)))
    made += [(1000 + i, " ".join(f"u{r.randrange(40)}" for _ in range(r.randint(1, 60)))) for i in range(150)]
    got = ngramjoin.components(spark.createDataFrame(made, "doc_id long, text string"), k, num, den).collect()
    assert sorted(map(tuple, got)) == sorted(ngramjoin.brute_force(made, k, num, den))


def test_ngram_join_edges(edge, none):
    got = ngramjoin.components(edge, 3, 90, 100).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == edge.count() and ngramjoin.components(none, 3, 90, 100).count() == 0
    assert by[1].n_shingles == 0 and by[1].component_id == 1 and by[2].component_id == 2 and {by[i].component_id for i in (5, 6, 7, None)} == {5} and by[8].n_shingles == 1


def test_shared_passages_make_no_clusters(spark, monkeypatch):
    """Texts that only share a passage and empty blocks leave the buckets that this puts them into; groups are those of all pairs."""
    r = random.Random(7)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage, rows = words(30), []
    for i in range(240):
        w = words(r.randrange(40, 120))
        at = r.randrange(len(w))
        rows.append((i, " ".join(w[:at] + passage + w[at:])))
    for i in range(240, 260):
        w = rows[i - 240][1].split()
        w[r.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    sizes = []

    def told(edges, *ends):
        if ends:
            sizes.append(edges.select(ends[1]).distinct().count())
        return shared.connected(edges, *ends)

    monkeypatch.setattr(ngramjoin, "connected", told)
    got = ngramjoin.components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()
    assert sorted(map(tuple, got)) == sorted(ngramjoin.brute_force(rows, 5, 80, 100))
    assert len(sizes) == 1 and sizes[0] <= 60


def test_parity_sketch_bounds_difference():
    import numpy as np

    r, bands = np.random.default_rng(3), ngramjoin.Bands(80, 100)
    for n in (5, 60, 3000):
        u = np.unique(r.integers(0, 1 << 64, n, np.uint64))
        v = np.unique(np.concatenate([u[: n - n // 10], r.integers(0, 1 << 64, n // 9, np.uint64)]))
        assert ngramjoin.distance(bands.sketch(u), bands.sketch(v)) <= len(np.setxor1d(u, v))


def line_brute(rows, tenths=9):
    """Lines that go if all pairs of lines of 15 characters or more with enough edit similarity are links, and lines that are equal."""
    norm = lambda s: re.sub(r"[ \t\n\x0b\f\r]+", " ", s.lower()).strip(" ")
    places = {}
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            if n := norm(line):
                places.setdefault(n, []).append((d, i))

    def close(a, b):
        most = max(len(a), len(b)) * (10 - tenths) // 10
        if abs(len(a) - len(b)) > most:
            return False
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            if min(row) > most:
                return False
        return row[-1] <= most

    names = sorted(places, key=len)
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if len(b) * tenths > len(a) * 10 + 10:
                break
            if len(a) >= 15 and find(a) != find(b) and close(a, b):
                root[find(b)] = find(a)
    groups = {}
    for n in names:
        groups.setdefault(find(n), []).extend(places[n])
    return {p for g in groups.values() for p in set(g) - {min(g)}}


def test_fuzzy_lines(spark, rows):
    """Against all pairs: nothing else goes, and nearly all that should."""
    r = random.Random(9)
    base = " ".join(f"word{r.randrange(500)}" for _ in range(30))
    some = [(10_000 + i, base.replace(f" word{r.randrange(500)} ", " x ") + f" tail{i % 4}") for i in range(20)] + [(d, (t or "")[:600]) for d, t in rows[:25]]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    got = {(x.doc_id, p) for x in fuzzylines.dropped_lines(docs).collect() for p in x.gone}
    want = line_brute(some)
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 19


@pytest.mark.parametrize("words", [5, 10, 20, 30, 50, 100])
def test_fuzzy_lines_recall(spark, words):
    """Against edit similarity alone: one letter, one word or a twentieth of the characters changed."""
    r = random.Random(words)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    rows = []
    for i in range(120):
        line = [word(r.randint(3, 8)) for _ in range(words)]
        text, k = " ".join(line), r.randrange(words)
        if i % 3 == 1 and words >= 20:
            other = " ".join(line[:k] + [word(len(line[k]))] + line[k + 1 :])
        else:
            at = r.sample(range(len(text)), 1 if i % 3 != 2 else max(1, len(text) // 20))
            other = "".join("0" if j in at else c for j, c in enumerate(text))
        rows += [(i, text), (1000 + i, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {x.doc_id for x in fuzzylines.dropped_lines(docs, thorough=True).collect()}
    assert all(i >= 1000 for i in gone) and len(gone) >= 114, f"{len(gone)} of 120"
    # In 16 bands, without the scattered changes.
    plain = {x.doc_id for x in fuzzylines.dropped_lines(docs.where("doc_id % 1000 % 3 < 2")).collect()}
    assert all(i >= 1000 for i in plain) and len(plain) >= 76, f"{len(plain)} of 80"


def test_fuzzy_lines_short(spark):
    docs = spark.createDataFrame([(1, "Read more\n\nfirst"), (2, "read  MORE \n\nsecond\nRead mare"), (3, "x\nRead more")], "doc_id long, text string")
    assert {(x.doc_id, p) for x in fuzzylines.dropped_lines(docs).collect() for p in x.gone} == {(2, 0), (3, 1)}


def test_fuzzy_lines_edges(edge, none):
    got = fuzzylines.dedup_lines(edge)
    assert got.columns[: len(edge.columns)] == edge.columns and fuzzylines.dedup_lines(none).count() == 0
    by = {}
    for x in got.collect():
        by.setdefault(x.doc_id, x)
    assert len(got.collect()) == edge.count() and by[1].text is None and by[2].text == "" and by[8].text == "one" and by[None].n_gone == 0 and by[5].n_gone == 1


def test_reply_trees(spark):
    rows = [("t", "a", None, "user", "q", 0.0), ("t", "b", "a", "assistant", "x <|im_end|> \\n", 2.0), ("t", "c", "a", "assistant", None, 1.0), ("t", "d", "c", "user", "y", 5.0), ("t", "e", "b", "user", "z", 1.0), ("u", "f", "gone", None, "alone", None), ("v", "g", "h", "user", "loop", 1.0), ("v", "h", "g", "user", "loop", 1.0)]
    m = spark.createDataFrame(rows, "tree string, id string, parent string, role string, text string, score double")
    got = {(r.tree, r.branch): r for r in replytrees.format_paths(replytrees.paths(m, top=2)).collect()}
    assert {k: r.leaf for k, r in got.items()} == {("t", 1): "d", ("t", 2): "e", ("u", 1): "f"}
    second = replytrees.format_paths(replytrees.paths(m, top=2)).where("branch = 2").select(replytrees.read_turns(F.col("formatted")).alias("t"), replytrees.masked_text(F.col("formatted"), F.col("loss")).alias("l")).first()
    assert [(x.role, x.text) for x in second.t] == [("user", "q"), ("assistant", "x <|im_end|> \\n"), ("user", "z")] and second.l == "x <|im_end|> \\n"
    assert replytrees.paths(m.where("false")).count() == 0


def test_escapes_round_trip(spark):
    texts = ["", "<|im_start|>", "\\", "\\\\|", "<\\|", "a\nb\\n", "<<||>>", "\\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", replytrees.unescape(replytrees.escape(F.col("t"))).alias("a"), replytrees.unescape(replytrees.escape(F.col("t"), role=True), role=True).alias("b"), replytrees.escape(F.col("t")).alias("e")).collect()
    assert all(r.a == (r.t or "") == r.b and "<|" not in r.e for r in got)


def test_conversations_edges(spark):
    c = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, 0, None, "n"), (2, 3, "user", "only")], "conv_id long, turn long, role string, text string")
    got = {r["tree"].conv_id: r for r in replytrees.format_paths(replytrees.paths(replytrees.messages_of(c))).collect()}
    assert set(got) == {1, 2, None} and len(got[1].loss) == 2 and got[2].formatted == "<|im_start|>user\nonly<|im_end|>\n"


def test_decontaminate(spark, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert sorted(map(tuple, decontaminate.op8_decontaminate(spark, SMALL).collect())) == sorted(decontaminate.brute_force(rows, items))


def test_decontaminate_small_vocabulary(spark):
    """Short items, overlaps and repeats over three words, with shards of few words too."""
    r = random.Random(2)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    items = [(i, text(r.choice((1, 3, 5, 13, 14, 30)))) for i in range(2, 12)] + [(2, text(4)), (20, None), (21, "")]
    docs = [(i, text(r.randint(0, 80))) for i in range(60)] + [(100, None), (101, "A.b-C")]
    items = [x for x in items if x[1] is None or len(x[1]) != 1]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((x[0], x[1], x[2], x[3]) for x in decontaminate.brute_force(docs, items))
    for most in (10**6, 20):
        m = decontaminate.mark_hits(d, b, max_words=most, out="m")
        got = m.select("doc_id", "m.n_words", decontaminate.n_hit(F.col("m")).alias("h"), F.size("m.items").alias("i")).collect()
        assert sorted(map(tuple, got)) == want


def test_decontaminate_actions(spark, edge, none):
    item = " ".join(f"bench{i}" for i in range(13))
    docs = spark.createDataFrame([(1, "é before. " + item.upper() + ", after é"), (2, "clean"), (3, None), (4, "é " * 400 + item)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (1, item), (None, "clean")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.decontaminate(docs, b).collect()} == {2, 3, 4}
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, b, action="cut").collect()}
    assert cut == {1: "é before. , after é", 2: "clean", 3: None, 4: "é " * 400}
    assert decontaminate.decontaminate(edge, b).count() == edge.count() and decontaminate.decontaminate(none, b).count() == 0
    assert decontaminate.decontaminate(edge, b.where("false")).columns == edge.columns


def python_spans(t):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_secrets(spark, rows):
    r = random.Random(4)
    bits = ["password", "TOKEN", "api_key", "apikey", "secret", '"', "'", " ", ":", "=", "AKIA", "AKIA" + "A1" * 9, "0af" * 9, "é", "abc123", "x.y-z=", "\n", "G"]
    texts = [(i, "".join(r.choice(bits) for _ in range(40))) for i in range(200)] + [(900, None), (901, ""), (901, ""), (902, "secret: token : abcdef"), (None, "token=secret=abcdefgh")]
    v = spark.createDataFrame(texts, "path long, text string").withColumn("version", F.lit(1)).withColumn("blob", F.lit("clash"))
    got, _, _ = secrets.scan_history(v)
    names = ("assign", "access", "hex")
    have = sorted((str(x.path), ",".join(f"{s.kind}:{s.start}:{s.stop}" for s in x.findings if s.kind in names)) for x in got.collect())
    assert have == sorted((str(p), python_spans(t or "")) for p, t in texts)
    assert secrets.scan_history(v.where("false"))[0].count() == 0


def test_secret_ledger_scans_only_unseen(spark):
    first = spark.createDataFrame([("a", 1, "token=abcdefgh"), ("b", 1, "none")], "path string, version int, text string")
    second = first.unionByName(spark.createDataFrame([("a", 2, "token=zzzzzzzz"), ("c", 1, "token=abcdefgh")], first.schema))
    _, made, ledger = secrets.scan_history(first)
    found, made2, ledger2 = secrets.scan_history(second, ledger, made)
    assert ledger.count() == 2 and ledger2.count() == 1 and made2.count() == 1
    assert {(r.path, r.version): len(r.findings) for r in found.collect()} == {("a", 1): 1, ("b", 1): 0, ("a", 2): 1, ("c", 1): 1}
    assert secrets.scan_history(second, ledger, made, rules_version="2")[2].count() == 3


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op10_quality(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_quality_edges(spark, edge, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (9, 0), (None, 1), (8, None)], "doc_id long, quality int")
    got = quality.score_quality(edge, labels)
    assert got.columns == [*edge.columns, "score"] and {r.score for r in got.where("doc_id in (1, 2)").collect()} == {0.5}
    assert quality.score_quality(none, labels).count() == 0 and quality.score_quality(edge, labels.where("false")).count() == edge.count()


def test_connected(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7), (None, 3), (300, 301), (302, 301)]
    got = {r.id: r.component for r in shared.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[200] == 100 and got[302] == 300 and None not in got
    assert shared.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_native_plans_have_no_python(spark):
    for f in (licenses.op3_license_sentences, secrets.op9_secret_ledger, replytrees.op7_format_conversations, fuzzylines.op6_fuzzy_lines, mixing.op4_mix_sources):
        plan = f(spark, SMALL)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|ArrowEval|MapInArrow|CartesianProduct", plan)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(shared.written(stage(spark, steps[-1], "/root/testdata/sf0.01"), "test"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert steps[-1].columns == docs.columns
    raw, good, lines, near, clean, mixed = steps
    have = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    some = good.where("doc_id < 60").withColumn("text", F.substring("text", 1, 1500))
    gone = line_brute([(r.doc_id, r.text) for r in some.collect()])
    told = {(x.doc_id, p) for x in fuzzylines.dropped_lines(some).collect() for p in x.gone}
    assert told <= gone and len(told) >= 0.9 * len(gone)
    groups = ngramjoin.brute_force(list(have(lines).items()), 5, 80, 100)
    assert set(have(near)) == {d for d, _, c in groups if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    hit = {x[0] for x in decontaminate.brute_force(list(have(near).items()), items) if x[5]}
    assert have(clean) == {d: t for d, t in have(near).items() if d not in hit}
    assert all(1 <= r.copies <= 3 and r.taken == r.copies * r.size for r in mixed.collect())


def test_pipeline_stages_on_edges(spark, edge):
    import corpus_pipeline

    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.where("false"), SMALL)
        assert empty.count() == 0
        docs = shared.written(stage(spark, docs, SMALL), "edge")
    assert docs.count() > 0


def test_keep_one_on_repeated_ids(spark):
    rows = [(1, "t a b c d e"), (2, "t a b c d e"), (2, "u v w x y z"), (3, "u v w x y z"), (4, "q r s"), (4, "q r s"), (None, "q r s"), (None, "alone"), (5, ""), (5, ""), (6, None)]
    got = ngramjoin.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([(1, "t a b c d e"), (2, "u v w x y z"), (4, "q r s"), (None, "alone"), (5, ""), (5, ""), (6, None)], "doc_id long, text string").collect()))


def test_mixing_stage_on_repeated_rows(spark):
    import corpus_pipeline

    rows = [(1, "a b c", "en", "s", 5)] * 3 + [(1, "d e", "en", "s", 3), (None, "f g h i", "en", "t", 7), (None, "f g h i", "en", "t", 7), (2, "j", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mixing_stage(spark, docs, SMALL).collect()
    assert all(r.size == len(r.text.split()) and r.taken == r.copies * r.size and 1 <= r.copies <= 3 for r in got)
    sums = {r.source: r for r in got}
    for s, r in sums.items():
        assert sum(x.taken for x in got if x.source == s) <= 3 * r.source_size and r.source_size == sum(len(x[1].split()) for x in rows if x[3] == s)


def test_mixing_takes_the_targets(spark):
    got = mixing.op4_mix_sources(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest")).collect()
    assert all(abs(r.taken - r.target) <= max(0.02 * r.target, 10) for r in got)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one line of some words\nother", "x", 9, 8, 7.0), (2, "one line of some words", "x", 9, 8, 7.0)], "doc_id long, text string, gone string, n_lines int, n_gone int, target double").withColumn("source", F.lit("s"))
    got = {r.doc_id: r for r in fuzzylines.dedup_lines(docs).collect()}
    assert (got[1].n_lines, got[1].n_gone, got[2].n_gone, got[1].gone) == (2, 0, 1, "x")
    mixed = mixing.balance(mixing.sized(docs)).collect()
    assert len(mixed) == 2 and all(r.target == 10.0 or r.target == 11.0 for r in mixed)


def test_quality_brute_force(spark, rows):
    import pyarrow as pa

    model = quality.train([(t or "", k % 2) for k, (_, t) in enumerate(rows[:40])], quality.Params(epochs=1))
    texts = [t for _, t in rows[:60]] + [None, "", " ", "a", "a a a", "x" * 3000, "é\tz\x0b \n"]
    got = model.scores(pa.array(texts, pa.string()))
    assert all(abs(g - quality.brute_force(t, model)) < 1e-9 for g, t in zip(got, texts, strict=True))


def test_quality_learns_repeated_ids_alike(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    kept = [i for i in (1, 2) if __import__("zlib").crc32(str(i).encode()) % 5]
    want = [{1: ("a", 1), 2: ("c", 0)}[i] for i in kept]
    assert quality.training_rows(docs, labels) == want == quality.training_rows(docs.orderBy("text"), labels)


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
