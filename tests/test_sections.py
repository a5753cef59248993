"""Sections of plain text, chunks that end at line breaks, values found in texts."""

import re

from pyspark.sql import functions as F

from ledgerloom.functions import answers, extract
from ledgerloom.operators import memory, resumes, sections

TEXTS = [(1, None), (2, ""), (3, "word " * 700), (4, "a\n" * 900 + "\r\nlast"), (5, "x" * 3000), (6, "one. two! " * 600 + "\n\n" + "p\n\n" * 40), (9, "z" * 2500 + ". end. " + "mid " * 300), (7, "HEADING ONE\n" + "body " * 30 + "\n2. Second\ntiny\nLabel:\n" + "more " * 40)]


def test_smart_chunks_cover_the_text(spark):
    got = sections.chunk_smart(spark.createDataFrame(TEXTS, "k int, text string"), "k").collect()
    for k, text in TEXTS:
        chunks = [r.text for r in sorted(got, key=lambda r: r.chunk) if r.k == k]
        plain = re.sub(r"\s", "", text or "")
        assert all(len(c) <= 800 for c in chunks) and (bool(chunks) == bool(plain))
        assert all(re.sub(r"\s", "", c) in plain for c in chunks) and sum(len(re.sub(r"\s", "", c)) for c in chunks) >= len(plain)


def sentence_chunks(text, size, overlap):
    out, held = [], []
    for s in filter(None, re.split(r"(?<=[.!?])\s+", (text or "").strip())):
        if len(" ".join([*held, s])) <= size:
            held.append(s)
            continue
        out += [" ".join(held)] if held else []
        if len(s) > size:
            out += [s[i : i + size] for i in range(0, len(s) - overlap, size - overlap)]
            held = []
        else:
            while held and (len(" ".join(held)) > overlap or len(" ".join([*held, s])) > size):
                held = held[1:]
            held = [*held, s]
    return out + ([" ".join(held)] if held else [])


def test_sentence_chunks(spark):
    """Chunks stay within the size, and what a chunk doesn't share with the one before gives the text again."""
    texts = [*TEXTS, (8, "Short one. " * 3 + "y" * 90 + ". " + "Next! And? " * 9), (10, "Abc def. " * 20 + "x" * 60 + ".")]
    got = sections.chunk_sentences(spark.createDataFrame(texts, "k int, text string"), "k", size=60, overlap=25).collect()
    for k, text in texts:
        chunks = [r.text for r in sorted(got, key=lambda r: r.chunk) if r.k == k]
        assert chunks == sentence_chunks(text, 60, 25) and all(0 < len(c) <= 60 for c in chunks)


def test_packed_paragraphs_rebuild_the_text(spark):
    got = sections.pack_paragraphs(spark.createDataFrame(TEXTS, "k int, text string"), "k", most=1000, least=100).collect()
    for k, text in TEXTS:
        chunks = [r.text for r in sorted(got, key=lambda r: r.chunk) if r.k == k]
        assert re.sub(r"\s", "", "".join(chunks)) == re.sub(r"\s", "", text or "") and all(len(c) <= 1102 for c in chunks)


def test_plain_sections(spark):
    got = sections.split_plaintext(spark.createDataFrame(TEXTS, "k int, text string"), "k").orderBy("k", "idx").collect()
    assert [(r.idx, r.heading) for r in got if r.k == 7] == [(0, "HEADING ONE"), (1, "Label:")] and "2. Second\ntiny" in [r.body for r in got if r.k == 7][0]
    assert not [r for r in got if r.k in (1, 2)]


def test_values_in_texts(spark):
    rows = [(" 2,5 Triệu", 2_500_000.0), ("1.200.000 VND", 1_200_000.0), ("", None), (None, None), ("free", None)]
    got = spark.createDataFrame(rows, "t string, want double").select(extract.parse_tuition(F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    c = spark.createDataFrame([("5 năm java, golang",), ("javascripts googlenet",), (None,)], "t string").select(extract.candidate_criteria(F.col("t")).alias("c")).collect()
    assert [(list(r.c.skills), r.c.min_exp) for r in c] == [(["Java", "Golang"], 5), ([], None), ([], None)]
    c = spark.createDataFrame([("C++ and c# developer 3 nam",)], "t string").select(extract.candidate_criteria(F.col("t")).alias("c")).first().c
    assert (list(c.skills), c.min_exp) == (["C#", "C++"], 3)
    n = spark.createDataFrame([("Resume\nLê Van An\nx", "a.pdf"), ("lower case words here too many", "cv-nguyen_b.pdf"), (None, "x.pdf")], "t string, f string").select(extract.guess_name(F.col("t"), F.col("f")).alias("n")).collect()
    assert [r.n for r in n] == ["Lê Van An", "Cv Nguyen B", "X"]


def test_skills_by_one_search(spark):
    """All skills alone, in a row and inside words, against a search for each; the text is gone through twice, for skills and for years."""
    texts = [*extract.SKILLS, " ".join(extract.SKILLS), "".join(extract.SKILLS), "react native", "React-native", "javascript_ java", "éai ai2 (AI)", "c++c# c#x", "ui/ux", "\U0001d41aai \U0001d41a ai", "go\u00e9 go"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    each = F.array_compact(F.array(*[F.when(F.lower("t").rlike(extract.BEFORE + re.escape(s) + extract.AFTER), F.lit(s.title())) for s in extract.SKILLS]))
    got = df.select(extract.candidate_criteria(F.col("t")).alias("c"), each.alias("each"))
    assert all(r.c.skills == r.each for r in got.collect())
    plan = df.select(extract.candidate_criteria(F.col("t")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and plan.lower().count("regexp_extract") <= 3


def test_relevant_lines_are_normalised_once(spark):
    rows = [("a\nÍELTS x\nb\nc\n \nd", "ielts 5"), ("none\n5 tr\nz\n6 vnd", "ielts"), (None, "x"), ("x", None), ("q\n" * 400 + "Pro\n" + "w\n" * 5, "pro")]
    df = spark.createDataFrame(rows, "t string, e string").select(sections.relevant_lines(F.col("t"), F.col("e"), most=1).alias("x"))
    assert [r.x for r in df.collect()] == ["ÍELTS x\nb\nc", "5 tr", "", "", "Pro\nw\nw"]
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("translate(") <= 4


def test_names_keep_their_digits(spark):
    """A line's blanks go, and no digit, whatever its place."""
    texts = ["0Lê 10\nx", "x\n1Lê 11", "x\n  1Lê 11 ", "y\nx\n2Lê 22"]
    n = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", extract.guess_name(F.col("t"), F.lit("a.pdf")).alias("n")).orderBy("i").collect()
    assert [r.n for r in n] == ["0Lê 10", "1Lê 11", "1Lê 11", "2Lê 22"]
    c = spark.createDataFrame([("so sanh  A vs 1B1 ",)], "t string").select(answers.comparison_args(F.col("t")).alias("c")).first().c
    assert list(c.subjects) == ["A", "1B1"]
    pending = spark.createDataFrame([("t", 1, "k", ["Lop 7", "1x", " IELTS 2 "])], "tenant_id string, user_id long, fact_key string, options array<string>")
    m = spark.createDataFrame([("t", 1, 2, "user", "ielts 2")], "tenant_id string, user_id long, ts long, role string, content string")
    assert [r.value_text for r in memory.resolve_pending(pending, m).collect()] == ["IELTS 2"]


def test_batches_by_position(spark):
    got = resumes.batch_inputs(spark.createDataFrame([(i * i * 7,) for i in range(137)], "i long"), "i").orderBy("i").collect()
    assert [(r.batch, r.place) for r in got] == [(k // 5, k % 5) for k in range(137)]
    assert resumes.batch_inputs(spark.createDataFrame([], "i long"), "i").count() == 0
