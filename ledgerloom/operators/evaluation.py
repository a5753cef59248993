"""Evaluation sets: cleaning, ids, quote alignment, retrieval and answer scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.textnorm import normalize_ws, tokenize


def coerce_qa(df: DataFrame) -> DataFrame:
    """Rows with question, answer and a keypoint; a missing type is "factual"; blank keypoints go."""
    points = F.filter(F.coalesce("keypoints", F.array().cast("array<string>")), lambda k: F.trim(k) != "")
    some = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    return df.withColumn("keypoints", points).withColumn("query_type", F.when(some("query_type"), F.col("query_type")).otherwise("factual")).where(some("question") & some("answer") & (F.size("keypoints") > 0))


def add_query_ids(df: DataFrame, tenant: str, order: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(tenant).orderBy(order))
    return df.withColumn("query_id", F.concat(F.col(tenant), F.lit("-"), F.lpad(n.cast("string"), 4, "0")))


def align_quotes(quotes: DataFrame, nodes: DataFrame, least: int = 1) -> DataFrame:
    """(quote_id, node, exact): the first node that holds the quote with white space collapsed, as written or else in any case.

    Candidates are the nodes with the quote's rarest word, from document frequencies, so quotes and nodes meet on words and not each with each.
    """
    words = lambda c: F.array_distinct(tokenize(c))
    n = nodes.select("node", normalize_ws(F.col("text")).alias("hay"))
    q = quotes.select("quote_id", normalize_ws(F.col("quote")).alias("needle")).where("needle <> ''")
    terms = n.select("node", F.explode(words(F.col("hay"))).alias("term"))
    asked = q.select("quote_id", F.posexplode(words(F.col("needle"))).alias("pos", "term"))
    inner = asked.withColumn("last", F.max("pos").over(Window.partitionBy("quote_id"))).where("(pos > 0 and pos < last) or last < 2")  # the words at the ends may be cut
    df = terms.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rare = inner.join(df, "term").groupBy("quote_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    hits = rare.join(terms, "term").join(n, "node").join(q, "quote_id").where(F.lower("hay").contains(F.lower("needle")))
    exact = F.col("hay").contains(F.col("needle"))
    return hits.groupBy("quote_id").agg(F.min(F.struct((~exact).cast("int").alias("c"), F.col("node"))).alias("m")).select("quote_id", F.col("m.node").alias("node"), (F.col("m.c") == 0).alias("exact"))


def align_by_overlap(answers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(answer_id, node, shared): the node with most distinct words in common; ties go to the first."""
    words = lambda df, i: df.select(i, F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
    shared = words(answers, "answer_id").join(words(nodes, "node"), "term").groupBy("answer_id", "node").agg(F.count("*").alias("shared"))
    return shared.groupBy("answer_id").agg(F.max(F.struct("shared", (-F.col("node")).alias("n"))).alias("m")).select("answer_id", (-F.col("m.n")).alias("node"), F.col("m.shared").alias("shared"))


def score_retrieval(items: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, precision, recall) of retrieved against wanted ids: over all items and for each value of each column of ``by``."""
    hit = F.size(F.array_intersect("retrieved", "wanted"))
    rows = items.withColumn("p", hit / F.greatest(F.size(F.array_distinct("retrieved")), F.lit(1))).withColumn("r", hit / F.greatest(F.size(F.array_distinct("wanted")), F.lit(1)))
    return rows.groupingSets([[], *[[c] for c in by]], *by).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("precision"), F.round(F.avg("r"), 6).alias("recall"))


def pass_rates(results: DataFrame, by: list[str], passed: str = "passed") -> DataFrame:
    """(by..., n, rate): the share that passed, overall and for each value of each column."""
    return results.groupingSets([[], *[[c] for c in by]], *by).agg(F.count("*").alias("n"), F.round(F.avg(F.col(passed).cast("double")), 6).alias("rate"))


def keypoint_rates(judgements: DataFrame, by: str) -> DataFrame:
    """(by, completeness, hallucination, irrelevance): shares of keypoints by verdict, as means over queries."""
    share = lambda v: F.avg((F.col("verdict") == v).cast("double"))
    one = judgements.groupBy(by, "query_id").agg(share("covered").alias("c"), share("contradicted").alias("h"), share("missing").alias("i"))
    return one.groupBy(by).agg(*[F.round(F.avg(a), 6).alias(b) for a, b in (("c", "completeness"), ("h", "hallucination"), ("i", "irrelevance"))])


def judge_means(df: DataFrame, by: str) -> DataFrame:
    """Means of a judge's JSON scores; what can't be read counts as 0."""
    told = df.withColumn("j", F.from_json("verdict", "correctness double, relevance double"))
    return told.groupBy(by).agg(*[F.round(F.avg(F.coalesce(F.col(f"j.{c}"), F.lit(0.0))), 6).alias(c) for c in ("correctness", "relevance")])


def check_cases(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, passed, reason) of computed against expected amounts; null stands for an error that was to come."""
    both = expected.join(results, "case_id", "left")
    same = F.col("expected").eqNullSafe(F.col("final"))
    reason = F.when(same, "ok").when(F.col("final").isNull(), "no amount").when(F.col("expected").isNull(), "amount instead of an error").otherwise("other amount")
    return both.select("case_id", same.alias("passed"), reason.alias("reason"))


def rouge_l(items: DataFrame, key: str, answer: str = "answer", truth: str = "truth") -> DataFrame:
    """(key, rouge_l): F-measure of the longest common subsequence of words; a helper counts it in numpy rows."""

    def score(a, b):
        import numpy as np
        import pandas as pd

        def one(x, y):
            x, y = list(x), list(y)
            if not len(x) or not len(y):
                return 0.0
            ids = {w: i for i, w in enumerate(dict.fromkeys(y))}
            yy = np.array([ids[w] for w in y])
            row = np.zeros(len(y) + 1, np.int64)
            for w in x:
                # A row of the table: diagonal steps where the word is met, then the running maximum.
                step = np.where(yy == ids.get(w, -1), row[:-1] + 1, 0)
                row[1:] = np.maximum.accumulate(np.maximum(step, row[1:]))
            n = int(row[-1])
            p, r = n / len(x), n / len(y)
            return round(2 * p * r / (p + r), 6) if n else 0.0

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    udf = F.pandas_udf(score, "double")
    return items.select(key, udf(tokenize(F.col(answer)), tokenize(F.col(truth))).alias("rouge_l"))


def build_eval_items(qas: DataFrame, matched: DataFrame, fallback: DataFrame, predictions: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """The evaluation items and the log of retrieved contexts, one row each for every question.

    ``qas`` (tenant_id, pos, query_type, question, answer, keypoints, domain, language), ``matched`` (tenant_id, pos, quote, node, text) with the node of each quote,
    ``fallback`` (tenant_id, pos, node, text) for questions none of whose quotes has one, ``predictions`` (tenant_id, pos, content, contexts, sources, route). The
    first two quotes count, a node once; questions are numbered in each tenant by ``pos``; the first ``k`` contexts are kept.
    """
    key = ["tenant_id", "pos"]
    ids = add_query_ids(qas, "tenant_id", "pos")
    nodes = matched.where((F.col("quote") < 2) & F.col("node").isNotNull()).groupBy(*key, "node").agg(F.min("quote").alias("quote"), F.min_by("text", "quote").alias("text"))
    own = nodes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("quote", "node", "text"))).alias("refs"))
    other = fallback.groupBy(*key).agg(F.array(F.min(F.struct(F.lit(0).alias("quote"), "node", "text"))).alias("other"))
    rows = ids.join(own, key, "left").join(other, key, "left").join(predictions, key, "left").withColumn("refs", F.coalesce("refs", "other"))
    none = F.array().cast("array<string>")
    texts = F.filter(F.transform("refs", lambda r: F.coalesce(r["text"], F.lit(""))), lambda t: F.trim(t) != "")
    truth = F.struct(F.transform("refs", lambda r: r["node"]).alias("doc_ids"), F.col("answer").alias("content"), F.coalesce(texts, none).alias("references"), "keypoints")
    top = F.slice(F.coalesce("contexts", none), 1, k)
    said = F.coalesce("content", F.lit(""))
    items = rows.select("domain", "language", "tenant_id", F.struct("query_id", "query_type", F.col("question").alias("content")).alias("query"), truth.alias("ground_truth"), F.struct(said.alias("content"), top.alias("references")).alias("prediction"))
    log = rows.select("tenant_id", "query_id", "query_type", "question", said.alias("answer"), top.alias("contexts_top_k"), F.coalesce("sources", none).alias("sources"), "route")
    return items, log
