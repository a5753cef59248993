"""The corpus pipeline: quality, line dedup, near duplicates, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's ``docs``.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, fuzzylines, mixing, ngramjoin, quality
from ledgerloom.llm.shared import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, exactly or nearly, go; so do documents that lose every line with a character in it."""
    left = fuzzylines.dedup_lines(docs)
    empty = (F.col("n_gone") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return left.where(~F.coalesce(empty, F.lit(False))).withColumn("n_chars", F.when(F.col("n_gone") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return ngramjoin.keep_one(docs, 5, 80, 100)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix with its copies; those that the mix takes no copy of stay out.

    The copies are worked out without the texts; a shuffle by id, text hash and source brings them together once. Rows that share all three are
    numbered on both sides and matched by number.
    """
    key, results = ["__row_id", "__row_text", "__row_source"], ["size", "source_size", "target", "copies", "taken"]
    keyed = docs.withColumns({"__row_id": F.struct("doc_id"), "__row_text": F.xxhash64("text"), "__row_source": F.struct("source")})
    mixed = mixing.balance(written(mixing.sized(keyed).select(*key, "doc_id", "source", "size"), "sizes")).where("copies > 0")
    mixed = written(mixed.select(*key, *results), "mix")
    rows = mixed.groupBy(*key).agg(F.first(F.struct(*results)).alias("m"), F.count("*").alias("n"))
    single = keyed.join(rows.where("n = 1").select(*key, "m.*"), key).select(*docs.columns, *results)
    many = written(rows.where("n > 1").select(*key), "repeated")
    if many.limit(1).count() == 0:
        return single
    number = lambda order: F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    left = keyed.join(many, key, "left_semi").withColumn("__n", number([F.col(c) for c in docs.columns]))
    right = mixed.join(many, key, "left_semi").withColumn("__n", number([F.col("copies").desc()]))
    return single.unionByName(left.join(right, [*key, "__n"]).select(*docs.columns, *results))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", lines_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: SQL can express neither the trained classifier nor the sketches; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
