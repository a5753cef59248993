"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Word counts are the base measure. The rates r of documents minimise sum(size * (r * ln r - r + 1)) subject to
sum(size * r) = target for each source; the dual is convex, with one multiplier for each constraint, and its optimum
gives exponentially tilted rates r = exp(multiplier). The dual's gradient and Hessian need the sums of a source only, so they are
aggregated once (a partial sum before the shuffle) and every source's Newton iterations run in a column.

Rates become copies in three steps. Everyone takes the whole part. The rest of the rate decides about one more copy by systematic
rounding: documents of a source are dealt into size classes of an eighth of an octave, ordered by a hash, and one is taken
whenever the running sum of rests passes a whole number. What a source then misses or has too much is made good by single
copies of its documents, from large to small: a document is flipped while that brings the sum closer.
Running sums are taken within hash buckets with offsets from the buckets' sums, so that no source has to fit in one task.

Cases: a null text has size 0; a null source is a source of its own, the last; documents of size 0 take nothing; an empty table gives
no rows; repeated rows count as documents of their own; other columns pass through untouched, and those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import table, word_count, written

#: Weights by rank of the source, repeating; the ceiling on a target, times its source's size.
WEIGHTS = (5, 2, 1)
CEILING = 3.0


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, ceiling: float = CEILING, rounds: int = 60) -> DataFrame:
    """(source, source_size, target) for ``sizes`` (source, size).

    Sources rank by code point, null last. Shares of the total go by weight; a target above ``ceiling`` times its source
    stops there and what is left is shared among the others by weight, again until none is above.
    With f(c) = sum(min(ceiling * s, w * c)) the final level c solves f(c) = total, so it is read off the sorted breakpoints
    s / w: sources with the smallest breakpoints are the capped ones.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    ranked = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int") + 1))
    below = Window.orderBy(F.col("source_size") / F.col("weight"), "weight", F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy(F.lit(0))
    level = ranked.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.row_number().over(below).alias("place"),
        (F.coalesce(F.sum(F.col("source_size")).over(below.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * ceiling).alias("capped"),
        F.sum("weight").over(below.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open"),
    ).withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    # The first source by breakpoint that the level leaves at or under its ceiling sets the level for all after it.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("source_size") * ceiling, F.struct("place", "level"))
    final = level.withColumn("final", F.coalesce(F.min(fits).over(every)["level"], F.lit(float("inf"))))
    return final.select("source", "source_size", F.least(F.col("weight") * F.col("final"), F.col("source_size") * ceiling).alias("target"))


def newton_rate(source_size, target, steps: int = 40):
    """exp(m) at the minimum of ``source_size * exp(m) - target * m``: Newton steps m - gradient / Hessian from m = 0."""
    step = lambda m, _: m - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1.0 - target / (source_size * F.exp(m))))
    return F.when((source_size > 0) & (target > 0), F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step))).otherwise(F.lit(0.0))


def running(df: DataFrame, group: list[str], order: list, amount, out: str, bucket) -> DataFrame:
    """``df`` with ``out``: the sum of ``amount`` over the rows of its group up to this row, by bucket and then ``order``.

    Bucket sums are aggregated and added up per group (as many rows as buckets); only a bucket's rows meet in a task.
    """
    df = df.withColumn("__b", bucket).withColumn("__x", amount)
    sums = df.groupBy(*group, "__b").agg(F.sum("__x").alias("__s"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__b").alias("__ob"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    inside = F.sum("__x").over(Window.partitionBy(*group, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    keys = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group] + [F.col("__b") == F.col("__ob")]
    cond = keys[0]
    for k in keys[1:]:
        cond = cond & k
    return df.withColumn("__in", inside).join(offsets, cond).withColumn(out, F.col("__in") + F.col("__o")).drop("__b", "__x", "__in", "__ob", "__o", *[f"__{g}" for g in group])


def balance(docs: DataFrame, weights: tuple = WEIGHTS, ceiling: float = CEILING, key: str = "doc_id") -> DataFrame:
    """``docs`` (``key``, source, size, ...) with source_size, target, rate, copies and taken = copies * size.

    Every source's taken words differ from its target by less than about one small document; copies never exceed ``ceiling``.
    The order of documents depends on their key and size alone, so reruns agree.
    """
    docs = docs.drop("source_size", "target", "rate", "copies", "taken")
    targets = written(source_targets(docs, weights, ceiling), "targets").withColumnRenamed("source", "__source")
    targets = targets.withColumn("rate", newton_rate(F.col("source_size"), F.col("target")))
    most = int(ceiling)
    rated = docs.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    whole = F.least(F.floor(F.col("rate") + 1e-9), F.lit(most))
    rated = rated.withColumn("copies", whole).withColumn("__rest", F.when((F.col("size") > 0) & (F.col("rate") - whole > 1e-9), F.col("rate") - whole).otherwise(F.lit(0.0)))
    size_class = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * 8)).otherwise(F.lit(-1)).cast("long")
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(16))
    order = [F.col("size").desc(), F.xxhash64(F.lit(7), F.col(key)), F.col(key)]
    ranked = running(rated, ["source"], order, F.when(F.col("__rest") > 0, 1).otherwise(0).cast("long"), "__n", (F.lit(1024) - size_class) * 16 + part)
    at = lambda n: F.floor(n * F.col("__rest") + 0.5)
    ranked = ranked.withColumn("copies", F.col("copies") + F.when(F.col("__rest") > 0, at(F.col("__n")) - at(F.col("__n") - 1)).otherwise(F.lit(0)))
    ranked = written(ranked.drop("__rest", "__n"), "copies")
    short = ranked.groupBy(F.col("source").alias("__source")).agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("__short"))
    ranked = ranked.join(short, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    can = (F.col("size") > 0) & (F.col("size") <= F.abs(F.col("__short"))) & F.when(F.col("__short") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    small_first = [F.col("size"), *order[1:]]
    flipped = running(ranked, ["source"], small_first, F.when(can, F.col("size")).otherwise(F.lit(0)), "__sum", size_class * 16 + part)
    change = F.when(can & (F.col("__sum") <= F.abs(F.col("__short"))), F.signum("__short")).otherwise(F.lit(0.0))
    copies = (F.col("copies") + change).cast("long")
    return flipped.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("__sum", "__short")


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("size", word_count(F.col(text_col)))


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "size")
    return balance(written(docs, "sizes")).select("doc_id", "size", "source_size", "target", "taken")
