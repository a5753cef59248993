"""What several operators need: written intermediate tables, word patterns, connected groups."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str = "step", free: bool = False) -> DataFrame:
    """``df`` as a parquet table in the shared folder, read again: it cuts lineage and survives a lost executor.

    ``free`` has the driver collect its garbage afterwards, on which Spark deletes the shuffle files of the finished job.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/ledgerloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if free:
        for _ in range(2):
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of keys (some tens of bytes each), and no more, that a join may broadcast.
MOST_BROADCAST = 500_000


def small(keys: DataFrame) -> DataFrame:
    """``keys``, read from a written table, for a broadcast where they are counted to be few; as they are otherwise, so that both sides are shuffled."""
    return F.broadcast(keys) if keys.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else keys


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def word_count(col):
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def connected(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over the undirected ``edges``, for each id in an edge.

    Each round points every node to its smallest neighbour (or itself), follows the pointers to their roots by doubling, and shrinks the
    edges to those between different roots. At most half of the nodes are roots, so log n rounds are enough; a star needs one. Pointers
    and edges stay distributed and are written to the shared folder. Null ends are ignored; an edge from a node to itself says nothing.
    """
    low, high = F.least(a, b).alias("u"), F.greatest(a, b).alias("v")
    left = written(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(low, high).distinct(), "edges")
    labels = None
    for _ in range(max_rounds):
        if labels is not None and left.limit(1).count() == 0:
            return labels
        ends = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        roots = _roots(written(ends.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("near")).select("id", F.least("id", "near").alias("component")), "pointers"))
        if labels is None:
            labels = roots
        else:
            further = roots.select(F.col("id").alias("component"), F.col("component").alias("root"))
            labels = written(labels.join(further, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "labels")
        root = lambda end, name: roots.select(F.col("id").alias(end), F.col("component").alias(name))
        met = left.join(root("u", "x"), "u").join(root("v", "y"), "v").where("x <> y")
        left = written(met.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _roots(pointers: DataFrame) -> DataFrame:
    """(id, component) with every pointer followed to its end; pointers never point to a larger id. Those at their end rest."""
    done, active = None, pointers
    while True:
        known = active if done is None else done.unionByName(active)
        step = active.join(known.select(F.col("id").alias("component"), F.col("component").alias("far")), "component").select("id", "far", (F.col("far") == F.col("component")).alias("end"))
        step = written(step, "pointers")
        ended = step.where("end").select("id", F.col("far").alias("component"))
        done = ended if done is None else done.unionByName(ended)
        active = step.where("not end").select("id", F.col("far").alias("component"))
        if active.limit(1).count() == 0:
            return done
