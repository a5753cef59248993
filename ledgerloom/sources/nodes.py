"""Reading and writing nodes, texts, entities and evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.textnorm import decode_text

NODE = "id string, node_id string, _id string, text string, metadata string, broken string"
ENTITY = "resume_id string, category string, name string, email string, phone string, skills array<string>, experience_years int, experience array<struct<company:string,role:string,duration:string>>, education array<struct<institution:string,degree:string,year:string>>, certifications array<string>, summary string"
TESTSET = "tenant_id string, question string, answer string, keypoints array<string>, query_type string"
#: Kinds of files, and limits on uploads.
TEXT_KINDS, FILE_KINDS = (".md", ".txt"), (".pdf", ".md", ".txt", ".docx", ".rtf")
UPLOAD_KINDS, MOST_FILES, MOST_BYTES = (".pdf", ".doc", ".docx", ".txt", ".md"), 10, 10 * 1024 * 1024


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, metadata): lines that aren't JSON are skipped; the id is ``id``, ``node_id`` or ``_id``; metadata that isn't a map is empty."""
    raw = spark.read.schema(NODE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    meta = F.when(F.trim("metadata").startswith("{"), F.from_json("metadata", "map<string,string>"))
    return raw.where("broken is null").select(F.coalesce("id", "node_id", "_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(meta, F.create_map().cast("map<string,string>")).alias("metadata"))


def write_nodes(df: DataFrame, path: str) -> None:
    """Nodes (tenant_id, branch_id, ...) as JSON lines by tenant and branch; only the tenants in ``df`` are overwritten."""
    df.repartition("tenant_id", "branch_id").write.partitionBy("tenant_id", "branch_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def read_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, text): files under ``folder``; only text kinds are decoded, others have a null text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rows = files.select("path", kind.alias("kind"), "content").where(F.col("kind").isin(*FILE_KINDS))
    return rows.select("path", "kind", F.when(F.col("kind").isin(*TEXT_KINDS), decode_text(F.col("content"))).alias("text"))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTITY).option("multiLine", True).json(path)


def read_testset(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Evaluation rows with tenant, question and a keypoint that isn't blank; ``grading_notes`` lists the keypoints."""
    rows = with_grading_notes(spark.read.schema(TESTSET).json(path))
    return rows.limit(limit) if limit else rows


def with_grading_notes(rows: DataFrame) -> DataFrame:
    points = F.filter(F.coalesce("keypoints", F.array().cast("array<string>")), lambda k: F.trim(k) != "")
    kept = rows.withColumn("keypoints", points).where("tenant_id is not null and trim(question) <> '' and size(keypoints) > 0")
    return kept.withColumn("grading_notes", F.array_join(F.transform("keypoints", lambda k: F.concat(F.lit("- "), F.trim(k))), "\n"))


def write_eval_items(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").json(path)


def pending_only(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def flatten_nodes_for_upload(df: DataFrame) -> DataFrame:
    """(id, document, evidence, partners): tenant:entity, evidence as JSON, partners joined."""
    return df.select(F.concat_ws(":", "tenant_id", "entity_id").alias("id"), F.col("text").alias("document"), F.to_json("evidence").alias("evidence"), F.array_join("partners", ", ").alias("partners"))


def split_good_bad(df: DataFrame, error) -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error; the latter say which."""
    told = df.withColumn("error", error)
    return told.where("error is null").drop("error"), told.where("error is not null")


def validate_uploads(files: DataFrame) -> DataFrame:
    """Files (batch, pos, name, size, text) with ``error``: too many in a batch, too large, an unknown kind, no text; else null."""
    n = F.row_number().over(Window.partitionBy("batch").orderBy("pos"))
    kind = F.lower(F.regexp_extract("name", r"(\.[^./]+)$", 1))
    why = F.when(n > MOST_FILES, "too many files").when(F.col("size") > MOST_BYTES, "too large").when(~kind.isin(*UPLOAD_KINDS), "unknown kind").when(F.trim(F.coalesce("text", F.lit(""))) == "", "no text")
    return files.withColumn("error", why)
