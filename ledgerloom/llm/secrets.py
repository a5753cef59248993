"""Incremental secret scan over content-addressed blobs, in DataFrame functions only.

``versions`` is a history: rows of (path, version, text). Every text is addressed by its SHA-256. A ledger of (blob, rules)
pairs tells what was scanned before; only blobs that the ledger lacks for the present rules version are
read by the rules, once each, and findings are joined back to every path and version that holds the blob.

Cases: a null text is the empty blob; repeated rows share a blob and each keeps its findings; rows with null keys keep
theirs too; empty tables give empty results; other columns of ``versions`` are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlap; a match counts if group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules in their order, then the rules that this scan adds.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
)
RULES = BASE + ADDED
RULES_VERSION = "1"
FINDING = "array<struct<start:int,rank:int,kind:string,stop:int>>"


def blob_of(text):
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def spans_of(text, rule: Rule, rank: int):
    """Start and end (code points) of the rule's matches, from the pieces between matches and the matches' lengths."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)
    rows = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(kept, F.length).alias("held"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(FINDING).alias("found"))

    def walk(state, x):
        a = state["at"] + x["gap"]
        b = a + F.coalesce(x["size"], F.lit(0))
        hit = F.struct(a.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), b.alias("stop"))
        return F.struct(b.alias("at"), F.when(x["held"] >= rule.least, F.concat(state["found"], F.array(hit))).otherwise(state["found"]).alias("found"))

    return F.when(text.rlike(rule.pattern), F.aggregate(rows, start, walk)["found"]).otherwise(F.array().cast(FINDING))


def scan_blobs(blobs: DataFrame, text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """(blob, findings) of the blobs that a rule matches: spans of all rules by start, then by the rule's place in the list."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = F.lit(False)
    for r in rules:
        some = some | text.rlike(r.pattern)
    return blobs.where(some).select("blob", F.array_sort(F.concat(*[spans_of(text, r, k) for k, r in enumerate(rules)])).alias("findings"))


def unseen_blobs(versions: DataFrame, ledger: DataFrame | None = None, rules_version: str = RULES_VERSION, text_col: str = "text") -> DataFrame:
    """(blob, text): each blob that the ledger does not hold for ``rules_version``, once.

    Copies of a text meet by digest with a partial aggregate before the shuffle, so a text that fills a third
    of the rows travels once for each task.
    """
    texts = versions.select(blob_of(F.col(text_col)).alias("blob"), F.col(text_col).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        return texts
    return texts.join(ledger.where(F.col("rules_version") == rules_version).select("blob"), "blob", "left_anti")


def scan_history(versions: DataFrame, ledger: DataFrame | None = None, past: DataFrame | None = None, rules: tuple = RULES, rules_version: str = RULES_VERSION, path_col: str = "path", version_col: str = "version", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: what each path and version holds, the findings made now, the ledger rows to append.

    (``path_col``, ``version_col``, blob, findings) for every row of ``versions``; (blob, rules_version, findings) of the blobs
    scanned now in which a rule matched; (blob, rules_version) of all blobs scanned now. ``past`` holds findings of
    earlier runs, as this function returned them; without it only blobs scanned now can have findings.
    """
    fresh = unseen_blobs(versions, ledger, rules_version, text_col)
    made = scan_blobs(fresh, rules=rules).select("blob", F.lit(rules_version).alias("rules_version"), "findings")
    known = made if past is None else made.unionByName(past.where(F.col("rules_version") == rules_version).select("blob", "rules_version", "findings"))
    paths = versions.select(F.col(path_col), F.col(version_col), blob_of(F.col(text_col)).alias("blob"))
    joined = paths.join(known.select("blob", "findings"), "blob", "left").withColumn("findings", F.coalesce("findings", F.array().cast(FINDING)))
    return joined.select(path_col, version_col, "blob", "findings"), made, fresh.select("blob", F.lit(rules_version).alias("rules_version"))


def joined_spans(findings):
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def op9_secret_ledger(spark, sf_dir: str) -> DataFrame:
    """The first run over ``documents``: an empty ledger, doc_id as path, one version."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("version"), "text")
    found, _, _ = scan_history(docs, path_col="doc_id")
    base = [r.kind for r in BASE]
    f = F.col("findings")
    count = lambda kind: F.size(F.filter(f, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(joined_spans(F.filter(f, lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        joined_spans(f).alias("spans"),
    )
