"""Request traces, feedback and handoff tickets: listing, searching, dashboard figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_tenants(traces: DataFrame) -> DataFrame:
    return traces.where("tenant_id is not null and tenant_id <> ''").select("tenant_id").distinct().orderBy("tenant_id")


def list_traces(traces: DataFrame, tenant=None, since=None, until=None, route=None, status=None, q=None, limit: int = 50, offset: int = 0, cut: int = 5000) -> DataFrame:
    """The latest rows that pass every filter that is given; 0 and "" mean no filter. Questions and answers are cut at ``cut``."""
    df = traces
    for name, value in (("tenant_id", tenant), ("route", route), ("status", status)):
        df = df.where(F.col(name) == value) if value else df
    df = df.where(F.col("ts") >= since) if since else df
    df = df.where(F.col("ts") <= until) if until else df
    if q:
        df = df.where(F.lower("question").contains(q.lower()) | F.lower("answer").contains(q.lower()))
    page = df.orderBy(F.col("ts").desc(), "trace_id").offset(max(0, offset)).limit(min(500, max(1, limit)))
    return page.withColumn("question", F.substring("question", 1, cut)).withColumn("answer", F.substring("answer", 1, cut))


def trace_detail(traces: DataFrame, trace_id, cut: int = 20000) -> DataFrame:
    return traces.where(F.col("trace_id") == trace_id).withColumn("question", F.substring("question", 1, cut)).withColumn("answer", F.substring("answer", 1, cut))


def list_handoffs(tickets: DataFrame, tenant=None, status=None, limit: int = 50, offset: int = 0) -> DataFrame:
    df = tickets.where(F.col("tenant_id") == tenant) if tenant else tickets
    df = df.where(F.col("status") == status) if status else df
    return df.orderBy(F.col("ts").desc(), "id").offset(max(0, offset)).limit(min(500, max(1, limit)))


def with_defaults(rows: DataFrame, defaults: dict) -> DataFrame:
    """Appended log rows: nulls of the named columns take their defaults."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def append_log(rows: DataFrame, path: str, defaults: dict, day_of: str = "ts") -> None:
    """Appends to a parquet log, one folder a day."""
    with_defaults(rows, defaults).withColumn("day", F.to_date(F.timestamp_seconds(day_of))).write.mode("append").partitionBy("day").parquet(path)


def append_traces(rows: DataFrame, path: str) -> None:
    append_log(rows, path, {"channel": "api", "status": "SUCCESS", "sources": "[]", "tool_metadata": "{}"})


def append_feedback(rows: DataFrame, path: str) -> None:
    """Ratings are 1 or -1; others are not appended."""
    append_log(rows.where("rating in (1, -1)"), path, {"comment": ""})


def append_tickets(rows: DataFrame, path: str) -> None:
    append_log(rows, path, {"status": "new", "meta": "{}"})


def parse_date(col):
    """Epoch digits or YYYY-MM-DD as epoch seconds; null for anything else."""
    s = F.trim(col)
    return F.when(s.rlike(r"^\d+$"), s.cast("long")).when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.unix_timestamp(F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))))


def satisfaction(feedback: DataFrame, traces: DataFrame) -> DataFrame:
    """(tenant_id, up, down, satisfaction): ratings by the tenant of the trace that they rate; null where nobody rated."""
    rated = feedback.select("trace_id", "rating").join(traces.select("trace_id", "tenant_id"), "trace_id")
    out = rated.groupBy("tenant_id").agg(F.count_if(F.col("rating") > 0).alias("up"), F.count_if(F.col("rating") < 0).alias("down"))
    return out.withColumn("satisfaction", F.when(F.col("up") + F.col("down") > 0, F.round(F.col("up") / (F.col("up") + F.col("down")), 3)))


def trace_metrics(traces: DataFrame, feedback: DataFrame, tickets: DataFrame) -> DataFrame:
    """One row for each tenant: requests, errors, latency figures, satisfaction and handoffs.

    Rows without a latency are not requests; tickets count by their own tenant; rates are null where the denominator is 0.
    """
    timed = traces.where("latency_ms is not null")
    main = timed.groupBy("tenant_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "ERROR").alias("errors"),
        F.round(F.avg("latency_ms"), 1).alias("mean_ms"),
        F.round(F.percentile("latency_ms", 0.5), 1).alias("p50_ms"),
        F.round(F.percentile("latency_ms", 0.95), 1).alias("p95_ms"),
    )
    handed = tickets.groupBy("tenant_id").agg(F.count("*").alias("handoffs"))
    joined = main.join(satisfaction(feedback, traces).select("tenant_id", "satisfaction"), "tenant_id", "left").join(handed, "tenant_id", "left")
    handoffs = F.coalesce("handoffs", F.lit(0))
    return joined.withColumn("handoffs", handoffs).withColumn("handoff_rate", F.when(F.col("total") > 0, F.round(handoffs / F.col("total"), 3)))


def latency_report(results: DataFrame, under: float = 3000.0) -> DataFrame:
    return results.agg(F.round(F.avg("latency_ms"), 3).alias("mean_ms"), F.round(F.sum("latency_ms"), 3).alias("total_ms"), F.count_if(F.col("latency_ms") < under).alias("fast"), F.count_if(F.col("route") == F.col("expected")).alias("right_route"))
