"""Round trips: what the sinks write, read again by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import traces
from ..registration import query
from ..sources import nodes
from ..tables import scratch, table


@query("nodes_round_trip", "select 'n' || doc_id as id, coalesce(text, '') as text, source as tenant_id, lang as branch_id, lang as language from documents")
def nodes_round_trip(spark, d):
    """All documents as nodes by tenant and branch, one tenant written twice, and read again."""
    path = scratch(spark, "nodes")
    rows = table(spark, d, "documents").select(F.concat(F.lit("n"), "doc_id").alias("id"), "text", F.to_json(F.struct(F.col("lang").alias("language"))).alias("metadata"), F.col("source").alias("tenant_id"), F.col("lang").alias("branch_id"))
    nodes.write_nodes(rows, path)
    nodes.write_nodes(rows.where("tenant_id = 'src1'"), path)
    got = spark.read.schema(f"{nodes.NODE}, tenant_id string, branch_id string").json(path)
    whole = nodes.read_nodes(spark, path).select("id", F.col("text").alias("t"), F.col("metadata")["language"].alias("language"))
    return got.select("id", "tenant_id", "branch_id").join(whole, "id").select("id", F.col("t").alias("text"), "tenant_id", "branch_id", "language")


@query("logs_round_trip", "select 'trace' as log, event_id as id, case when event_id % 2 = 0 then 'web' else 'api' end as told from events union all select 'feedback', event_id, case when event_id % 3 = 0 then 'fine' else '' end from events where event_id % 4 < 2 union all select 'ticket', event_id, case when event_id % 5 = 0 then 'closed' else 'new' end from events")
def logs_round_trip(spark, d):
    """Events as traces, feedback and tickets, appended in two parts with their defaults, and read again."""
    i = F.col("event_id")
    ev = table(spark, d, "events").select("event_id", F.unix_timestamp("ts").alias("ts"), F.when(i % 2 == 0, "web").alias("channel"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("sources"), F.lit(None).cast("string").alias("tool_metadata"))
    rated = ev.select("event_id", "ts", F.when(i % 4 == 0, 1).when(i % 4 == 1, -1).otherwise(0).alias("rating"), F.when(i % 3 == 0, "fine").alias("comment"))
    asked = ev.select("event_id", "ts", F.when(i % 5 == 0, "closed").alias("status"), F.lit(None).cast("string").alias("meta"))
    out = None
    for name, rows, append, told in (("trace", ev, traces.append_traces, "channel"), ("feedback", rated, traces.append_feedback, "comment"), ("ticket", asked, traces.append_tickets, "status")):
        path = scratch(spark, name)
        append(rows.where("event_id % 2 = 0"), path)
        append(rows.where("event_id % 2 = 1"), path)
        got = spark.read.parquet(path).select(F.lit(name).alias("log"), F.col("event_id").alias("id"), F.col(told).alias("told"))
        out = got if out is None else out.unionByName(got)
    return out
