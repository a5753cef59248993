"""Queries over traces, feedback and tickets, which the events table stands for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import traces as ops
from ..registration import query
from ..tables import table

TRACES = """
tr as (select event_id as trace_id, cast(floor(epoch(ts)) as bigint) as ts, 't' || (user_id % 7) as tenant_id, event_type as route,
  case when event_type = 'error' then 'ERROR' else 'SUCCESS' end as status, case when event_id % 11 > 0 then value end as latency_ms, props as question, 'answer ' || event_type as answer from events),
fb as (select event_id as id, event_id - 1 as trace_id, case when event_type = 'purchase' then 1 else -1 end as rating from events where event_type in ('purchase', 'error')),
ti as (select event_id as id, cast(floor(epoch(ts)) as bigint) as ts, 't' || (user_id % 5) as tenant_id, case when event_id % 2 = 0 then 'new' else 'closed' end as status from events where event_type = 'signup')
"""


def _tables(spark, d):
    ev = table(spark, d, "events").withColumn("ts", F.unix_timestamp("ts"))
    t = ev.select(
        F.col("event_id").alias("trace_id"), "ts", F.concat(F.lit("t"), F.col("user_id") % 7).alias("tenant_id"), F.col("event_type").alias("route"), F.when(F.col("event_type") == "error", "ERROR").otherwise("SUCCESS").alias("status"),
        F.when(F.col("event_id") % 11 > 0, F.col("value")).alias("latency_ms"), F.col("props").alias("question"), F.concat(F.lit("answer "), "event_type").alias("answer"),
    )
    fb = ev.where(F.col("event_type").isin("purchase", "error")).select(F.col("event_id").alias("id"), (F.col("event_id") - 1).alias("trace_id"), F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("rating"))
    ti = ev.where("event_type = 'signup'").select(F.col("event_id").alias("id"), "ts", F.concat(F.lit("t"), F.col("user_id") % 5).alias("tenant_id"), F.when(F.col("event_id") % 2 == 0, "new").otherwise("closed").alias("status"))
    return t, fb, ti


@query("list_tenants", f"with {TRACES} select distinct tenant_id from tr")
def list_tenants(spark, d):
    return ops.list_tenants(_tables(spark, d)[0])


@query("list_traces", f"with {TRACES} select trace_id, ts, tenant_id, route, status, latency_ms, left(question, 5000) as question, left(answer, 5000) as answer from tr where tenant_id = 't3' and status = 'SUCCESS' and contains(lower(answer), 'click') order by ts desc, trace_id limit 40 offset 10")
def list_traces(spark, d):
    """A page of 40 rows: the limit is the operator's own."""
    return ops.list_traces(_tables(spark, d)[0], tenant="t3", status="SUCCESS", q="CLICK", limit=40, offset=10)


@query("trace_detail", f"with {TRACES} select trace_id, ts, tenant_id, route, status, latency_ms, left(question, 20000) as question, left(answer, 20000) as answer from tr where trace_id = (select max(trace_id) from tr) // 2")
def trace_detail(spark, d):
    t = _tables(spark, d)[0]
    middle = t.agg(F.floor(F.max("trace_id") / 2).alias("m"))
    return ops.trace_detail(t.crossJoin(F.broadcast(middle)), F.col("m")).drop("m")


@query("list_handoffs", f"with {TRACES} select * from ti where status = 'new' order by ts desc, id limit 50")
def list_handoffs(spark, d):
    """A page of 50 rows: the limit is the operator's own."""
    return ops.list_handoffs(_tables(spark, d)[2], status="new")


@query("parse_date", "select o_orderkey, case when o_orderkey % 3 = 0 then cast(epoch(o_orderdate) as bigint) when o_orderkey % 3 = 1 then cast(epoch(date_trunc('day', o_orderdate)) as bigint) end as at from orders")
def parse_date(spark, d):
    k = F.col("o_orderkey") % 3
    s = F.when(k == 0, F.unix_timestamp("o_orderdate").cast("string")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("no date")
    return table(spark, d, "orders").select("o_orderkey", ops.parse_date(s).alias("at"))


SAT = "sa as (select tenant_id, count(*) filter (rating > 0) as up, count(*) filter (rating < 0) as down from fb join tr using (trace_id) group by tenant_id)"


@query("satisfaction", f"with {TRACES}, {SAT} select *, case when up + down > 0 then round(up / (up + down), 3) end as satisfaction from sa")
def satisfaction(spark, d):
    t, fb, _ = _tables(spark, d)
    return ops.satisfaction(fb, t)


@query("trace_metrics", f"""with {TRACES}, {SAT},
m as (select tenant_id, count(*) as total, count(*) filter (status = 'ERROR') as errors, round(avg(latency_ms), 1) as mean_ms, round(quantile_cont(latency_ms, 0.5), 1) as p50_ms, round(quantile_cont(latency_ms, 0.95), 1) as p95_ms from tr where latency_ms is not null group by tenant_id),
h as (select tenant_id, count(*) as handoffs from ti group by tenant_id)
select m.*, case when up + down > 0 then round(up / (up + down), 3) end as satisfaction, coalesce(handoffs, 0) as handoffs, round(coalesce(handoffs, 0) / total, 3) as handoff_rate from m left join sa using (tenant_id) left join h using (tenant_id)""")
def trace_metrics(spark, d):
    return ops.trace_metrics(*_tables(spark, d))


@query("percentile_interp", "select event_type, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.9), 6) as p90 from events group by event_type")
def percentile_interp(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(*[F.round(F.percentile("value", p), 6).alias(f"p{int(p * 100)}") for p in (0.25, 0.9)])


@query("latency_report", f"with {TRACES} select round(avg(latency_ms), 3) as mean_ms, round(sum(latency_ms), 3) as total_ms, count(*) filter (latency_ms < 50) as fast, count(*) filter (route = 'click') as right_route from tr")
def latency_report(spark, d):
    return ops.latency_report(_tables(spark, d)[0].withColumn("expected", F.lit("click")), 50.0)


@query("append_traces", f"with {TRACES} select tenant_id, count(*) as n, count(*) filter (latency_ms is null) as untimed, 'api' as channel, min(status) as least_status from tr group by tenant_id")
def append_traces(spark, d):
    rows = _tables(spark, d)[0].withColumn("channel", F.lit(None).cast("string"))
    told = ops.with_defaults(rows, {"channel": "api", "status": "SUCCESS", "question": "", "answer": ""})
    return told.groupBy("tenant_id").agg(F.count("*").alias("n"), F.count_if(F.col("latency_ms").isNull()).alias("untimed"), F.min("channel").alias("channel"), F.min("status").alias("least_status"))
