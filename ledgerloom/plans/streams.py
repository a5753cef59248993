"""Queries over the keyed rules in their batch form, and the windowed dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registration import query
from ..streaming import keyed
from ..tables import table


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.unix_timestamp("ts").cast("double").alias("ts"), "event_type")


#: A walk along each user's events with the admitted times of the window as a list.
RATE_SQL = """with recursive e as (select *, cast(epoch(date_trunc('second', ts)) as double) as t, row_number() over (partition by user_id order by date_trunc('second', ts), event_id) as n from events),
w(user_id, n, held, admitted, wait) as (select user_id, 0::bigint, []::double[], true, 0::bigint from (select distinct user_id from e)
  union all select w.user_id, e.n, case when len(list_filter(held, lambda x: x >= t - 86400)) < 3 then list_append(list_filter(held, lambda x: x >= t - 86400), t) else list_filter(held, lambda x: x >= t - 86400) end,
    len(list_filter(held, lambda x: x >= t - 86400)) < 3, case when len(list_filter(held, lambda x: x >= t - 86400)) < 3 then 0 else cast(trunc(greatest(1, 86400 - (t - list_filter(held, lambda x: x >= t - 86400)[1]))) as bigint) end
  from w join e on e.user_id = w.user_id and e.n = w.n + 1)
select event_id, user_id, t as ts, event_type, admitted, wait as retry_after from w join e using (user_id, n)"""
TTL_SQL = """with recursive e as (select *, cast(epoch(date_trunc('second', ts)) as double) as t, sha256(user_id || '|' || event_type) as fingerprint, row_number() over (partition by user_id, event_type order by date_trunc('second', ts), event_id) as n from events),
w(fingerprint, n, seen, again) as (select fingerprint, n, t, false from e where n = 1 union all select w.fingerprint, e.n, case when t - seen <= 21600 then seen else t end, t - seen <= 21600 from w join e on e.fingerprint = w.fingerprint and e.n = w.n + 1)
select event_id, user_id, t as ts, event_type, fingerprint, again as repeat from w join e using (fingerprint, n)"""


@query("rate_limit", RATE_SQL)
def rate_limit(spark, d):
    """Three admitted events a day for each user."""
    return keyed.in_batch(_events(spark, d), "user_id", keyed.rate_limit(3, 86400), "admitted boolean, retry_after long", ("ts", "event_id"))


@query("dedupe_turns_ttl", TTL_SQL)
def dedupe_turns_ttl(spark, d):
    """A user's event of a type repeats within six hours of the last that counted."""
    rows = _events(spark, d).withColumn("fingerprint", F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), 256))
    return keyed.in_batch(rows, "fingerprint", keyed.first_within(21600), "repeat boolean", ("ts", "event_id"))


@query("session_buffer", "with m as (select conv_id as session, turn as ts, role, coalesce(text, '') as content, case when conv_id % 5 = 0 then 't' || (turn % 2) else 't' end as tenant from conversations), r as (select *, row_number() over (partition by session order by ts desc) as n from m) select session, (select min(tenant) from m where m.session = r.session) as tenant, (select min(tenant) <> max(tenant) from m where m.session = r.session) as mixed, count(*) as n_messages, string_agg(role || ': ' || content, chr(10) order by ts) as buffer from r where n <= 4 group by session")
def session_buffer(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("ts"), "role", F.coalesce("text", F.lit("")).alias("content"), F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("t"), F.col("turn") % 2)).otherwise("t").alias("tenant"))
    return keyed.session_buffer(rows, 4)


TENANT = "case when conv_id % 5 = 0 and turn in (2, 5) then 'other' else 't' || (conv_id % 3) end"
TOLD = "case when turn = 0 then '{\"lang\": \"x' || (conv_id % 4) || '\", \"n\": 1}' when turn = 3 then '{\"n\": null, \"t\": ' || conv_id || '}' end"
SESSIONS_SQL = f"""with m as (select conv_id as session, turn as ts, role, trim(coalesce(text, '')) as content, {TENANT} as tenant from conversations), o as (select session, arg_min(tenant, ts) as owner, count(*) as n from m group by session),
k as (select m.*, owner, tenant <> owner as refused, sum(case when tenant = owner and role in ('user', 'assistant') and content <> '' then 1 else 0 end) over (partition by session order by ts desc) as back from m join o using (session))
select session, any_value(owner) as owner, count(*) filter (not refused and role in ('user', 'assistant') and content <> '' and back <= 4) as n_messages, coalesce(string_agg(role || ': ' || content, chr(10) order by ts) filter (not refused and role in ('user', 'assistant') and content <> '' and back <= 4), '') as buffer,
  case when bool_or(ts = 3 and not refused) then case when bool_or(ts = 0 and not refused) then '{{"lang": "x' || (session % 4) || '", ' else '{{' end || '"t": ' || session || '}}' when bool_or(ts = 0 and not refused) then '{{"lang": "x' || (session % 4) || '", "n": 1}}' else '{{}}' end as entity_memory,
  count(*) filter (refused) as refused from k group by session"""


@query("session_states", SESSIONS_SQL)
def session_states(spark, d):
    """Sessions with entities, some with messages of another tenant."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").cast("double").alias("ts"), F.expr(TENANT).alias("tenant"), "role", F.coalesce("text", F.lit("")).alias("content"), F.expr(TOLD).alias("entities"))
    return keyed.session_states(rows, 4)


@query("trace_metrics_stream", "select date_trunc('day', ts) as start, 't' || (user_id % 7) as tenant_id, count(*) as total, count(*) filter (event_type = 'error') as errors, round(avg(value), 3) as mean_ms from events group by 1, 2")
def trace_metrics_stream(spark, d):
    ev = table(spark, d, "events").select(F.col("ts").alias("at"), F.concat(F.lit("t"), F.col("user_id") % 7).alias("tenant_id"), F.when(F.col("event_type") == "error", "ERROR").otherwise("SUCCESS").alias("status"), F.col("value").alias("latency_ms"))
    return keyed.trace_metrics_stream(ev)
