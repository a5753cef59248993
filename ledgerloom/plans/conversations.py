"""Queries over conversation memory: conversations are sessions, events stand for facts and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory as ops
from ..registration import query
from ..tables import table

NOW = 1_706_000_000
MSG = "m as (select conv_id as session, turn as ts, role, coalesce(text, '') as content from conversations)"
SAID = "s as (select *, row_number() over (partition by session order by ts desc) as n from m where role in ('user', 'assistant') and trim(content) <> '')"
#: Facts: key is the event's type, value a digit of its props, confidence its value over 500, at most 1.
FACTS = f"""
ev as (select event_id, cast(floor(epoch(ts)) as bigint) as ts, 't' || (user_id % 7) as tenant_id, user_id, event_type as fact_key, 'v' || (event_id % 4) as value_text, round(least(1.0, value / 500), 3) as confidence from events),
f as (select tenant_id, user_id, fact_key, value_text, confidence, ts as last_seen, case when event_id % 3 = 0 then ts + 86400 end as expires_at, cast(case when event_id % 10 = 0 then 1 else 0 end as int) as is_deleted from ev)
"""
UP = """
live as (select tenant_id, user_id, fact_key, value_text, confidence, last_seen, expires_at, row_number() over (partition by tenant_id, user_id, fact_key, value_text order by last_seen desc) as n from f where is_deleted = 0),
up as (select tenant_id, user_id, fact_key, value_text, confidence, last_seen, expires_at, 0 as is_deleted from live where n = 1 union all select tenant_id, user_id, fact_key, value_text, confidence, last_seen, expires_at, 1 from f where is_deleted = 1)
"""


def _messages(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("ts"), "role", F.coalesce("text", F.lit("")).alias("content"))


def _facts(spark, d):
    ev = table(spark, d, "events").withColumn("ts", F.unix_timestamp("ts"))
    e = F.col("event_id")
    return ev.select(
        F.concat(F.lit("t"), F.col("user_id") % 7).alias("tenant_id"), "user_id", F.col("event_type").alias("fact_key"), F.concat(F.lit("v"), e % 4).alias("value_text"), F.round(F.least(F.lit(1.0), F.col("value") / 500), 3).alias("confidence"),
        F.col("ts").alias("last_seen"), F.when(e % 3 == 0, F.col("ts") + 86400).alias("expires_at"), F.when(e % 10 == 0, 1).otherwise(0).alias("is_deleted"), e.alias("event_id"),
    )


def _merged(spark, d):
    f = _facts(spark, d)
    base, late = f.where("event_id % 2 = 0").drop("event_id"), f.where("event_id % 2 = 1").drop("event_id", "is_deleted")
    return ops.upsert_facts(base, late)


@query("session_id", "select conv_id, turn, case when starts_with(role, 'us') then 't' || conv_id || ':' || role else 't' || conv_id || ':api:' || role end as session from conversations")
def session_id(spark, d):
    tenant = F.concat(F.lit("t"), "conv_id")
    user = F.when(F.col("role").startswith("us"), F.concat(tenant, F.lit(":"), "role")).otherwise(F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", ops.session_id(tenant, F.lit("api"), user).alias("session"))


@query("recent_messages", f"with {MSG}, {SAID} select session, ts, role, content from s where n <= 4")
def recent_messages(spark, d):
    return ops.recent_messages(_messages(spark, d), 4)


@query("rollup_split", f"with {MSG} select session, ts, role, content, case when sum(length(content) // 4) over (partition by session) > 300 and row_number() over (partition by session order by ts desc) > 3 then 'summarise' else 'keep' end as part from m")
def rollup_split(spark, d):
    return ops.rollup_split(_messages(spark, d), 300, 3)


@query("turn_fingerprint", f"with {MSG}, {SAID} select session, sha256(session || chr(10) || string_agg(role || '|' || content, chr(10) order by ts)) as fingerprint from s where n <= 2 group by session")
def turn_fingerprint(spark, d):
    return ops.turn_fingerprint(_messages(spark, d))


PROFILES = """
p as (select 't' || (user_id % 7) as tenant_id, user_id, event_id as ts, case when event_type = 'view' then props end as profile, case event_type when 'click' then 'granted' when 'error' then 'revoked' end as consent, case when event_id % 4 = 0 then cast(floor(epoch(ts)) as bigint) end as ttl_until from events),
pr as (select tenant_id, user_id, arg_max(profile, ts) filter (profile is not null) as profile, arg_max(consent, ts) filter (consent is not null) as consent, arg_max(ttl_until, ts) filter (ttl_until is not null) as ttl_until from p group by all)
"""


def _profiles(spark, d):
    ev = table(spark, d, "events")
    kind = F.col("event_type")
    rows = ev.select(F.concat(F.lit("t"), F.col("user_id") % 7).alias("tenant_id"), "user_id", F.col("event_id").alias("ts"), F.when(kind == "view", F.col("props")).alias("profile"), F.when(kind == "click", "granted").when(kind == "error", "revoked").alias("consent"), F.when(F.col("event_id") % 4 == 0, F.unix_timestamp("ts")).alias("ttl_until"))
    return ops.upsert_profiles(rows.where("ts % 3 = 0"), rows.where("ts % 3 <> 0"))


@query("upsert_profiles", f"with {PROFILES} select * from pr")
def upsert_profiles(spark, d):
    return _profiles(spark, d)


@query("live_profiles", f"with {PROFILES} select * from pr where ttl_until is null or ttl_until > {NOW}")
def live_profiles(spark, d):
    return ops.live_profiles(_profiles(spark, d), NOW)


@query("consent_filter", f"with {FACTS}, {PROFILES} select tenant_id, user_id, count(*) as n from f where not exists (select 1 from pr where pr.tenant_id = f.tenant_id and pr.user_id = f.user_id and consent = 'revoked') group by all")
def consent_filter(spark, d):
    return ops.consent_filter(_facts(spark, d), _profiles(spark, d)).groupBy("tenant_id", "user_id").agg(F.count("*").alias("n"))


@query("new_facts", f"with {FACTS}, c as (select *, row_number() over (partition by tenant_id, user_id, fact_key, value_text order by ts) as n from ev where event_id % 2 = 1 and not exists (select 1 from ev x where x.event_id % 6 = 0 and x.tenant_id = ev.tenant_id and x.user_id = ev.user_id and x.fact_key = ev.fact_key and x.value_text = ev.value_text)) select tenant_id, user_id, fact_key, value_text, ts from c where n = 1")
def new_facts(spark, d):
    f = _facts(spark, d).withColumnRenamed("last_seen", "ts")
    return ops.new_facts(f.where("event_id % 2 = 1").withColumn("fact_key", F.upper("fact_key")), f.where("event_id % 6 = 0")).select("tenant_id", "user_id", F.lower("fact_key").alias("fact_key"), "value_text", "ts")


#: Half of the events are stored facts, the other half changes, of which none is deleted.
BASE = FACTS.replace("case when event_id % 10 = 0 then 1 else 0 end", "case when event_id % 10 = 0 and event_id % 2 = 0 then 1 else 0 end")


@query("upsert_facts", f"with {BASE}, {UP} select * from up")
def upsert_facts(spark, d):
    return _merged(spark, d)


@query("active_facts", f"with {BASE}, {UP}, a as (select *, row_number() over (partition by tenant_id, user_id order by last_seen desc, fact_key, value_text) as n from up where is_deleted = 0 and (expires_at is null or expires_at > {NOW})) select * exclude (n) from a where n <= 5")
def active_facts(spark, d):
    return ops.active_facts(_merged(spark, d), NOW, 5)


@query("soft_delete_facts", f"with {FACTS} select tenant_id, count(*) as n, cast(sum(case when user_id % 2 = 0 and fact_key = 'click' then 1 else is_deleted end) as bigint) as deleted from f group by tenant_id")
def soft_delete_facts(spark, d):
    f = _facts(spark, d)
    keys = f.where("user_id % 2 = 0 and fact_key = 'click'").select("tenant_id", "user_id", "fact_key")
    return ops.soft_delete_facts(f, keys).groupBy("tenant_id").agg(F.count("*").alias("n"), F.sum("is_deleted").alias("deleted"))


@query("list_events", "with r as (select event_id, user_id, cast(row_number() over (partition by user_id order by ts desc, event_id) as int) as rank from events where event_type = 'click') select * from r where rank <= 10")
def list_events(spark, d):
    return ops.list_events(table(spark, d, "events"), 10, "click").select("event_id", "user_id", "rank")


CONFLICTS = f"""{FACTS}, b as (select tenant_id, user_id, fact_key, value_text, max(confidence) as c from f where is_deleted = 0 group by all having max(confidence) > 0),
r as (select *, row_number() over w as r, lead(value_text) over w as runner_up, lead(c) over w as second from b window w as (partition by tenant_id, user_id, fact_key order by c desc, value_text)),
co as (select tenant_id, user_id, fact_key, value_text as winner, runner_up, case when round(c - second, 9) >= 0.15 then 'resolved' else 'pending' end as state from r where r = 1 and runner_up is not null)"""


@query("fact_conflicts", f"with {CONFLICTS} select * from co")
def fact_conflicts(spark, d):
    return ops.fact_conflicts(_facts(spark, d))


@query("pending_questions", f"with {CONFLICTS} select tenant_id, user_id, fact_key, 'Which ' || fact_key || ' is right: ' || winner || ' or ' || runner_up || '?' as question from co where state = 'pending'")
def pending_questions(spark, d):
    return ops.pending_questions(ops.fact_conflicts(_facts(spark, d)))


@query("memory_run_counts", f"with {CONFLICTS} select tenant_id, count(*) filter (state = 'resolved') as resolved, count(*) filter (state = 'pending') as pending from co group by tenant_id")
def memory_run_counts(spark, d):
    return ops.memory_run_counts(ops.fact_conflicts(_facts(spark, d)))


@query("verify_candidates", f"with {BASE}, {UP}, v as (select tenant_id, user_id, fact_key, value_text, cast(row_number() over (partition by tenant_id, user_id order by confidence, fact_key, value_text) as int) as rank from up where confidence < 0.8 and is_deleted = 0) select * from v where rank <= 8")
def verify_candidates(spark, d):
    return ops.verify_candidates(_merged(spark, d)).select("tenant_id", "user_id", "fact_key", "value_text", "rank")


@query("apply_decisions", f"with {BASE}, {UP}, l as (select * from up where is_deleted = 0) select tenant_id, user_id, fact_key, value_text, case when value_text = 'v1' then greatest(confidence, 0.9) else confidence end as confidence, cast(case when value_text = 'v2' then 1 else 0 end as int) as is_deleted from l")
def apply_decisions(spark, d):
    live = _merged(spark, d).where("is_deleted = 0")
    decided = live.select(*ops.FACT, F.when(F.col("value_text") == "v1", "confirm").when(F.col("value_text") == "v2", "reject").otherwise("keep").alias("decision"), F.lit(0.9).alias("confidence"))
    return ops.apply_decisions(live, decided).select(*ops.FACT, "confidence", "is_deleted")


@query("longterm_context", f"with {BASE}, {UP}, a as (select *, row_number() over (partition by tenant_id, user_id order by last_seen desc, fact_key, value_text) as n from up where is_deleted = 0 and (expires_at is null or expires_at > {NOW})), k as (select *, row_number() over (partition by tenant_id, user_id order by last_seen desc, fact_key, value_text) as r from a where n <= 32 and confidence >= 0.1) select tenant_id, user_id, string_agg(fact_key || ': ' || value_text, chr(10) order by r) as block from k where r <= 8 group by all")
def longterm_context(spark, d):
    return ops.longterm_context(_merged(spark, d), NOW, least=0.1)
