"""Conversation memory: sessions, profiles, facts with upserts and conflicts, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import mentioned_facts
from ..functions.textnorm import strip_accents
from .courses import extract_phone

FACT = ("tenant_id", "user_id", "fact_key", "value_text")


def session_id(tenant, channel, user):
    """tenant:channel:user; a user that already begins with the tenant keeps its name."""
    whole = F.concat_ws(":", tenant, channel, user)
    return F.when(user.startswith(F.concat(tenant, F.lit(":"))), user).otherwise(whole)


def recent_messages(messages: DataFrame, n: int = 12) -> DataFrame:
    """The last ``n`` user and assistant messages of each session that aren't blank."""
    said = messages.where(F.col("role").isin("user", "assistant") & (F.trim("content") != ""))
    last = F.row_number().over(Window.partitionBy("session").orderBy(F.col("ts").desc()))
    return said.withColumn("__n", last).where(F.col("__n") <= n).drop("__n")


def rollup_split(messages: DataFrame, most_tokens: int = 1000, keep: int = 12) -> DataFrame:
    """Messages with ``part``: "summarise" for the older ones of sessions over ``most_tokens`` (a token is four characters), else "keep"."""
    w = Window.partitionBy("session")
    total = F.sum(F.floor(F.length("content") / 4)).over(w)
    last = F.row_number().over(w.orderBy(F.col("ts").desc()))
    return messages.withColumn("part", F.when((total > most_tokens) & (last > keep), "summarise").otherwise("keep"))


def _last_given(col: str):
    """The value of the latest row in which ``col`` isn't null."""
    return F.max_by(col, F.when(F.col(col).isNotNull(), F.col("ts"))).alias(col)


def upsert_profiles(base: DataFrame, changes: DataFrame) -> DataFrame:
    """One row for each (tenant_id, user_id): the latest profile, consent and ttl that were given."""
    return base.unionByName(changes).groupBy("tenant_id", "user_id").agg(_last_given("profile"), _last_given("consent"), _last_given("ttl_until"))


def live_profiles(profiles: DataFrame, now: int) -> DataFrame:
    return profiles.where(F.col("ttl_until").isNull() | (F.col("ttl_until") > now))


def new_facts(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose (user, lower key, normalised value) isn't known, the first of each by ``ts``."""
    sign = lambda df: df.withColumn("__k", F.lower("fact_key")).withColumn("__v", F.lower(F.trim(F.regexp_replace("value_text", r"\s+", " "))))
    keys = ["tenant_id", "user_id", "__k", "__v"]
    fresh = sign(candidates).join(sign(existing).select(*keys), keys, "left_anti")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "fact_key", "value_text"))
    return fresh.withColumn("__n", first).where("__n = 1").drop("__n", "__k", "__v")


def upsert_facts(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Facts after ``changes``: a fact that is not deleted and comes again is refreshed; other changes are inserted; deleted facts stay as they are."""
    dead = base.where("is_deleted = 1")
    live = base.where("is_deleted = 0").unionByName(changes.withColumn("is_deleted", F.lit(0)))
    merged = live.groupBy(*FACT).agg(F.max_by("confidence", "last_seen").alias("confidence"), F.max("last_seen").alias("last_seen"), F.max_by("expires_at", "last_seen").alias("expires_at"), F.lit(0).alias("is_deleted"))
    return dead.select(*merged.columns).unionByName(merged)


def active_facts(facts: DataFrame, now: int, limit: int = 200) -> DataFrame:
    live = facts.where((F.col("is_deleted") == 0) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    last = F.row_number().over(Window.partitionBy("tenant_id", "user_id").orderBy(F.col("last_seen").desc(), "fact_key", "value_text"))
    return live.withColumn("__n", last).where(F.col("__n") <= limit).drop("__n")


def soft_delete_facts(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """``facts`` with those marked deleted whose (tenant_id, user_id, fact_key) is in ``keys``."""
    hit = keys.select("tenant_id", "user_id", "fact_key").distinct().withColumn("__hit", F.lit(True))
    return facts.join(hit, ["tenant_id", "user_id", "fact_key"], "left").withColumn("is_deleted", F.when(F.col("__hit"), 1).otherwise(F.col("is_deleted"))).drop("__hit")


def list_events(events: DataFrame, limit: int = 200, kind: str | None = None) -> DataFrame:
    rows = events.where(F.col("event_type") == kind) if kind else events
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), "event_id"))
    return rows.withColumn("rank", last).where(F.col("rank") <= limit)


def turn_fingerprint(messages: DataFrame, n: int = 2) -> DataFrame:
    """(session, fingerprint): a digest of the session and its last ``n`` messages in order."""
    last = recent_messages(messages, n)
    turns = F.transform(F.array_sort(F.collect_list(F.struct("ts", "role", "content"))), lambda m: F.concat_ws("|", m["role"], m["content"]))
    return last.groupBy("session").agg(F.sha2(F.concat_ws("\n", F.col("session").cast("string"), F.array_join(turns, "\n")), 256).alias("fingerprint"))


def fact_conflicts(facts: DataFrame, margin: float = 0.15) -> DataFrame:
    """(tenant_id, user_id, fact_key, winner, runner_up, state): keys with several values by their best confidence.

    A lead of ``margin`` or more settles it ("resolved"); else both are kept for a question ("pending").
    """
    best = facts.where("is_deleted = 0").groupBy(*FACT).agg(F.max("confidence").alias("c")).where("c > 0")
    w = Window.partitionBy(*FACT[:3]).orderBy(F.col("c").desc(), "value_text")
    ranked = best.select("*", F.row_number().over(w).alias("r"), F.lead("value_text").over(w).alias("runner_up"), F.lead("c").over(w).alias("second"))
    top = ranked.where("r = 1 and runner_up is not null")
    return top.select(*FACT[:3], F.col("value_text").alias("winner"), "runner_up", F.when(F.round(F.col("c") - F.col("second"), 9) >= margin, "resolved").otherwise("pending").alias("state"))


def pending_questions(conflicts: DataFrame) -> DataFrame:
    ask = F.concat(F.lit("Which "), "fact_key", F.lit(" is right: "), "winner", F.lit(" or "), "runner_up", F.lit("?"))
    return conflicts.where("state = 'pending'").select(*FACT[:3], ask.alias("question"))


def verify_candidates(facts: DataFrame, below: float = 0.8, most: int = 8) -> DataFrame:
    """The first ``most`` uncertain facts of each user, least certain first."""
    w = Window.partitionBy("tenant_id", "user_id").orderBy("confidence", "fact_key", "value_text")
    return facts.where((F.col("confidence") < below) & (F.col("is_deleted") == 0)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def apply_decisions(facts: DataFrame, decisions: DataFrame, sure: float = 0.8) -> DataFrame:
    """confirm with ``sure`` or more raises the confidence, reject deletes, anything else keeps."""
    told = facts.join(decisions.select(*FACT, "decision", F.col("confidence").alias("__c")), list(FACT), "left")
    up = (F.col("decision") == "confirm") & (F.col("__c") >= sure)
    return told.withColumn("confidence", F.when(up, F.greatest("confidence", "__c")).otherwise(F.col("confidence"))).withColumn("is_deleted", F.when(F.col("decision") == "reject", 1).otherwise(F.col("is_deleted"))).drop("decision", "__c")


def longterm_context(facts: DataFrame, now: int, recent: int = 32, most: int = 8, least: float = 0.7) -> DataFrame:
    """(tenant_id, user_id, block): "key: value" lines of the first ``most`` sure facts among the ``recent`` latest active ones."""
    live = active_facts(facts, now, recent).where(F.col("confidence").isNull() | (F.col("confidence") >= least))
    w = Window.partitionBy("tenant_id", "user_id").orderBy(F.col("last_seen").desc(), "fact_key", "value_text")
    rows = live.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    line = F.concat_ws(": ", "fact_key", "value_text")
    return rows.groupBy("tenant_id", "user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("block"))


def consent_filter(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    revoked = profiles.where("consent = 'revoked'").select("tenant_id", "user_id").distinct()
    return rows.join(revoked, ["tenant_id", "user_id"], "left_anti")


def memory_run_counts(conflicts: DataFrame) -> DataFrame:
    return conflicts.groupBy("tenant_id").agg(F.count_if(F.col("state") == "resolved").alias("resolved"), F.count_if(F.col("state") == "pending").alias("pending"))


def extract_facts(messages: DataFrame, tools: DataFrame, sure: float = 0.85, unsure: float = 0.4) -> DataFrame:
    """(tenant_id, user_id, fact_key, value_text, confidence, source, ttl_days): what tools and users told, a fact's first source staying.

    ``messages`` (tenant_id, user_id, ts, role, content), ``tools`` (tenant_id, user_id, ts, route, metadata as JSON). Tools come before messages, earlier
    rows before later ones; facts are the same where key and value are, apart from accents, case and blanks at the ends.
    """
    arg = lambda *names: F.trim(F.coalesce(*[F.nullif(F.get_json_object("metadata", f"$.extracted_args.{n}"), F.lit("")) for n in names]))
    has_args = F.coalesce(F.get_json_object("metadata", "$.extracted_args"), F.lit("{}")).rlike(r'^\{\s*"')
    quote = F.when(F.lower(F.trim("route")) == "tuition_calculator", _number("metadata", "computed_final_vnd"))
    fact = lambda name, value, days: F.struct(F.lit(name).alias("fact_key"), value.alias("value_text"), F.lit(days).alias("ttl_days"))
    by_tool = F.array(
        fact("contact_phone", arg("phone"), 365),
        fact("course_interest", arg("course_name", "course", "program", "course_interest"), 180),
        fact("target_level", arg("target_level", "target_band", "target_score", "goal"), 365),
        fact("latest_quote_vnd", F.concat(quote.cast("string"), F.lit(" VND")), 30),
    )
    scope = ["tenant_id", "user_id", "ts"]
    told = lambda df, facts, conf, source, order: df.select(*scope, F.posexplode(facts).alias("pos", "f")).select(*scope, "pos", "f.*", F.lit(conf).alias("confidence"), F.lit(source).alias("source"), F.lit(order).alias("__o"))
    every = told(tools.where(has_args), by_tool, sure, "heuristic_tool", 0).unionByName(told(messages.where(F.lower("role") == "user"), mentioned_facts(F.col("content")), unsure, "heuristic_regex", 1))
    every = every.where("value_text <> ''").withColumn("__v", F.trim(F.lower(strip_accents(F.col("value_text"), map_d=True))))
    first = F.row_number().over(Window.partitionBy("tenant_id", "user_id", "fact_key", "__v").orderBy("__o", "ts", "pos", "value_text"))
    return every.withColumn("__n", first).where("__n = 1").select(*FACT, "confidence", "source", "ttl_days")


def _number(col: str, name: str):
    """A number of a JSON object, without its fraction; null for anything else."""
    raw = F.get_json_object(col, f"$.{name}")
    is_number = ~F.coalesce(F.schema_of_variant(F.variant_get(F.try_parse_json(F.col(col)), f"$.{name}", "variant")), F.lit("STRING")).isin("STRING", "BOOLEAN", "VOID")
    return F.when(is_number, raw.try_cast("double").cast("long"))


def entity_patch(user_text, metadata: str):
    """map of what a turn tells of its session: a phone number, the computed total, the discount's scope where it is a text."""
    scope = F.get_json_object(metadata, "$.discount_scope")
    is_text = F.schema_of_variant(F.variant_get(F.try_parse_json(F.col(metadata)), "$.discount_scope", "variant")) == "STRING"
    pairs = F.array(
        F.struct(F.lit("phone").alias("k"), extract_phone(user_text).alias("v")),
        F.struct(F.lit("computed_total_payable_vnd").alias("k"), _number(metadata, "computed_final_vnd").cast("string").alias("v")),
        F.struct(F.lit("discount_scope").alias("k"), F.when(is_text, scope).alias("v")),
    )
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def resolve_pending(pending: DataFrame, messages: DataFrame, sure: float = 0.95) -> DataFrame:
    """(tenant_id, user_id, fact_key, value_text, confidence): pending conflicts (with ``options``) that the user's latest message settles.

    It names an option where the option's text stands in it, apart from case and blanks, or the option's last word does as it is; exactly one different option must be named.
    """
    said = messages.where((F.lower("role") == "user") & (F.trim("content") != ""))
    last = said.groupBy("tenant_id", "user_id").agg(F.max_by(F.trim("content"), F.struct("ts", "content")).alias("said"))
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    named = lambda o: plain(F.col("said")).contains(plain(o)) | F.col("said").contains(F.element_at(F.split(F.trim(o), r"\s+"), -1))
    options = F.array_distinct(F.filter(F.transform("options", lambda o: F.trim(o)), lambda o: (o != "") & named(o)))
    told = pending.join(last, ["tenant_id", "user_id"]).withColumn("__named", options).where(F.size("__named") == 1)
    return told.select("tenant_id", "user_id", "fact_key", F.get("__named", F.lit(0)).alias("value_text"), F.lit(sure).alias("confidence"))


def append_events(events: DataFrame, path: str) -> None:
    """Appends events (ts in seconds, tenant_id, user_id, event_type, ...) to the log under ``path`` by day; a missing text is empty, a missing payload an empty object."""
    from .traces import append_log

    append_log(events, path, {"content_text": "", "payload": "{}"})
