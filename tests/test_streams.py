"""Keyed rules in event time: a shuffled replay, cut into micro-batches and restarted, gives the rows of the batch form."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import keyed

SCHEMA = "ts double, key string, id long"
RULES = [(keyed.rate_limit(3, 300), "admitted boolean, retry_after long"), (keyed.first_within(200), "repeat boolean")]


def events(n=400):
    """A third of them of one key."""
    r = random.Random(4)
    return [{"ts": float(1 + r.randrange(20000)), "key": r.choice(["hot", f"u{r.randrange(4)}", f"u{r.randrange(4)}"]), "id": i} for i in range(n)]


def feed(folder, rows, schema_of_end, first=0, size=80):
    """Rows a little out of order, ``size`` a file; then one far ahead, so that the watermark passes all others."""
    folder.mkdir(exist_ok=True)
    r = random.Random(9)
    mixed = sorted(rows, key=lambda x: x["ts"] + r.random() * 100)
    parts = [mixed[i : i + size] for i in range(0, len(mixed), size)] + ([[schema_of_end]] if schema_of_end else [])
    for k, part in enumerate(parts, first):
        path = folder / f"{k:04}.json"
        path.write_text("\n".join(map(json.dumps, part)))
        os.utime(path, (k + 1, k + 1))


def run(spark, folder, out, check, schema, make):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    q = make(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
    assert q.awaitTermination(240)


@pytest.mark.parametrize(("step", "added"), RULES)
def test_event_time_replay_equals_batch(spark, tmp_path, step, added):
    rows = events()
    make = lambda s: keyed.in_event_time(s, "key", step, added, "10 minutes", ("ts", "id"))
    early = sorted(rows, key=lambda x: x["ts"])
    feed(tmp_path / "in", early[:200], None)
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "check", SCHEMA, make)
    feed(tmp_path / "in", early[200:], {"ts": 90000.0, "key": "end", "id": -1}, first=100)
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "check", SCHEMA, make)  # a restart from the checkpoint
    got = spark.read.parquet(str(tmp_path / "out")).where("id >= 0")
    want = keyed.in_batch(spark.createDataFrame([(x["ts"], x["key"], x["id"]) for x in rows], SCHEMA), "key", step, added, ("ts", "id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    make = lambda s: keyed.in_event_time(s, "key", keyed.first_within(10), "repeat boolean", "5 seconds", ("ts", "id"))
    for k, part in enumerate([[(100.0, 1), (103.0, 2)], [(500.0, 3)], [(101.0, 4), (498.0, 5)], [(900.0, 6)], [(901.0, 7)]]):
        feed(tmp_path / "in", [{"ts": t, "key": "a", "id": i} for t, i in part], None, first=k)
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "check", SCHEMA, make)
    got = {r.id: r.repeat for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: False, 2: True, 5: False, 3: True}  # 4 came after its time, 6 and 7 still wait


MESSAGES = "ts double, session string, tenant string, role string, content string, entities string"


def messages():
    r = random.Random(1)
    rows = []
    for i in range(120):
        told = r.choice([None, None, '{"phone": "09"}', '{"phone": null, "n": %d}' % i])
        rows.append({"ts": float(i * 10 + 1), "session": f"s{r.randrange(5)}", "tenant": r.choice(["a"] * 9 + ["b"]), "role": r.choice(["user", "assistant", "system"]), "content": r.choice(["hello", " ", "ok %d" % i]), "entities": told})
    return rows


def test_session_stream_equals_batch(spark, tmp_path):
    rows = messages()
    make = lambda s: keyed.in_event_time(s, "session", keyed.session_step(3), keyed.SESSION, "10 minutes", ("ts", "tenant"))
    feed(tmp_path / "in", rows[:60], None, size=25)
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "check", MESSAGES, make)
    feed(tmp_path / "in", rows[60:], {"ts": 90000.0, "session": "end", "tenant": "x", "role": "user", "content": "", "entities": None}, first=100, size=25)
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "check", MESSAGES, make)
    df = spark.createDataFrame([tuple(x[k.split()[0]] for k in MESSAGES.split(", ")) for x in rows], MESSAGES)
    want = keyed.in_batch(df, "session", keyed.session_step(3), keyed.SESSION, ("ts", "tenant"))
    got = spark.read.parquet(str(tmp_path / "out")).where("session <> 'end'")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_sessions_by_a_plain_loop(spark):
    df = spark.createDataFrame([tuple(x[k.split()[0]] for k in MESSAGES.split(", ")) for x in messages()], MESSAGES)
    want = {}
    for m in messages():
        s = want.setdefault(m["session"], {"owner": m["tenant"], "held": [], "known": {}, "refused": 0})
        if m["tenant"] != s["owner"]:
            s["refused"] += 1
            continue
        for k, v in json.loads(m["entities"] or "{}").items():
            s["known"].pop(k, None)
            s["known"] |= {k: v} if v is not None else {}
        if m["role"] != "system" and m["content"].strip():
            s["held"] = [*s["held"], f"{m['role']}: {m['content']}"][-3:]
    got = {r.session: (r.owner, r.buffer, json.loads(r.entity_memory), r.refused) for r in keyed.session_states(df, 3).collect()}
    assert got == {k: (s["owner"], "\n".join(s["held"]), s["known"], s["refused"]) for k, s in want.items()}


def test_stretches_and_null_keys(spark):
    """Independent stretches of a hot key go to several groups, and nothing changes; a null key is a key; an empty table stays empty."""
    rows = [(float(t), "hot", t) for t in range(0, 100000, 40)] + [(float(t * 5000), None, -t) for t in range(1, 40)]
    df = spark.createDataFrame(rows, SCHEMA)
    step = keyed.rate_limit(1, 20)
    assert keyed._stretches(df, "key", 20).select("__stretch").distinct().count() > 1000
    got = keyed.in_batch(df, "key", step, "admitted boolean, retry_after long", ("ts", "id"))
    assert got.count() == len(rows) and got.where("admitted").count() == len(rows)
    assert keyed.in_batch(df.where("false"), "key", step, "admitted boolean, retry_after long").count() == 0
    assert keyed.in_batch(df.where(F.col("key").isNull()), "key", step, "admitted boolean, retry_after long").count() == 39


@pytest.mark.parametrize("kind", ["string", "double"])
def test_many_small_keys_in_whole_batches(spark, kind):
    """Keys below ``MOST_ROWS`` rows need no stretches and no join; null and NaN keys, batches that end within a key, against a plain loop."""
    r = random.Random(3)
    keys = [None, *([float("nan"), 1.5, 2.0] if kind == "double" else ["", "a"]), *[(float(k + 9) if kind == "double" else f"k{k}") for k in range(60)]]
    rows = [(float(r.randrange(5000)), r.choice(keys), i) for i in range(900)]
    df = spark.createDataFrame(rows, f"ts double, key {kind}, id long")
    last, want = {}, {}
    for t, k, i in sorted(rows, key=lambda x: (x[0], x[2])):
        want[i] = repr(k) in last and t - last[repr(k)] <= 200
        last[repr(k)] = last[repr(k)] if want[i] else t
    told = keyed.in_batch(df, "key", keyed.first_within(200), "repeat boolean", ("ts", "id"))
    assert "Join" not in told._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {x.id: x.repeat for x in told.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
