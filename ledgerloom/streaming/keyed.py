"""Rules that need the events of a key in order: rate limits, duplicate turns, sessions.

Each rule is one function over a key's state and some of its rows in order. The batch form streams sorted rows through it, so that a task holds one key's small
state and one batch of rows, and takes a key's stretches apart where the rule has forgotten what came before. The stream forms keep the
state between micro-batches: by arrival, or in event time, where rows wait until the watermark has passed them. All run the same function.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Rows of a key that one task takes in order at once; a key with more is taken apart into stretches.
MOST_ROWS = 2000
Step = Callable[[list, pd.DataFrame], tuple[list, pd.DataFrame]]


def _walked(walk: Callable, reach: float) -> Step:
    """A rule over times alone. ``walk`` takes the state, for each row whether it is the first of its key, and the times; it returns the last key's state and the new columns."""

    def step(state: list, rows: pd.DataFrame) -> tuple[list, pd.DataFrame]:
        state, added = walk(state, [False] * len(rows), rows["ts"].tolist())
        return state, rows.assign(**added)

    step.reach, step.walk = reach, walk
    return step


def rate_limit(limit: int, window: float) -> Step:
    """Only admitted events count; a rejected one is told after how many seconds to come again. A limit of 0 or less admits all."""

    def walk(admitted: list, fresh: list[bool], ts: list[float]) -> tuple[list, dict]:
        ok, wait = [], []
        for new, t in zip(fresh, ts, strict=True):
            if new:
                admitted = []
            while admitted and admitted[0] < t - window:
                admitted.pop(0)
            if limit <= 0 or len(admitted) < limit:
                if limit > 0:
                    admitted.append(float(t))
                ok.append(True)
                wait.append(0)
            else:
                ok.append(False)
                wait.append(int(max(1, window - (t - admitted[0]))))
        return admitted, {"admitted": ok, "retry_after": wait}

    return _walked(walk, window)


def first_within(ttl: float) -> Step:
    """A row is a repeat when the key's last counted row is no more than ``ttl`` old; repeats don't renew it."""

    def walk(seen: list, fresh: list[bool], ts: list[float]) -> tuple[list, dict]:
        again, last = [], seen[0] if seen else None
        for new, t in zip(fresh, ts, strict=True):
            repeat = not new and last is not None and t - last <= ttl
            if not repeat:
                last = float(t)
            again.append(repeat)
        return ([] if last is None else [last]), {"repeat": again}

    return _walked(walk, ttl)


def session_step(n: int = 36) -> Step:
    """Keeps a session's last ``n`` messages and its entities. The first message's tenant owns the session; another tenant's messages are refused and change nothing.

    Messages have (ts, tenant, role, content, entities as a JSON object or null). Only users' and assistants' messages that aren't blank go into the buffer; the last
    value told for an entity stays, a null takes it away. Each row tells what the session holds after it.
    """

    def step(state: list, rows: pd.DataFrame) -> tuple[list, pd.DataFrame]:
        owner, held, known = state or (None, [], {})
        ok, counts, buffers, entities = [], [], [], []
        for tenant, role, content, told in zip(rows["tenant"], rows["role"], rows["content"], rows["entities"], strict=True):
            owner = tenant if owner is None else owner
            if accepted := tenant == owner:
                known = {k: v for k, v in (known | json.loads(told or "{}")).items() if v is not None}
                if role in ("user", "assistant") and (content or "").strip():
                    held = [*held, f"{role}: {content.strip()}"][-n:] if n > 0 else []
            ok.append(accepted)
            counts.append(len(held))
            buffers.append("\n".join(held))
            entities.append(json.dumps(known, sort_keys=True, ensure_ascii=False))
        return [owner, held, known], rows.assign(accepted=ok, owner=owner, n_messages=counts, buffer=buffers, entity_memory=entities)

    step.reach = math.inf
    return step


SESSION = "accepted boolean, owner string, n_messages long, buffer string, entity_memory string"


def _schema(df: DataFrame, added: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + added


def _stretches(df: DataFrame, key: str, reach: float) -> DataFrame:
    """``df`` with ``__stretch``: events of a key belong to one stretch while no whole span of ``reach`` seconds between them is without events. What a rule
    remembers never reaches over such a span, so stretches are independent. Only the occupied spans of a key are put in order, not its events. Keys of up to
    ``MOST_ROWS`` rows are one stretch."""
    whole = df.withColumn("__stretch", F.lit(0).cast("long"))
    if not 0 < reach < math.inf:
        return whole
    large = df.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > MOST_ROWS).select(F.col(key).alias("__large"))
    if not large.limit(1).count():
        return whole
    is_large = F.col(key).eqNullSafe(F.col("__large"))
    whole = whole.join(large, is_large, "left_anti")
    spans = df.join(large, is_large, "left_semi").withColumn("__span", F.floor(F.col("ts") / reach))
    order = Window.partitionBy(key).orderBy("__span")
    taken = spans.groupBy(key, "__span").agg(F.count("*").alias("__n")).withColumn("__new", (F.col("__span") - F.lag("__span").over(order) > 1).cast("int"))
    named = taken.select(F.col(key).alias("__key"), F.col("__span").alias("__at"), F.coalesce(F.sum("__new").over(order), F.lit(0)).alias("__stretch"))
    return whole.unionByName(spans.join(named, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__span") == F.col("__at"))).drop("__key", "__at", "__span"))


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; null is a value, and so is NaN."""
    column = column.cast(pa.string()) if pa.types.is_floating(column.type) else column
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return other | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


def in_batch(df: DataFrame, key: str, step: Step, added: str, order: tuple = ("ts",)) -> DataFrame:
    """``df`` (key, ts as a number, ...) with the columns that the rule adds.

    Rows are sorted by key, stretch and order and streamed through the rule; a key without pauses longer than the rule's reach is one stretch, in one task. A null key is a key.
    """
    names = df.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, []
        for rows in batches:
            marks = rows[[key, "__stretch"]].astype(object).where(rows[[key, "__stretch"]].notna(), None)
            group = [*zip(marks[key], marks["__stretch"], strict=True)]
            cuts = [i for i in range(len(group)) if i == 0 or group[i] != group[i - 1]] + [len(group)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                state = state if group[a] == last else []
                state, out = step(state, rows.iloc[a:b][names])
                last = group[a]
                yield out

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch at once, whatever the number of its keys."""
        last, state = None, []
        for rows in batches:
            if not rows.num_rows:
                continue
            keys = [rows.column(key), rows.column("__stretch")]
            fresh = np.concatenate([[last is None or _changes(pa.concat_arrays([last[0], keys[0].slice(0, 1)]))[0] or last[1] != keys[1][0].as_py()], _changes(keys[0]) | _changes(keys[1])])
            state, columns = step.walk(state, fresh.tolist(), rows.column("ts").to_numpy(zero_copy_only=False).tolist())
            last = keys[0].slice(len(keys[0]) - 1), keys[1][-1].as_py()
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), *map(pa.array, columns.values())], [*names, *columns])

    rows = _stretches(df, key, getattr(step, "reach", math.inf))
    rows = rows.repartition(key, "__stretch").sortWithinPartitions(key, "__stretch", *order)
    return rows.mapInArrow(walked, _schema(df, added)) if hasattr(step, "walk") else rows.mapInPandas(fold, _schema(df, added))


def in_event_time(df: DataFrame, key: str, step: Step, added: str, late: str = "1 hour", order: tuple = ("ts",), keep_sec: float | None = None) -> DataFrame:
    """The rule over a stream in the order of ``ts`` (seconds), however rows arrive: a row waits in its key's state until the watermark has passed it and comes out
    then, so that a replay gives the rows of the batch form. Times are above 0; rows later than ``late`` are dropped. A key's state goes ``keep_sec`` seconds after its last
    row, the rule's reach where none is given, and stays where that has no end."""
    names = df.columns
    keep = getattr(step, "reach", math.inf) if keep_sec is None else keep_sec

    def update(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last, waiting = state.get if state.exists else ("[]", 0.0, b"")
        frames = [pa.ipc.open_stream(waiting).read_pandas()] if waiting else []
        mark = state.getCurrentWatermarkMs() / 1000
        frames += [f[f["ts"] >= mark][names] for f in batches] if not state.hasTimedOut else []
        frames = [f for f in frames if len(f)]
        rows = pd.concat(frames) if frames else pd.DataFrame(columns=names)
        rows = rows.sort_values(list(order), kind="stable")
        rows = rows.assign(**{c: rows[c].where(rows[c].notna(), None) for c in names if rows[c].dtype == object})
        due = rows["ts"].astype(float) < mark
        if due.any():
            told, out = step(json.loads(held), rows[due])
            held, last = json.dumps(told), float(rows[due]["ts"].iloc[-1])
            yield out
        rest = rows[~due]
        if len(rest) == 0 and mark > last + keep:
            state.remove()
            return
        sink = pa.BufferOutputStream()
        if len(rest):
            batch = pa.Table.from_pandas(rest, preserve_index=False)
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_table(batch)
        state.update((held, last, sink.getvalue().to_pybytes()))
        wake = float(rest["ts"].iloc[0]) if len(rest) else last + keep
        if wake < math.inf:
            state.setTimeoutTimestamp(int(max(wake, mark) * 1000) + 2)

    at = df.withColumn("__at", F.timestamp_seconds("ts")).withWatermark("__at", late)
    return at.groupBy(key).applyInPandasWithState(update, _schema(df, added), "held string, last double, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)


def in_stream(df: DataFrame, key: str, step: Step, added: str, keep_sec: float, order: tuple = ("ts",)) -> DataFrame:
    """The rule over a stream: a key's state goes ``keep_sec`` seconds after its last micro-batch."""
    names = [f.name for f in df.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + added

    def update(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches))[names].sort_values(list(order), kind="stable")
        held, out = step(held, rows)
        state.update((held,))
        state.setTimeoutDuration(int(keep_sec * 1000))
        yield out

    return df.groupBy(key).applyInPandasWithState(update, schema, "held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def session_states(messages: DataFrame, n: int = 36) -> DataFrame:
    """(session, owner, n_messages, buffer, entity_memory, refused) at the end of each session, by ``session_step``."""
    told = in_batch(messages, "session", session_step(n), SESSION, ("ts", "tenant"))
    last = F.max_by(F.struct("owner", "n_messages", "buffer", "entity_memory"), F.struct("ts", "tenant"))
    return told.groupBy("session").agg(last.alias("s"), F.count_if(~F.col("accepted")).alias("refused")).select("session", "s.*", "refused")


def session_buffer(messages: DataFrame, n: int = 36) -> DataFrame:
    """(session, tenant, mixed, n_messages, buffer): the last ``n`` messages of each session as one text; ``mixed`` marks sessions with several tenants."""
    last = F.row_number().over(Window.partitionBy("session").orderBy(F.col("ts").desc()))
    rows = messages.withColumn("__n", last)
    kept = rows.where(F.col("__n") <= n).groupBy("session").agg(F.count("*").alias("n_messages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "role", "content"))), lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n").alias("buffer"))
    tenants = messages.groupBy("session").agg(F.min("tenant").alias("tenant"), (F.min("tenant") != F.max("tenant")).alias("mixed"))
    return kept.join(tenants, "session")


def trace_metrics_stream(traces: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, tenant_id, total, errors, mean_ms): dashboard figures by tumbling window; rows later than the watermark are dropped in a stream."""
    traces = traces.withColumn("at", F.col("at").cast("timestamp")) if traces.isStreaming else traces  # watermarks want a time zone
    w = F.window("at", window)
    figures = traces.withWatermark("at", late).groupBy(w.alias("w"), "tenant_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ERROR").alias("errors"), F.round(F.avg("latency_ms"), 3).alias("mean_ms"))
    return figures.select(F.col("w.start").alias("start"), "tenant_id", "total", "errors", "mean_ms")


def ingest_stream(spark, folder: str, schema: str, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a stream of new JSON files under ``folder``; each micro-batch goes through ``write``; files already done are skipped."""
    rows = spark.readStream.schema(schema).json(folder)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
