"""Streaming jobs over the audit log, request changes and passkey traffic.

Stateful steps keep a few values per key. Rows of a key inside one micro-batch are put in event order
first; the size of a micro-batch is bounded by the source's rate options (``maxFilesPerTrigger``).
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from veriframe.schemas import LOOKBACK_HOURS, MAX_FAILURES
from veriframe.session import scratch_dir

OUTPUT_ROWS = 10_000  # rows of a key that leave at a time
KEY_GROUPS = 2048  # groups that keys with few rows are dealt over


def _applied(grouped, run, output, state, timeout):
    """``applyInPandasWithState`` in append mode, its rows fit for any step that follows.

    Spark hands on the operator's Arrow rows as they are; a shuffle or sort right behind it, as of a join too large to broadcast, fails
    on them with a ClassCastException. Times therefore leave Python without a zone and get the session's in a projection, which makes rows anew.
    """
    rows = grouped.applyInPandasWithState(run, output.replace(" timestamp", " timestamp_ntz"), state, "append", timeout)
    return rows.select(*[F.col(name).cast(kind).alias(name) for name, kind in (field.split() for field in output.split(", "))])


def _stateful(rows, keys, step, output, state, lifetime=None, lateness="1 hour", keyed=True):
    """Run ``step(key, ordered rows, state values) -> (output frame, new state values)`` per key.

    With ``lifetime`` (seconds after a key's last ``ts``) the state of a quiet key is dropped once the watermark has
    passed that time. Without ``keyed`` the step's frames do without the key columns; it returns its output in parts, to which
    they are put.
    """

    def run(key, batches, held):
        if held.hasTimedOut:
            held.remove()
            return
        # a text key is the same in all rows and would weigh more than the rest
        frame = pd.concat([batch if keyed else batch.drop(columns=keys) for batch in batches], ignore_index=True)
        previous = held.get if held.exists else None
        result, values = step(key, frame, previous)
        held.update(values)
        if lifetime is not None:
            end = int(frame["ts"].max().timestamp() * 1000) + lifetime * 1000
            held.setTimeoutTimestamp(max(end, held.getCurrentWatermarkMs()) + 1)
        del frame
        if not keyed:
            yield from (part.assign(**dict(zip(keys, key))) for part in result)
        elif len(result):
            yield result

    if lifetime is not None:
        rows = rows.withWatermark("ts", lateness)
    kind = GroupStateTimeout.NoTimeout if lifetime is None else GroupStateTimeout.EventTimeTimeout
    return _applied(rows.groupBy(*keys), run, output, state, kind)


def review_alerts(changes, agents=None):
    """One alert whenever a request enters review from another status (or starts there).

    ``changes``: change_id, request_id, agent_id, status, changed_at. With ``agents`` (a static table)
    the alert carries name and national id.
    """

    def step(key, frame, previous):
        frame = frame.sort_values(["changed_at", "change_id"])
        before = frame["status"].shift(1)
        before.iloc[0] = previous[0] if previous else None
        entered = (frame["status"] == "review") & (before != "review")
        return frame.loc[entered, ["change_id", "request_id", "agent_id", "changed_at"]], (frame["status"].iloc[-1],)

    alerts = _stateful(
        changes.select("change_id", "request_id", "agent_id", "status", "changed_at"), ["request_id"], step,
        "change_id bigint, request_id bigint, agent_id bigint, changed_at timestamp", "status string",
    )
    if agents is None:
        return alerts
    people = agents.select("agent_id", F.nullif("full_name", F.lit("")).alias("_name"), "national_id")
    return alerts.join(people, "agent_id", "left").select(
        "change_id", "request_id", "agent_id", F.coalesce("_name", F.lit("Unknown agent")).alias("agent_name"), "national_id", "changed_at"
    )


def _micros(series):
    return series.astype("datetime64[us]").astype("int64")


def _dealt(rows, key, kind, columns, step, output, state, lifetime, lateness):
    """Run ``step(moments, rest, state values) -> (a number or None per row, new state values)`` per key, many keys in a group.

    A call and a state per group cost much more than a key's few rows, so keys are dealt over ``KEY_GROUPS`` groups by a hash and a
    group holds the states of its keys. ``rows``: log_id, the key (of type ``kind``), ts and ``columns``, whose lists are ``rest``. Rows
    with a number leave with it as the last column of ``output``. A key's state is dropped ``lifetime`` seconds after its last ``ts``.
    """
    names = ["log_id", key, "ts", output.rsplit(", ", 1)[1].split()[0]]
    fields = state.split(", ")

    def run(_, batches, held):
        if held.hasTimedOut:
            held.remove()
            return
        frame = pd.concat([batch.drop(columns="_group") for batch in batches], ignore_index=True).sort_values([key, "ts", "log_id"])
        moments, numbers = _micros(frame["ts"]).tolist(), []
        rest = [frame[c].tolist() for c in columns]
        own = frame[key].to_numpy()
        edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        known = {k: (last, values) for k, last, *values in zip(*held.get)} if held.exists else {}
        for start, stop in zip(edges, edges[1:]):
            name = own[start] if kind == "string" else int(own[start])
            last, values = known.get(name, (moments[stop - 1], None))
            found, values = step(moments[start:stop], [c[start:stop] for c in rest], values)
            numbers += found
            known[name] = (max(last, moments[stop - 1]), values)
        mark = held.getCurrentWatermarkMs()
        known = {k: v for k, v in known.items() if v[0] // 1000 + lifetime * 1000 >= mark}
        if known:
            held.update((list(known), [v[0] for v in known.values()], *[[v[1][i] for v in known.values()] for i in range(len(fields))]))
            held.setTimeoutTimestamp(max(max(v[0] for v in known.values()) // 1000 + lifetime * 1000, mark) + 1)
        elif held.exists:
            held.remove()
        frame[names[3]] = pd.array(numbers, dtype="Int64")
        result = frame.loc[frame[names[3]].notna(), names]
        if len(result):
            yield result

    stored = f"keys array<{kind}>, last array<bigint>, " + ", ".join(f"{n} array<{t}>" for n, t in (f.split() for f in fields))
    grouped = rows.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(KEY_GROUPS))).withWatermark("ts", lateness).groupBy("_group")
    return _applied(grouped, run, output, stored, GroupStateTimeout.EventTimeTimeout)


def failure_alerts(failures, key, limit=MAX_FAILURES, hours=LOOKBACK_HOURS, lateness="1 hour"):
    """Counted failures per key in a sliding window, one row for every failure that reaches the limit.

    ``failures``: log_id, the key column and ts, already reduced to counted rows. The state holds the
    times still inside the window.
    """
    width = hours * 3600 * 1000000

    def step(moments, _, previous):
        times = list(previous[0]) if previous else []
        counts, start = [], 0
        for moment in moments:
            times.append(moment)
            while times[start] < moment - width:
                start += 1
            n = len(times) - start
            counts.append(n if n >= limit else None)
        return counts, (times[start:],)

    return _dealt(
        failures.select("log_id", key, "ts"), key, "string", [], step, f"log_id bigint, {key} string, ts timestamp, failures bigint",
        "times array<bigint>", hours * 3600, lateness,
    )


def strike_counts(logs, hours=LOOKBACK_HOURS, lateness="1 hour"):
    """Strike count of the agent after every strike, cleared by an administrator's reset.

    Times are kept in order; the window's start only moves on and a reset is found by bisection, so a key costs as much as it has rows.
    """
    width = hours * 3600 * 1000000
    strike = (F.col("action") == "FRAUD_GUARDRAIL_TRIGGERED") & (F.get_json_object("details", "$.guardrailType") == "verification_strike")
    reset = (F.col("action") == "ADMIN_APPROVED") & (F.get_json_object("details", "$.strikesReset") == "true")
    kind = F.when(strike, F.lit("strike")).when(reset, F.lit("reset"))
    rows = logs.where(F.col("agent_id").isNotNull()).select("log_id", "agent_id", "ts", kind.alias("kind")).where(F.col("kind").isNotNull())

    def step(moments, rest, previous):
        times, last_reset = (sorted(previous[0]), previous[1]) if previous else ([], None)
        counts, start = [], 0  # times before ``start`` have left the window
        for moment, what in zip(moments, rest[0]):
            if what == "strike":
                insort(times, moment, lo=start)
                while times[start] < moment - width:
                    start += 1
                since = moment - width if last_reset is None else max(moment - width, last_reset)
                counts.append(len(times) - bisect_left(times, since, lo=start))
            else:
                last_reset = moment
                counts.append(None)
        return counts, (times[start:], last_reset)

    return _dealt(
        rows, "agent_id", "bigint", ["kind"], step, "log_id bigint, agent_id bigint, ts timestamp, strikes bigint",
        "times array<bigint>, last_reset bigint", hours * 3600, lateness,
    )


def rate_verdicts(hits, limit, width_seconds=300, lateness="1 hour"):
    """Attempt number and verdict per hit of a fixed-window bucket.

    A bucket's rows of a micro-batch are held as a few arrays of numbers and numbered window by window.
    """
    width = width_seconds * 1000000

    def step(key, frame, previous):
        moments, hits = _micros(frame["ts"]).to_numpy(), frame["hit_id"].to_numpy()
        order = np.lexsort((hits, moments))
        moments, hits = moments[order], hits[order]
        opened, used = previous if previous else (None, 0)
        opens, attempts, at = np.empty_like(moments), np.empty_like(moments), 0
        while at < len(moments):  # a turn per window
            if opened is None or moments[at] > opened + width:
                opened, used = int(moments[at]), 0
            end = int(np.searchsorted(moments, opened + width, side="right"))
            opens[at:end], attempts[at:end] = opened, np.arange(used + 1, used + 1 + end - at)
            used, at = used + end - at, end

        def parts():
            for at in range(0, len(moments), OUTPUT_ROWS):
                own = slice(at, at + OUTPUT_ROWS)
                stamp = lambda values: values[own].view("datetime64[us]")
                yield pd.DataFrame({
                    "hit_id": hits[own], "ts": stamp(moments), "opened_at": stamp(opens), "attempts": attempts[own], "allowed": attempts[own] <= limit})

        return parts(), (opened, used)

    return _stateful(
        hits.select("hit_id", "bucket", "ts"), ["bucket"], step,
        "hit_id bigint, bucket string, ts timestamp, opened_at timestamp, attempts bigint, allowed boolean", "opened bigint, used bigint",
        width_seconds, lateness, keyed=False,
    )


def challenge_uses(uses, challenges, minutes=5, lateness="10 minutes"):
    """Uses matched to their challenge while it is valid: a stream-stream join bounded in time."""
    issued = challenges.select(
        F.col("id").alias("challenge_id"), "expires_at", (F.col("expires_at") - F.make_dt_interval(mins=F.lit(minutes))).alias("issued_at")
    ).withWatermark("issued_at", lateness)
    taken = uses.select("use_id", F.col("challenge_id").alias("_challenge"), "used_at").withWatermark("used_at", lateness)
    within = F.expr(f"_challenge = challenge_id and used_at >= issued_at and used_at < issued_at + interval {minutes} minutes")
    return taken.join(issued, within).select("use_id", "challenge_id", "used_at", "expires_at")


def daily_activity(logs, lateness="1 hour"):
    """Rows per calendar day and action; in append mode a day is emitted once it can no longer change, in update mode
    after every batch that changes it."""
    return (
        logs.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "action").agg(F.count(F.lit(1)).alias("entries"))
        .select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "action", "entries")
    )


PLAN_SCHEMA = "kind string, agent_id bigint, document_id bigint, path string, batch bigint"


def write_plan_batch(changed, make_plan, path, batch_id):
    """Plan rows of the changed agents, stored under their batch number; a repeated batch replaces itself.

    An agent without plan rows leaves a row without kind, which ends what earlier batches planned.
    """
    agents = changed.where(F.col("agent_id").isNotNull()).select("agent_id").distinct()
    rows = agents.join(make_plan(agents), "agent_id", "left").select("kind", "agent_id", "document_id", "path", F.lit(batch_id).cast("bigint").alias("batch"))
    rows.write.mode("overwrite").parquet(f"{path}/run={batch_id}")


def current_plan(spark, path):
    """The stored plan: every agent's rows of its last batch."""
    rows = spark.read.schema(PLAN_SCHEMA).option("recursiveFileLookup", True).parquet(path)
    last = rows.groupBy("agent_id").agg(F.max("batch").alias("batch"))
    return rows.where("kind is not null").join(last, ["agent_id", "batch"], "left_semi").select("kind", "agent_id", "document_id", "path")


def retention_on_change(changes, make_plan, path, checkpoint, every=None):
    """Keep the purge plan up to date: a micro-batch of changes plans its agents anew, at most once per interval.

    ``make_plan(agents)`` builds the plan of a table of agent ids from the current tables. Without ``every`` the stream works
    through what is there and stops. ``current_plan`` reads the result.
    """

    def write(batch, batch_id):
        if not batch.isEmpty():
            write_plan_batch(batch, make_plan, path, batch_id)

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def run_updates(stream, keys, name):
    """Work through the available input in update mode and return the last row of every key, open ones included."""
    spark = stream.sparkSession
    out, checkpoint = scratch_dir(spark, name), scratch_dir(spark, f"{name}-state")

    def write(batch, batch_id):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/run={batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("_batch", LongType())])
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max(F.struct("_batch", *rest)).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def run_available(stream, name):
    """Work through the available input into a parquet folder and return it as a table."""
    spark = stream.sparkSession
    out, checkpoint = scratch_dir(spark, name), scratch_dir(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
