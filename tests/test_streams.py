"""Strike counts in linear time, and a purge plan that follows changes."""

import datetime as dt
import random
import time

from veriframe.schemas import TABLES
from veriframe.session import scratch_dir
from veriframe.streaming import jobs


def strikes_log(rows):
    details = {"strike": '{"guardrailType": "verification_strike"}', "reset": '{"strikesReset": true}'}
    action = {"strike": "FRAUD_GUARDRAIL_TRIGGERED", "reset": "ADMIN_APPROVED"}
    return [(i, agent, None, action[kind], "x", details[kind], "system", None, None, moment) for i, agent, kind, moment in rows]


def streamed(spark, rows, files=1):
    path = scratch_dir(spark, "strike-rows")
    for part in range(files):
        spark.createDataFrame(rows[part::files] if files == 1 else rows[part * len(rows) // files: (part + 1) * len(rows) // files], TABLES["audit_logs"]).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(TABLES["audit_logs"]).option("maxFilesPerTrigger", 1).parquet(path)


def plain(rows, width):
    counts = {}
    for i, agent, kind, moment in rows:
        if kind == "strike":
            resets = [m for _, a, k, m in rows if a == agent and k == "reset" and m < moment]
            since = max([moment - width, *resets])
            counts[i] = sum(a == agent and k == "strike" and since <= m <= moment for _, a, k, m in rows)
    return counts


def test_strikes_over_several_batches(spark):
    rng, start = random.Random(3), dt.datetime(2026, 1, 1)
    moments = sorted(rng.sample(range(4 * 86400), 240))
    rows = [(i, rng.randrange(3), "reset" if rng.random() < 0.1 else "strike", start + dt.timedelta(seconds=s)) for i, s in enumerate(moments)]
    got = jobs.run_available(jobs.strike_counts(streamed(spark, strikes_log(rows), files=3), lateness="10 days"), "strikes-test").collect()
    assert {r.log_id: r.strikes for r in got} == plain(rows, dt.timedelta(hours=24))


def test_a_key_with_many_strikes_takes_linear_time(spark):
    """All of 40 000 strikes are inside the window: rebuilding it for each would take 10^9 steps."""
    start = dt.datetime(2026, 1, 1)
    rows = [(i, 1, "strike", start + dt.timedelta(seconds=i)) for i in range(40_000)]
    begun = time.time()
    got = jobs.run_available(jobs.strike_counts(streamed(spark, strikes_log(rows))), "strikes-hot")
    assert got.selectExpr("max(strikes) = 40000 and sum(strikes) = 40000L * 40001 / 2 as good").first().good
    assert time.time() - begun < 60


def test_many_keys_share_few_states(spark):
    """A state and a call per key made a million agents with a strike each cost hours."""
    start, agents = dt.datetime(2026, 1, 1), 3 * jobs.KEY_GROUPS
    rows = [(2 * a + again, a, "strike", start + dt.timedelta(hours=20 * again)) for again in range(2) for a in range(agents)]
    stream = jobs.strike_counts(streamed(spark, strikes_log(rows), files=2), lateness="10 days")
    running = stream.writeStream.format("memory").queryName("dealt_strikes").trigger(availableNow=True).start()
    running.awaitTermination()
    assert 0 < running.lastProgress["stateOperators"][0]["numRowsTotal"] <= jobs.KEY_GROUPS
    assert {(r.log_id, r.strikes) for r in spark.table("dealt_strikes").collect()} == {(2 * a + again, 1 + again) for a in range(agents) for again in range(2)}


def test_only_changed_agents_are_planned_again(spark):
    path = scratch_dir(spark, "plan-test")
    stored = {1: ["1/a", "1/b"], 2: ["2/a"], 3: []}
    planned = []

    def make_plan(agents):
        ids = sorted(r.agent_id for r in agents.collect())
        planned.append(ids)
        rows = [("file", i, None, p) for i in ids for p in stored.get(i, [])]
        return spark.createDataFrame(rows, "kind string, agent_id bigint, document_id bigint, path string")

    changes = lambda *ids: spark.createDataFrame([(i,) for i in ids], "agent_id bigint")
    plan = lambda: sorted((r.agent_id, r.path) for r in jobs.current_plan(spark, path).collect())
    jobs.write_plan_batch(changes(1, 2, 3, None, 1), make_plan, path, 0)
    assert plan() == [(1, "1/a"), (1, "1/b"), (2, "2/a")] and planned == [[1, 2, 3]]
    stored[1], stored[2] = ["1/c"], []
    jobs.write_plan_batch(changes(1), make_plan, path, 1)
    assert plan() == [(1, "1/c"), (2, "2/a")] and planned[-1] == [1]
    assert spark.read.schema(jobs.PLAN_SCHEMA).parquet(f"{path}/run=1").count() == 1
    jobs.write_plan_batch(changes(1), make_plan, path, 1)  # the batch again after a failure
    assert plan() == [(1, "1/c"), (2, "2/a")]
    jobs.write_plan_batch(changes(2), make_plan, path, 2)
    assert plan() == [(1, "1/c")]
    jobs.write_plan_batch(changes(1, 2, 3, None, 1), make_plan, path, 0)  # an old batch again does not win
    assert plan() == [(1, "1/c")]


def test_rate_verdict_step_needs_no_key_column_and_leaves_in_parts(monkeypatch):
    from unittest.mock import MagicMock

    import numpy as np
    import pandas as pd

    steps = []
    monkeypatch.setattr(jobs, "_stateful", lambda rows, keys, step, *rest, **more: steps.append(step))
    jobs.rate_verdicts(MagicMock(), limit=3, width_seconds=10)
    rng = np.random.default_rng(3)
    state, opened, used = None, None, 0
    for batch in range(3):
        n = 25_000
        frame = pd.DataFrame({"hit_id": rng.permutation(n) + batch * n, "ts": pd.to_datetime(batch * 20_000 + rng.integers(0, 22_000, n), unit="s").astype("datetime64[us]")})
        parts, state = steps[0](("b",), frame, state)
        parts = list(parts)
        assert max(map(len, parts)) <= jobs.OUTPUT_ROWS
        got = pd.concat(parts)
        expected = []
        for ts, hit in sorted(zip(frame["ts"], frame["hit_id"])):
            if opened is None or ts > opened + pd.Timedelta(seconds=10):
                opened, used = ts, 0
            used += 1
            expected.append((hit, ts, opened, used, used <= 3))
        assert list(got.itertuples(index=False, name=None)) == expected


def test_alerts_meet_agents_without_a_broadcast(spark):
    """A join right behind the state operator failed with a ClassCastException once the agents were too many to broadcast."""
    schema = "change_id bigint, request_id bigint, agent_id bigint, status string, changed_at timestamp"
    start, path = dt.datetime(2026, 1, 1, 0, 0, 0, 123456), scratch_dir(spark, "change-rows")
    statuses = ["review", "pending", "review", "review", "verified", "review"]
    for part in range(2):  # the second batch begins inside a review
        rows = [(6 * r + i, r, None if r == 4 else r, statuses[i], start + dt.timedelta(hours=i)) for r in range(5) for i in range(3 * part, 3 * part + 3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    agents = spark.createDataFrame([(0, "Ann", "n0"), (1, "", "n1"), (2, "Cyd", None)], "agent_id bigint, full_name string, national_id string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = jobs.run_available(jobs.review_alerts(changes, agents), "alerts-test").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    people = {0: ("Ann", "n0"), 1: ("Unknown agent", "n1"), 2: ("Cyd", None)}
    assert sorted(map(tuple, got)) == [
        (6 * r + i, r, None if r == 4 else r, *people.get(r, ("Unknown agent", None)), start + dt.timedelta(hours=i)) for r in range(5) for i in (0, 2, 5)]


def test_state_rows_of_many_keys_can_be_shuffled(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [(i, i % 3, "strike", start + dt.timedelta(minutes=i)) for i in range(30)]
    got = jobs.run_available(jobs.strike_counts(streamed(spark, strikes_log(rows))).repartition("agent_id"), "strikes-shuffled").collect()
    assert {(r.log_id, r.agent_id, r.ts, r.strikes) for r in got} == {(i, i % 3, start + dt.timedelta(minutes=i), i // 3 + 1) for i in range(30)}
