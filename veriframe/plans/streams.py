"""Registered queries: streams (I), run over the available input and compared with their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.bindings import REQUEST_NOW, BoundTables
from veriframe.operators import fraud, trail
from veriframe.plans.fraud import _COUNTED, _PURGE, RATE_LIMIT, RATE_SQL
from veriframe.registry import query
from veriframe.session import scratch_dir
from veriframe.streaming import jobs


def streamed(t, *names):
    """The same bound tables with the named raw tables read as streams."""
    return BoundTables(t.spark, t.sf_dir, streams=names)


@query("i1_review_alerts", """
select c.change_id, c.request_id, c.agent_id, coalesce(a.full_name, 'Unknown agent') agent_name, a.national_id, c.changed_at
from (select *, lag(status) over (partition by request_id order by changed_at, change_id) prev from request_changes) c
     left join agents a on a.agent_id = c.agent_id where c.status = 'review' and c.prev is distinct from 'review'""")
def _(t):
    return jobs.run_available(jobs.review_alerts(streamed(t, "events").request_changes, t.agents), "review-alerts")


@query("i2_failure_alerts", f"""
select * from (select log_id, ip_address, ts, count(*) over (partition by ip_address order by ts range between interval 24 hour preceding and current row) failures
from audit_logs where {_COUNTED} and ip_address is not null) where failures >= 3""")
def _(t):
    rows = fraud.counted_failures(streamed(t, "events").audit_logs).where(F.col("ip_address").isNotNull())
    return jobs.run_available(jobs.failure_alerts(rows, "ip_address"), "failure-alerts")


@query("i3_strike_counts", """
with s as (select log_id, agent_id, ts from audit_logs where action = 'FRAUD_GUARDRAIL_TRIGGERED' and details->>'$.guardrailType' = 'verification_strike' and agent_id is not null),
r as (select agent_id, ts from audit_logs where action = 'ADMIN_APPROVED' and details->>'$.strikesReset' = 'true' and agent_id is not null),
w as (select s.log_id, s.agent_id, s.ts, max(r.ts) reset_at from s left join r on r.agent_id = s.agent_id and r.ts < s.ts group by all)
select w.log_id, w.agent_id, w.ts, count(*) strikes from w join s on s.agent_id = w.agent_id and s.ts <= w.ts and s.ts >= w.ts - interval 24 hour
   and (w.reset_at is null or s.ts >= w.reset_at) group by all""")
def _(t):
    return jobs.run_available(jobs.strike_counts(streamed(t, "events").audit_logs), "strikes")


@query("i4_rate_verdicts", RATE_SQL)
def _(t):
    return jobs.run_available(jobs.rate_verdicts(streamed(t, "events").passkey_hits, RATE_LIMIT), "rates")


@query("i5_challenge_uses", """
select u.use_id, u.challenge_id, u.used_at, c.expires_at from challenge_uses u join passkey_challenges c on c.id = u.challenge_id
where u.used_at < c.expires_at and u.used_at >= c.expires_at - interval 5 minute""")
def _(t):
    live = streamed(t, "events")
    return jobs.run_available(jobs.challenge_uses(live.challenge_uses, live.passkey_challenges), "challenges")


@query("i6_retention_job", f"with {_PURGE} select * from plan")
def _(t):
    path, checkpoint = scratch_dir(t.spark, "purge-plan"), scratch_dir(t.spark, "purge-state")
    plan = lambda agents: trail.purge_plan(
        t.verification_requests.join(agents, "agent_id", "left_semi"), t.kyc_decisions, t.agent_documents, t.stored_files, REQUEST_NOW)
    jobs.retention_on_change(streamed(t, "orders").verification_requests, plan, path, checkpoint).awaitTermination()
    return jobs.current_plan(t.spark, path)


@query("i7_daily_activity", """
select strftime(ts, '%Y-%m-%d') as day, action, count(*) entries from audit_logs group by 1, 2""")
def _(t):
    return jobs.run_updates(jobs.daily_activity(streamed(t, "events").audit_logs), ["day", "action"], "activity")
