"""Registered queries: guardrails, passkeys (E), trail and retention (F), as-of and interval joins (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.bindings import EVENT_NOW, REQUEST_NOW
from veriframe.operators import fraud, passkeys, trail
from veriframe.plans.directory import _LATEST, _OWNED_RAW, _window
from veriframe.registry import query
from veriframe.schemas import BLOCKED_EMAIL_DOMAINS, CORE_TRAIL, QUALITY_FAILURE_TRAIL

_NOW = f"timestamp '{EVENT_NOW}'"
_DOMAIN = "case when len(string_split(lower(trim(email)), '@')) = 2 then nullif(string_split(lower(trim(email)), '@')[2], '') end"
_BLOCKED = "(" + " or ".join(f"domain = '{b}' or domain like '%.{b}'" for b in BLOCKED_EMAIL_DOMAINS) + ")"
_COUNTED = "(action = 'FRAUD_GUARDRAIL_TRIGGERED' or (action = 'VERIFICATION_INITIATED' and outcome = 'FAILED'))"
_CONFLICT = """case coalesce({0}, 'pending') when 'verified' then 'This national ID is already registered to a verified agent'
  when 'rejected' then 'This national ID has been previously rejected. Please contact support.'
  else 'A registration with this national ID is already in progress' end"""


@query("e1_blocked_email_domain", f"""
select user_id, domain, coalesce({_BLOCKED}, false) blocked from (select user_id, {_DOMAIN} domain from users)""")
def _(t):
    return t.users.select("user_id", fraud.email_domain(F.col("email")).alias("domain"),
                          fraud.is_blocked_domain(F.col("email")).alias("blocked"))


_DUPLICATES = f"""
select a.agent_id, trim(a.national_id) national_id, o.conflicting_agent_id, coalesce(l.status, 'pending') conflicting_status,
       {_CONFLICT.format('l.status')} message
from agents a join (select x.agent_id, case when min(y.agent_id) < x.agent_id then min(y.agent_id) else max(y.agent_id) end conflicting_agent_id
      from agents x join agents y on trim(x.national_id) = trim(y.national_id) and x.agent_id <> y.agent_id group by x.agent_id) o on o.agent_id = a.agent_id
     left join latest l on l.agent_id = o.conflicting_agent_id"""


@query("e2_duplicate_national_id", f"with {_LATEST} {_DUPLICATES}")
def _(t):
    return fraud.duplicate_identities(t.agents, t.verification_requests).select(
        "agent_id", "national_id", "conflicting_agent_id", "conflicting_status", "message")


@query("c5_duplicate_self_join", """
select agent_id, owners from (select agent_id, count(*) over (partition by trim(national_id)) owners from agents) where owners > 1""")
def _(t):
    return fraud.duplicate_identities(t.agents, t.verification_requests).select("agent_id", "owners")


def _window_counts(key):
    return f"""select {key}, count(*) failures, min(ts) oldest from audit_logs where {_COUNTED} and ts >= {_NOW} - interval 24 hour
               and ts <= {_NOW} and {key} is not null group by {key}"""


@query("e3_failures_by_ip", _window_counts("ip_address"))
def _(t):
    return fraud.failures_in_window(t.audit_logs, "ip_address", EVENT_NOW)


@query("e4_failures_by_device", _window_counts("device_fingerprint"))
def _(t):
    return fraud.failures_in_window(t.audit_logs, "device_fingerprint", EVENT_NOW)


@query("e3_rolling_failures_by_ip", f"""
select log_id, ip_address, ts, count(*) over (partition by ip_address order by ts range between interval 24 hour preceding and current row) failures
from audit_logs where {_COUNTED} and ip_address is not null""")
def _(t):
    return fraud.rolling_failures(t.audit_logs, "ip_address")


@query("e5_retry_after", f"""
select ip_address, greatest(1, ceil((epoch_ms(oldest) + 86400000 - epoch_ms({_NOW})) / 1000.0e0))::bigint retry_after
from ({_window_counts("ip_address")})""")
def _(t):
    rows = fraud.failures_in_window(t.audit_logs, "ip_address", EVENT_NOW)
    return rows.select("ip_address", fraud.retry_after_seconds(F.col("oldest"), fraud.at(EVENT_NOW), 24).alias("retry_after"))


@query("e6_guardrail_verdicts", f"""
with {_LATEST}, by_ip as ({_window_counts("ip_address")}), by_device as ({_window_counts("device_fingerprint")}),
dup as (select r.agent_id, min(a.agent_id) low, max(a.agent_id) high from registrations r join agents a
        on trim(a.national_id) = trim(r.national_id) and a.agent_id <> r.agent_id group by 1),
who as (select d.agent_id, case when low < d.agent_id then low else high end other from dup d),
base as (select r.agent_id, {_DOMAIN} domain, w.other, l.status, i.failures ip_n, i.oldest ip_old, v.failures dev_n, v.oldest dev_old
  from registrations r left join who w on w.agent_id = r.agent_id left join latest l on l.agent_id = w.other
       left join by_ip i on i.ip_address = r.ip_address left join by_device v on v.device_fingerprint = r.device_fingerprint),
judged as (select *, case when {_BLOCKED} then 'blocked_email_domain' when other is not null then 'duplicate_national_id'
    when ip_n >= 3 then 'ip_rate_limit' when dev_n >= 3 then 'device_fingerprint_rate_limit' end guardrail_type from base)
select agent_id, guardrail_type, case guardrail_type when 'blocked_email_domain' then 400 when 'duplicate_national_id' then 409
    when 'ip_rate_limit' then 429 when 'device_fingerprint_rate_limit' then 429 end code,
  case guardrail_type when 'ip_rate_limit' then ip_n when 'device_fingerprint_rate_limit' then dev_n when null then null else if(guardrail_type is null, null, 1) end attempt_count,
  case guardrail_type when 'blocked_email_domain' then 'Please use a valid permanent email address to register'
    when 'duplicate_national_id' then {_CONFLICT.format('status')}
    when 'ip_rate_limit' then 'Too many failed attempts from this location. Please try again in 24 hours.'
    when 'device_fingerprint_rate_limit' then 'Too many failed attempts from this device. Please try again in 24 hours.' end message,
  case guardrail_type when 'ip_rate_limit' then greatest(1, ceil((epoch_ms(ip_old) + 86400000 - epoch_ms({_NOW})) / 1000.0e0))::bigint
    when 'device_fingerprint_rate_limit' then greatest(1, ceil((epoch_ms(dev_old) + 86400000 - epoch_ms({_NOW})) / 1000.0e0))::bigint end retry_after
from judged""")
def _(t):
    return fraud.guardrail_verdicts(t.registrations, t.agents, t.verification_requests, t.audit_logs, EVENT_NOW)


_STRIKES = f"""
resets as (select agent_id, max(ts) reset_at from audit_logs where action = 'ADMIN_APPROVED' and ts <= {_NOW} and agent_id is not null and details->>'$.strikesReset' = 'true' group by 1),
strikes as (select l.agent_id, count(*) strikes from audit_logs l left join resets r on r.agent_id = l.agent_id
   where l.action = 'FRAUD_GUARDRAIL_TRIGGERED' and l.details->>'$.guardrailType' = 'verification_strike' and l.ts <= {_NOW}
     and l.agent_id is not null
     and l.ts >= case when r.reset_at > {_NOW} - interval 24 hour then r.reset_at else {_NOW} - interval 24 hour end group by 1)"""
_LONG_STRIKES = _STRIKES.replace("interval 24 hour", "interval 240 hour")


@query("e7_strike_counts", f"with {_STRIKES} select * from strikes")
def _(t):
    return fraud.strike_counts(t.audit_logs.where("agent_id is not null"), EVENT_NOW)


@query("c9_strikes_after_last_reset", f"with {_LONG_STRIKES} select * from strikes")
def _(t):
    return fraud.strike_counts(t.audit_logs.where("agent_id is not null"), EVENT_NOW, hours=240)


@query("e8_auto_rejections", f"""
with {_LATEST}, {_STRIKES}
select s.agent_id, s.strikes, l.request_id, l.status old_status, case when l.request_id is not null then 'rejected' end new_status,
       coalesce(l.status <> 'rejected', false) changed,
       concat('{{"reason":"Maximum verification attempts exceeded","strikeCount":', s.strikes, ',"threshold":3}}') details
from strikes s left join latest l on l.agent_id = s.agent_id where s.strikes >= 3""")
def _(t):
    logs = t.audit_logs.where("agent_id is not null")
    return fraud.auto_rejections(logs, t.verification_requests, EVENT_NOW).drop("action", "outcome")


@query("e9_strike_resets", f"""
with {_STRIKES}
select a.agent_id, coalesce(s.strikes, 0) previous_count, 'ADMIN_APPROVED' action, 'SUCCESS' outcome, 'system' performed_by,
       concat('{{"strikesReset":true,"previousStrikeCount":', coalesce(s.strikes, 0), ',"note":"Administrator reset verification strike count"}}') details
from agents a left join strikes s on s.agent_id = a.agent_id""")
def _(t):
    return fraud.strike_resets(t.agents, t.audit_logs, EVENT_NOW)


@query("e10_flagged_registrations", f"""
with entries as (select log_id, ts, agent_id, coalesce(ip_address, details->>'$.ipAddress') ip_address,
     coalesce(device_fingerprint, details->>'$.deviceFingerprint') device_fingerprint,
     coalesce(details->>'$.guardrailType', details->>'$.guardrail', 'unknown') guardrail_type,
     cast(coalesce(details->>'$.attemptCount', details->>'$.failureCount') as bigint) attempt_count
   from audit_logs where action = 'FRAUD_GUARDRAIL_TRIGGERED' and ts >= {_NOW} - interval 7 day and ts <= {_NOW})
select *, coalesce(ip_address, 'unknown') group_ip, count(*) over (partition by coalesce(ip_address, 'unknown')) group_count from entries""")
def _(t):
    return fraud.flagged_by_address(fraud.flagged_entries(t.audit_logs, EVENT_NOW)).drop("outcome")


@query("e11_client_ip", """
select agent_id, case when trim(forwarded_for) <> '' then trim(split_part(forwarded_for, ',', 1)) else remote_address end client_ip from registrations""")
def _(t):
    return t.registrations.select("agent_id", fraud.client_ip(F.col("forwarded_for"), F.col("remote_address")).alias("client_ip"))


RATE_LIMIT = 3
RATE_SQL = f"""
with recursive openers as (
  select bucket, min(ts) opened_at from passkey_hits group by bucket
  union all
  select o.bucket, min(h.ts) from openers o join passkey_hits h on h.bucket = o.bucket and h.ts > o.opened_at + interval 5 minute group by o.bucket)
select h.hit_id, h.bucket, h.ts, o.opened_at, row_number() over (partition by h.bucket, o.opened_at order by h.ts, h.hit_id) attempts,
       row_number() over (partition by h.bucket, o.opened_at order by h.ts, h.hit_id) <= {RATE_LIMIT} allowed
from passkey_hits h join openers o on o.bucket = h.bucket and h.ts >= o.opened_at and h.ts <= o.opened_at + interval 5 minute"""


@query("e12_rate_buckets", RATE_SQL)
def _(t):
    return passkeys.rate_buckets(t.passkey_hits, RATE_LIMIT)


CONSUME_SQL = """
select use_id, challenge_id, case when c.id is null or rn > 1 then 'missing'
   when u.purpose <> c.purpose or u.user_id is distinct from c.user_id then 'wrong_purpose_or_user'
   when c.expires_at <= u.used_at then 'expired' else 'ok' end outcome
from (select *, row_number() over (partition by challenge_id order by used_at, use_id) rn from challenge_uses) u
     left join passkey_challenges c on c.id = u.challenge_id"""


@query("e13_challenge_single_use", CONSUME_SQL)
def _(t):
    return passkeys.consume_challenges(t.challenge_uses, t.passkey_challenges)


@query("c11_use_within_expiry", """
select u.use_id, u.challenge_id from challenge_uses u join passkey_challenges c on c.id = u.challenge_id
where u.used_at < c.expires_at and u.used_at >= c.expires_at - interval 5 minute""")
def _(t):
    return passkeys.uses_within_expiry(t.challenge_uses, t.passkey_challenges).select("use_id", "challenge_id")


@query("e14_counter_regression", """
select use_id, passkey_id, new_counter, cur current_counter, (new_counter > 0 or cur > 0) and new_counter <= cur rejected
from (select u.*, greatest(p.counter, coalesce(max(new_counter) over (partition by passkey_id order by ts, use_id
        rows between unbounded preceding and 1 preceding), p.counter)) cur
      from credential_uses u join passkeys p on p.id = u.passkey_id)""")
def _(t):
    return passkeys.counter_regressions(t.credential_uses, t.passkeys)


@query("e15_removal_protection", """
select r.removal_id, r.owner_id, r.passkey_id,
   case when not exists (select 1 from passkeys p where p.id = r.passkey_id and p.user_id = r.owner_id) then 'not_found'
        when (select count(*) from passkeys p where p.user_id = r.owner_id) <= 1
             and not exists (select 1 from login_methods m where m.user_id = r.owner_id and (m.encrypted_password <> '' or m.has_identity)) then 'last_method'
        else 'removed' end verdict
from passkey_removals r""")
def _(t):
    return passkeys.removal_verdicts(t.passkey_removals, t.passkeys, t.login_methods)


# ---- F ---------------------------------------------------------------------------------------
def _list(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_TRAIL = f"""{_LATEST},
seen as (select agent_id, list_distinct(list(action)) acts, bool_or(action = 'IMAGE_QUALITY_ASSESSED' and outcome = 'FAILED') qf
         from audit_logs where agent_id is not null group by 1),
expected as (select a.agent_id, l.status final_status, coalesce(s.acts, []) acts,
   case when coalesce(s.qf, false) then {_list(QUALITY_FAILURE_TRAIL)}
        when l.status = 'verified' then {_list(CORE_TRAIL + ['ACCESS_GRANTED'])}
        when l.status = 'rejected' then {_list(CORE_TRAIL + ['ACCESS_DENIED'])}
        when l.status = 'review' and list_contains(s.acts, 'ADMIN_APPROVED') then {_list(CORE_TRAIL + ['MANUAL_REVIEW_FLAGGED', 'ADMIN_APPROVED', 'ACCESS_GRANTED'])}
        when l.status = 'review' and list_contains(s.acts, 'ADMIN_REJECTED') then {_list(CORE_TRAIL + ['MANUAL_REVIEW_FLAGGED', 'ADMIN_REJECTED', 'ACCESS_DENIED'])}
        when l.status = 'review' then {_list(CORE_TRAIL + ['MANUAL_REVIEW_FLAGGED'])} else {_list(CORE_TRAIL)} end expected
   from agents a left join latest l on l.agent_id = a.agent_id left join seen s on s.agent_id = a.agent_id)"""


@query("f1_trail_completeness", f"""
with {_TRAIL}
select agent_id, final_status, array_to_string(list_filter(expected, lambda x: list_contains(acts, x)), ',') present,
       array_to_string(list_filter(expected, lambda x: not list_contains(acts, x)), ',') missing,
       len(list_filter(expected, lambda x: not list_contains(acts, x))) = 0 complete from expected""")
def _(t):
    return trail.audit_trails(t.agents, t.audit_logs, t.verification_requests).select(
        "agent_id", "final_status", F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"), "complete")


@query("f2_trail_order", f"""
with {_TRAIL},
steps as (select l.agent_id, list_position(e.expected, l.action) pos, lag(list_position(e.expected, l.action)) over (partition by l.agent_id order by l.ts, l.log_id) prev
          from audit_logs l join expected e on e.agent_id = l.agent_id where list_contains(e.expected, l.action))
select e.agent_id, coalesce(bool_or(prev > pos), false) unexpected_order from expected e left join steps s on s.agent_id = e.agent_id group by 1""")
def _(t):
    return trail.audit_trails(t.agents, t.audit_logs, t.verification_requests).select("agent_id", "unexpected_order")


_RV, _RE, _RO = _window("d.decided_at", "r.status", "d.final_decision")


@query("f3_audit_window", f"""
select r.request_id, r.agent_id, {_RV} verified_at, {_RE} expires_at, {_RO} "open"
from verification_requests r join kyc_decisions d on d.request_id = r.request_id""")
def _(t):
    return trail.audit_windows(t.verification_requests, t.kyc_decisions, REQUEST_NOW)


_LV, _LE, _LO = _window("d.decided_at", "l.status", "d.final_decision")
_PURGE = f"""{_LATEST},
due as (select l.agent_id, {_LV} verified_at from latest l join kyc_decisions d on d.request_id = l.request_id
        where l.status = 'verified' and {_LE} <= timestamp '{REQUEST_NOW}'),
raw_rows as (select d.agent_id, d.document_id, {_OWNED_RAW.replace('file_url', 'd.file_url')} path from agent_documents d join due u on u.agent_id = d.agent_id
        where d.document_type <> 'utility_bill' and d.file_url <> '' and d.uploaded_at <= u.verified_at),
purge_rows as (select * from raw_rows where path like concat(cast(agent_id as varchar), '/%') and not list_contains(string_split(path, '/'), '..')),
purge_files as (select agent_id, path from purge_rows union
        select f.agent_id, concat(f.agent_id, '/', folder, '/', file_name) from stored_files f join due u on u.agent_id = f.agent_id
        where folder in ('documents', 'selfies') and modified_at <= verified_at),
plan as (select 'file' kind, agent_id, cast(null as bigint) document_id, path from purge_files
         union all select 'row', agent_id, document_id, path from purge_rows)"""


@query("f4_purge_plan", f"with {_PURGE} select * from plan")
def _(t):
    return trail.purge_plan(t.verification_requests, t.kyc_decisions, t.agent_documents, t.stored_files, REQUEST_NOW)


@query("f5_rows_to_blank", f"""
with {_PURGE}
select agent_id, document_id, path from plan where kind = 'row' and agent_id not in (select agent_id from plan where kind = 'file' and agent_id % 4 = 0)""")
def _(t):
    plan = trail.purge_plan(t.verification_requests, t.kyc_decisions, t.agent_documents, t.stored_files, REQUEST_NOW)
    removals = plan.where(F.col("kind") == "file").select("agent_id", "path", (F.col("agent_id") % 4 != 0).alias("removed"))
    return trail.rows_to_blank(plan, removals)


@query("f6_signed_url_lifetime", f"""
with {_LATEST}
select a.agent_id, greatest(0, case when {_LE} is null then 3600 else least(3600, floor((epoch_ms({_LE}) - epoch_ms(timestamp '{REQUEST_NOW}')) / 1000.0e0)) end)::bigint as "seconds",
       coalesce(case when {_LE} is null then 3600 else floor((epoch_ms({_LE}) - epoch_ms(timestamp '{REQUEST_NOW}')) / 1000.0e0) end <= 0, false) retention_expired
from agents a left join latest l on l.agent_id = a.agent_id left join kyc_decisions d on d.request_id = l.request_id""")
def _(t):
    return trail.signed_url_lifetime(t.agents, t.verification_requests, t.kyc_decisions, REQUEST_NOW)


@query("f7_immutable_log_check", """
select log_id, case when log_id % 101 = 0 then 'removed' else 'changed' end as change from audit_logs where log_id % 101 = 0 or (log_id % 103 = 0 and log_id % 101 <> 0)""")
def _(t):
    before = t.audit_logs
    after = before.where(F.col("log_id") % 101 != 0).withColumn(
        "details", F.when(F.col("log_id") % 103 == 0, F.concat(F.coalesce("details", F.lit("")), F.lit(" "))).otherwise(F.col("details")))
    return trail.snapshot_changes(before, after, "log_id")


@query("c4_superseded_files", f"""
select f.path from (select concat(agent_id, '/', folder, '/', file_name) path from stored_files) f
where f.path not in (select path from (select agent_id, {_OWNED_RAW} path from agent_documents) where path is not null)""")
def _(t):
    from veriframe.functions.storage import owned_path
    from veriframe.operators.directory import superseded_files

    files = t.stored_files.select(F.concat_ws("/", F.col("agent_id").cast("string"), "folder", "file_name").alias("path"))
    rows = t.agent_documents.select(owned_path(F.col("file_url"), F.col("agent_id")).alias("path"))
    return superseded_files(files, rows)
