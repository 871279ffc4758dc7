"""Registered queries: sources and sinks (A), views (B), joins (C), integrity (H)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from veriframe.bindings import EVENT_NOW, REQUEST_NOW
from veriframe.functions.clock import at
from veriframe.functions.storage import owned_path, path_from_url
from veriframe.operators import directory as d
from veriframe.operators import integrity
from veriframe.registry import query
from veriframe.schemas import DEVICE_TYPES, FEATURES, PURPOSES, ROLES, STATUSES
from veriframe.session import scratch_dir
from veriframe.sources import readers, writers

_LATEST = """
latest as (select agent_id, request_id, status, created_at from (
    select *, row_number() over (partition by agent_id order by created_at desc, request_id desc) rn
    from verification_requests) where rn = 1)"""
_LATEST_ACCESS = """
latest_access as (select * from (
    select *, row_number() over (partition by agent_id order by enforced_at desc, record_id desc) rn
    from access_control_records) where rn = 1)"""


def _window(decided, status, final, now=REQUEST_NOW):
    """Checking SQL for the audit window of one row."""
    verified = f"case when {status} = 'verified' and {final} = 'verified' then {decided} end"
    day = f"isodow({decided} + interval 3 hour)"
    expires = (
        f"case when {status} = 'verified' and {final} = 'verified' then {decided} + "
        f"(case when {day} in (3, 4, 5) then 5 when {day} = 6 then 4 else 3 end) * interval 1 day end"
    )
    is_open = f"coalesce({verified} <= timestamp '{now}' and {expires} > timestamp '{now}', false)"
    return verified, expires, is_open


_V, _E, _O = _window("d.decided_at", "coalesce(l.status, 'pending')", "d.final_decision")
_SCORE_LIST = ", ".join(f"s.{f}" for f in FEATURES)


# ---- A ---------------------------------------------------------------------------------------
_COUNTED = ["agents", "users", "agent_documents", "verification_requests", "verification_scores",
            "kyc_decisions", "access_control_records", "audit_logs", "passkeys"]


@query("a1_read_domain_tables", " union all ".join(
    f"select '{t}' table_name, count(*) n from {t}" for t in _COUNTED))
def _(t):
    parts = [getattr(t, name).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n")) for name in _COUNTED]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("a2_read_score_csv", f"select request_id, {', '.join(FEATURES)} from verification_scores")
def _(t):
    path = scratch_dir(t.spark, "scores-csv")
    writers.write_measurements(t.verification_scores, path, "csv")
    return readers.read_benchmark_csv(t.spark, "scores", path)


@query("a3_audit_export", """
select strftime(l.ts, '%Y-%m-%dT%H:%M:%S.%f') "Timestamp", coalesce(cast(l.agent_id as varchar), '') "AgentID",
       coalesce(nullif(a.full_name, ''), 'Unknown') "AgentName", l.action "Action", l.outcome "Outcome"
from (select * from audit_logs where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-26'
      ) l left join agents a on a.agent_id = l.agent_id""")
def _(t):
    rows = writers.export_rows(t.audit_logs, t.agents, start="2024-01-05", end="2024-01-25")
    path = scratch_dir(t.spark, "export")
    writers.write_export(rows, path)
    return t.spark.read.schema(rows.schema).option("header", True).option("quote", '"').option("escape", '"').csv(path).fillna("")


@query("a3_audit_export_lines", """
select 'Timestamp,AgentID,AgentName,Action,Outcome' line union all select concat_ws(',', strftime(l.ts, '%Y-%m-%dT%H:%M:%S.%f'), cast(l.agent_id as varchar),
       case when a.full_name like '%,%' then concat('"', a.full_name, '"') else a.full_name end, l.action, l.outcome) line
from (select l.* from audit_logs l where l.action = 'FRAUD_GUARDRAIL_TRIGGERED'
        and l.agent_id in (select agent_id from agents where full_name ilike '%build%')
      ) l join agents a on a.agent_id = l.agent_id""")
def _(t):
    rows = writers.export_rows(
        t.audit_logs, t.agents, action="FRAUD_GUARDRAIL_TRIGGERED", agent_name="build")
    return writers.csv_lines(rows).select("line")


@query("a4_sample_measurements", """
select request_id, document_kind, document_found, document_blur, document_brightness, document_contrast
from quality_measurements""")
def _(t):
    rows = t.quality_measurements.select(
        "request_id", "document_kind", "document_found", "document_blur", "document_brightness", "document_contrast")
    path = scratch_dir(t.spark, "measurements")
    writers.write_measurements(rows, path)
    return t.spark.read.schema(rows.schema).parquet(path)


@query("a5_run_report", """
select status, count(*) n, 'run-1' run_id from verification_requests group by status""")
def _(t):
    rows = t.verification_requests.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_dir(t.spark, "report")
    writers.write_report(rows, path, "run-1")
    return t.spark.read.schema("status string, n bigint, run_id string").json(path)


_ENTRIES = """
select agent_id, request_id, case when log_id % 97 = 0 then '' else action end action,
       case when log_id % 89 = 0 then null else outcome end outcome, details, performed_by,
       case when log_id % 5 = 0 then '' else ip_address end ip_address, device_fingerprint from audit_logs"""


@query("a6_audit_append", f"""
select agent_id, request_id, action, outcome, details, performed_by, nullif(ip_address, '') ip_address, device_fingerprint,
       timestamp '{EVENT_NOW}' ts
from (select *, case when log_id % 97 = 0 then '' else action end action2,
             case when log_id % 89 = 0 then null else outcome end outcome2,
             case when log_id % 5 = 0 then '' else ip_address end ip2
      from audit_logs) where action2 <> '' and outcome2 <> ''
""".replace("nullif(ip_address, '')", "nullif(ip2, '')"))
def _(t):
    entries = t.audit_logs.select(
        "agent_id", "request_id",
        F.when(F.col("log_id") % 97 == 0, "").otherwise(F.col("action")).alias("action"),
        F.when(F.col("log_id") % 89 != 0, F.col("outcome")).alias("outcome"), "details", "performed_by",
        F.when(F.col("log_id") % 5 == 0, "").otherwise(F.col("ip_address")).alias("ip_address"), "device_fingerprint")
    path = scratch_dir(t.spark, "audit")
    writers.append_audit(entries, path, EVENT_NOW)
    return readers.read_table(t.spark, "audit_logs", path).drop("log_id", "day")


@query("a7_fingerprint", """
select count(*) n, sha256(concat(cast(count(*) as varchar), ':', cast(sum(cast(concat('0x', substr(md5(concat_ws('|',
       cast(agent_id as varchar), cast(request_id as varchar), status)), 1, 15)) as hugeint)) as varchar))) sha256
from verification_requests""")
def _(t):
    return writers.fingerprint(t.verification_requests, ["request_id", "agent_id", "status"])


# ---- B ---------------------------------------------------------------------------------------
@query("b1_agent_directory", f"""
with {_LATEST}
select a.agent_id, a.full_name, coalesce(l.status, 'pending') status, l.request_id, {_SCORE_LIST},
       d.final_decision, d.decided_at, {_V} verified_at, {_E} expires_at, {_O} window_open
from agents a left join latest l on l.agent_id = a.agent_id
     left join verification_scores s on s.request_id = l.request_id
     left join kyc_decisions d on d.request_id = l.request_id""")
def _(t):
    return d.agent_directory(
        t.agents, t.verification_requests, t.verification_scores, t.kyc_decisions, REQUEST_NOW
    ).select("agent_id", "full_name", "status", "request_id", *FEATURES, "final_decision", "decided_at",
             "verified_at", "expires_at", "window_open")


@query("b1_directory_open_window", f"""
with {_LATEST}
select a.agent_id, l.request_id, {_E} expires_at
from agents a join latest l on l.agent_id = a.agent_id join kyc_decisions d on d.request_id = l.request_id
where coalesce(l.status, 'pending') = 'verified' and {_O}""")
def _(t):
    return d.agent_directory(
        t.agents, t.verification_requests, t.verification_scores, t.kyc_decisions, REQUEST_NOW,
        status="verified", window_open=True,
    ).select("agent_id", "request_id", "expires_at")


@query("b2_pending_review", f"""
select r.request_id, r.agent_id, a.full_name, a.national_id, r.created_at, {_SCORE_LIST}, d.final_decision, d.decision_basis
from verification_requests r join agents a on a.agent_id = r.agent_id
     left join verification_scores s on s.request_id = r.request_id left join kyc_decisions d on d.request_id = r.request_id
where r.status = 'review'""")
def _(t):
    return d.pending_review(t.verification_requests, t.agents, t.verification_scores, t.kyc_decisions).select(
        "request_id", "agent_id", "full_name", "national_id", "created_at", *FEATURES, "final_decision", "decision_basis")


_HV, _HE, _HO = _window("d.decided_at", "r.status", "d.final_decision")


@query("b3_agent_history", f"""
with {_LATEST_ACCESS}
select r.request_id, r.agent_id, nullif(u.email, '') user_email, r.status, s.face_match_score, s.liveness_score, d.final_decision,
       x.record_id access_record_id, x.access_granted, {_HE} expires_at, {_HO} window_open
from verification_requests r join agents a on a.agent_id = r.agent_id left join users u on u.user_id = a.user_id
     left join verification_scores s on s.request_id = r.request_id left join kyc_decisions d on d.request_id = r.request_id
     left join latest_access x on x.agent_id = r.agent_id""")
def _(t):
    return d.agent_history(
        t.agents, t.users, t.verification_requests, t.verification_scores, t.kyc_decisions, t.access_control_records,
        REQUEST_NOW,
    ).select("request_id", "agent_id", "user_email", "status", "face_match_score", "liveness_score", "final_decision",
             "access_record_id", "access_granted", "expires_at", "window_open")


@query("b4_latest_ocr_summary", """
with newest as (select * from (select *, row_number() over (partition by agent_id order by ts desc, log_id desc) rn
     from audit_logs where action = 'OCR_VERIFIED' and agent_id is not null) where rn = 1 and details is not null)
select n.agent_id, n.ts, n.details->>'$.confidenceScore' "confidenceScore", n.details->>'$.extractedName' "extractedName",
       n.details->>'$.extractedDOB' "extractedDOB", n.details->>'$.idMatch' "idMatch",
       coalesce(n.details->>'$.registeredName', a.full_name) "registeredName", a.national_id "registeredIDNumber",
       cast(a.date_of_birth as varchar) "registeredDOB"
from newest n join agents a on a.agent_id = n.agent_id""")
def _(t):
    return d.latest_ocr_summary(t.audit_logs, t.agents).select(
        "agent_id", "ts", "confidenceScore", "extractedName", "extractedDOB", "idMatch", "registeredName",
        "registeredIDNumber", "registeredDOB")


@query("b5_audit_page", """
select l.log_id, l.ts, l.agent_id, coalesce(nullif(a.full_name, ''), 'Unknown') agent_name, l.action, l.outcome,
       (select count(*) from audit_logs) total
from (select * from audit_logs order by ts desc, log_id desc limit 50 offset 100) l left join agents a on a.agent_id = l.agent_id""")
def _(t):
    return d.audit_page(t.audit_logs, t.agents, page=3, page_size=50).select(
        "log_id", "ts", "agent_id", "agent_name", "action", "outcome", "total")


@query("b6_agent_logs_with_performer", """
select l.log_id, l.agent_id, l.ts, l.action, l.performed_by,
       case when l.performed_by is null or l.performed_by in ('', 'system') then 'System'
            when u.user_id is null then l.performed_by
            else coalesce(nullif(a.full_name, ''), nullif(u.email, ''), l.performed_by) end performed_by_label
from audit_logs l left join users u on u.user_id = l.performed_by left join agents a on a.user_id = l.performed_by
where l.agent_id is not null""")
def _(t):
    logs = t.audit_logs.where(F.col("agent_id").isNotNull())
    return d.with_performer_label(logs, t.users, t.agents).select(
        "log_id", "agent_id", "ts", "action", "performed_by", "performed_by_label")


@query("b7_recent_activity", """
select l.log_id, l.ts, l.agent_id, coalesce(nullif(a.full_name, ''), 'Unknown') agent_name, l.action, l.outcome, l.request_id
from (select * from audit_logs order by ts desc, log_id desc limit 20) l left join agents a on a.agent_id = l.agent_id""")
def _(t):
    return d.recent_activity(t.audit_logs, t.agents).select(
        "log_id", "ts", "agent_id", "agent_name", "action", "outcome", "request_id")


@query("b8_agent_visible_logs", """
select log_id, agent_id, ts, action from audit_logs
where not coalesce(details->>'$.svmFallback' not in ('false', '0', ''), false)""")
def _(t):
    return d.agent_visible_logs(t.audit_logs).select("log_id", "agent_id", "ts", "action")


@query("b9_search_agents", """
select agent_id, full_name, national_id from agents
where lower(full_name) like '%mach%' or lower(national_id) like '%mach%'""")
def _(t):
    return d.search_agents(t.agents, " Mach ").select("agent_id", "full_name", "national_id")


@query("b10_logs_by_agent_name", """
select log_id, agent_id, action from audit_logs
where agent_id in (select agent_id from agents where full_name ilike '%furn%')""")
def _(t):
    return d.by_agent_name(t.audit_logs, t.agents, "FURN").select("log_id", "agent_id", "action")


@query("b11_logs_in_date_range", """
select log_id, ts, action from audit_logs where ts >= timestamp '2024-01-10' and ts <= timestamp '2024-01-12 23:59:59.999999'""")
def _(t):
    return d.in_date_range(t.audit_logs, "2024-01-10", "2024-01-12").select("log_id", "ts", "action")


@query("b12_verification_status", f"""
with {_LATEST}, {_LATEST_ACCESS}
select a.agent_id, l.request_id, coalesce(l.status, 'not_started') status,
       coalesce(l.status in ('verified', 'review', 'rejected') and d.request_id is not null, false) is_final,
       case when s.request_id is not null then 'complete' else 'pending' end image_quality,
       case when d.request_id is not null then 'complete' else 'pending' end verification_decision,
       d.final_decision, case when d.request_id is not null then coalesce(d.decision_basis, 'placeholder_threshold') end decision_basis,
       case when l.request_id is not null then x.access_granted end access_granted
from agents a left join latest l on l.agent_id = a.agent_id left join verification_scores s on s.request_id = l.request_id
     left join kyc_decisions d on d.request_id = l.request_id left join latest_access x on x.agent_id = a.agent_id""")
def _(t):
    return d.verification_status(
        t.agents, t.verification_requests, t.verification_scores, t.kyc_decisions, t.access_control_records
    ).select("agent_id", "request_id", "status", "is_final", "image_quality", "verification_decision",
             "final_decision", "decision_basis", "access_granted")


@query("b13_verification_result", f"""
with {_LATEST}
select l.agent_id, l.request_id, l.status, d.final_decision, x.record_id, x.access_granted, s.face_match_score
from latest l join kyc_decisions d on d.request_id = l.request_id
     left join access_control_records x on x.decision_id = d.decision_id left join verification_scores s on s.request_id = l.request_id""")
def _(t):
    return d.verification_result(
        t.verification_requests, t.kyc_decisions, t.access_control_records, t.verification_scores
    ).select("agent_id", "request_id", "status", "final_decision", "record_id", "access_granted", "face_match_score")


@query("b14_registration_stage", """
select a.agent_id, case when not (trim(a.full_name) <> '' and trim(a.phone_number) <> '' and trim(a.national_id) <> ''
                                 and a.date_of_birth is not null) then 'incomplete'
            when exists (select 1 from agent_documents x where x.agent_id = a.agent_id
                         and x.document_type in ('national_id', 'id_front', 'passport', 'drivers_licence'))
             and exists (select 1 from agent_documents x where x.agent_id = a.agent_id and x.document_type = 'selfie')
            then 'verification_pending' else 'documents_submitted' end stage
from agents a""")
def _(t):
    return d.registration_stage(t.agents, t.agent_documents)


@query("b15_document_choice", """
with ranked as (select *, case document_type when 'id_front' then 1 when 'passport' then 2 when 'drivers_licence' then 3
                          when 'national_id' then 4 end pref from agent_documents),
prim as (select * from (select *, row_number() over (partition by agent_id order by pref, uploaded_at desc, document_id desc) rn
         from ranked where pref is not null) where rn = 1),
back as (select agent_id, max_by(document_id, (uploaded_at, document_id)) id from agent_documents where document_type = 'id_back' group by 1),
self as (select agent_id, max_by(document_id, (uploaded_at, document_id)) id from agent_documents where document_type = 'selfie' group by 1)
select k.agent_id, p.document_id primary_document_id, b.id back_document_id, s.id selfie_document_id,
       case when p.document_type in ('passport', 'drivers_licence') then p.document_type else 'national_id' end document_kind,
       p.document_id is not null and s.id is not null can_start
from (select distinct agent_id from agent_documents where document_type <> 'utility_bill') k
     left join prim p on p.agent_id = k.agent_id left join back b on b.agent_id = k.agent_id left join self s on s.agent_id = k.agent_id""")
def _(t):
    return d.document_choice(t.agent_documents)


@query("b16_camera_required", """
select a.agent_id, exists (select 1 from verification_requests r where r.agent_id = a.agent_id) camera_required from agents a""")
def _(t):
    return d.camera_required(t.agents, t.verification_requests)


@query("b16_capture_violations", """
select l.log_id, l.agent_id, l.ts from audit_logs l
where l.action = 'DOCUMENTS_UPLOADED'
  and exists (select 1 from verification_requests r where r.agent_id = l.agent_id and r.created_at < l.ts)
  and ((l.details->>'$.primaryPath' is not null and coalesce(l.details->>'$.documentFrontSource', '') <> 'camera')
       or (l.details->>'$.backPath' is not null and coalesce(l.details->>'$.documentBackSource', '') <> 'camera'))""")
def _(t):
    return d.capture_violations(t.audit_logs, t.verification_requests).select("log_id", "agent_id", "ts")


@query("b17_latest_step_details", """
with newest as (select * from (select *, row_number() over (partition by request_id, action order by ts desc, log_id desc) rn
  from audit_logs where action in ('OCR_VERIFIED', 'FACE_MATCH_COMPLETED', 'LIVENESS_DETECTED', 'KYC_DECISION_MADE')) where rn = 1)
select request_id, max(case when action = 'OCR_VERIFIED' then details end) "OCR_VERIFIED",
       max(case when action = 'FACE_MATCH_COMPLETED' then details end) "FACE_MATCH_COMPLETED",
       max(case when action = 'LIVENESS_DETECTED' then details end) "LIVENESS_DETECTED",
       max(case when action = 'KYC_DECISION_MADE' then details end) "KYC_DECISION_MADE"
from newest group by request_id""")
def _(t):
    return d.latest_step_details(t.audit_logs)


@query("b18_visible_rows", """
select 'agent' viewer, log_id from audit_logs where agent_id in (select agent_id from agents where user_id = 'user_7')
union all select 'admin', log_id from audit_logs
union all select 'self', agent_id from agents where user_id = 'user_9'""")
def _(t):
    own = d.visible_rows(t.audit_logs, "user_7", t.users, t.agents).select(F.lit("agent").alias("viewer"), "log_id")
    every = d.visible_rows(t.audit_logs, "user_97", t.users, t.agents).select(F.lit("admin").alias("viewer"), "log_id")
    me = d.visible_rows(t.agents, "user_9", t.users).select(F.lit("self").alias("viewer"), F.col("agent_id").alias("log_id"))
    return own.unionByName(every).unionByName(me)


_PATH_SQL = """
case when file_url is null or file_url = '' then null when file_url not like 'http%' then file_url
     when regexp_matches(file_url, '/object/(public|sign|authenticated)/agent-documents/')
       then url_decode(regexp_extract(file_url, '/object/(?:public|sign|authenticated)/agent-documents/([^?]*)', 1))
     when contains(file_url, 'agent-documents/') then url_decode(regexp_extract(file_url, 'agent-documents/([^?]*)', 1))
     else file_url end"""
_OWNED_RAW = """
case when file_url like 'http%' then nullif(url_decode(regexp_extract(split_part(file_url, '?', 1),
     '/object/(?:public|sign|authenticated)/agent-documents/(.+)', 1)), '') else file_url end"""


@query("b19_storage_path", f"""
select document_id, path, case when raw like concat(cast(agent_id as varchar), '/%') and not list_contains(string_split(raw, '/'), '..')
       and file_url <> '' then raw end owned_path
from (select *, {_PATH_SQL} path, {_OWNED_RAW} raw from agent_documents)""")
def _(t):
    return t.agent_documents.select(
        "document_id", path_from_url(F.col("file_url")).alias("path"),
        owned_path(F.col("file_url"), F.col("agent_id")).alias("owned_path"))


@query("b20_date_of_birth_check", f"""
select agent_id, case when date_of_birth is null then 'Date of birth is required'
   when not regexp_full_match(date_of_birth, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') or dob is null then 'Enter a valid date of birth'
   when dob >= timestamp '{EVENT_NOW}' then 'Date of birth must be in the past'
   when age < 18 then 'You must be at least 18 years old' when age > 120 then 'Enter a valid date of birth' end error
from (select *, try_strptime(date_of_birth, '%Y-%m-%d') dob,
             (epoch_us(timestamp '{EVENT_NOW}') - epoch_us(try_strptime(date_of_birth, '%Y-%m-%d'))) / (365.25e0 * 86400e6) age
      from registrations)""")
def _(t):
    return t.registrations.select(
        "agent_id", d.date_of_birth_error(F.col("date_of_birth"), at(EVENT_NOW)).alias("error"))


@query("b21_activity_days", """
select log_id, strftime(ts, '%Y-%m-%d') as day, count(*) over (partition by cast(ts as date)) entries from audit_logs""")
def _(t):
    return d.activity_days(t.audit_logs).select("log_id", "day", "entries")


@query("b22_score_tones", """
select request_id,
  case when ocr_confidence_score >= 0.7 then 'green' when ocr_confidence_score >= 0.4 then 'amber' else 'red' end ocr_confidence_score_tone,
  round(least(100, ocr_confidence_score / 1 * 100), 6) ocr_confidence_score_percent,
  case when face_match_score >= 80 then 'green' when face_match_score >= 50 then 'amber' else 'red' end face_match_score_tone,
  round(least(100, face_match_score / 100 * 100), 6) face_match_score_percent,
  case when liveness_score >= 0.75 then 'green' when liveness_score >= 0.5 then 'amber' else 'red' end liveness_score_tone,
  round(least(100, liveness_score * 100), 6) liveness_score_percent,
  case when brightness_score between 40 and 220 then 'green' else 'red' end brightness_score_tone
from verification_scores""")
def _(t):
    rows = d.score_tones(t.verification_scores)
    return rows.select(*[F.round(c, 6).alias(c) if c.endswith("_percent") else F.col(c) for c in rows.columns])


def _case(column, labels, other):
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in labels.items()) + f" else {other} end"


@query("b23_labels", f"""
select log_id, {_case('action', d.ACTION_LABELS, 'action')} action_label,
       {_case("coalesce(details->>'$.guardrailType', details->>'$.guardrail')", d.GUARDRAIL_LABELS,
              "coalesce(details->>'$.guardrailType', details->>'$.guardrail', 'Unknown')")} guardrail_label
from audit_logs""")
def _(t):
    return d.with_all_labels(t.audit_logs).select("log_id", "action_label", "guardrail_label")


@query("b23_basis_labels", f"""
select request_id, {_case("coalesce(decision_basis, 'placeholder_threshold')", d.BASIS_LABELS, "concat('Decision basis: ', decision_basis)")} basis_label
from kyc_decisions""")
def _(t):
    return d.with_basis_label(t.kyc_decisions).select("request_id", "basis_label")


# ---- C (plain joins; the others sit with their families) --------------------------------------
@query("c1_request_lookup_join", """
select r.request_id, s.face_match_score, d.final_decision from verification_requests r
left join verification_scores s on s.request_id = r.request_id left join kyc_decisions d on d.request_id = r.request_id""")
def _(t):
    return d.with_scores_and_decision(t.verification_requests, t.verification_scores, t.kyc_decisions).select(
        "request_id", "face_match_score", "final_decision")


@query("c2_log_agent_name_join", """
select l.log_id, coalesce(nullif(a.full_name, ''), 'Unknown') agent_name from audit_logs l left join agents a on a.agent_id = l.agent_id""")
def _(t):
    return d.with_agent_name(t.audit_logs, t.agents).select("log_id", "agent_name")


@query("c3_semi_join", """
select a.agent_id from agents a where exists (select 1 from users u where u.user_id = a.user_id and u.role = 'admin')
   and exists (select 1 from verification_requests r where r.agent_id = a.agent_id)""")
def _(t):
    admins = t.users.where(F.col("role") == "admin")
    return t.agents.join(admins, "user_id", "left_semi").join(
        t.verification_requests, "agent_id", "left_semi").select("agent_id")


@query("c4_anti_joins", """
select 'request_without_decision' kind, request_id id from verification_requests r
where not exists (select 1 from kyc_decisions d where d.request_id = r.request_id)
union all select 'orphan_decision', request_id from kyc_decisions d
where not exists (select 1 from verification_requests r where r.request_id = d.request_id)""")
def _(t):
    open_ = d.requests_without_decision(t.verification_requests, t.kyc_decisions)
    lost = d.orphan_decisions(t.kyc_decisions, t.verification_requests)
    return open_.select(F.lit("request_without_decision").alias("kind"), F.col("request_id").alias("id")).unionByName(
        lost.select(F.lit("orphan_decision").alias("kind"), F.col("request_id").alias("id")))


# ---- H ---------------------------------------------------------------------------------------
@query("h1_orphan_report", " union all ".join(
    f"select '{c}' child, '{k}' column_name, '{p}' parent, (select count(*) from {c} x where x.{k} is not null and "
    f"not exists (select 1 from {p} y where y.{pk} = x.{k})) orphans" for c, k, p, pk in integrity.FOREIGN_KEYS))
def _(t):
    return integrity.orphan_report(t)


@query("h2_duplicate_report", " union all ".join(
    f"select '{table}' table_name, '{c}' column_name, cast({c} as varchar) \"value\", count(*) n from {table} "
    f"where {c} is not null group by {c} having count(*) > 1" for table, c in integrity.UNIQUE_KEYS))
def _(t):
    return integrity.duplicate_report(t)


def _quoted(values):
    return ", ".join(f"'{v}'" for v in values)


@query("h3_domain_report", f"""
select 'users' table_name, 'role' column_name, role "value", count(*) n from users where role not in ({_quoted(ROLES)}) group by role
union all select 'verification_requests', 'status', status, count(*) from verification_requests where status not in ({_quoted(STATUSES)}) group by status
union all select 'passkeys', 'device_type', device_type, count(*) from passkeys where device_type not in ({_quoted(DEVICE_TYPES)}) group by device_type
union all select 'passkeys', 'counter', cast(counter as varchar), count(*) from passkeys where not counter >= 0 group by counter
union all select 'passkey_challenges', 'purpose', purpose, count(*) from passkey_challenges where purpose not in ({_quoted(PURPOSES)}) group by purpose""")
def _(t):
    return integrity.domain_report([
        ("users", "role", t.users, ROLES), ("verification_requests", "status", t.verification_requests, STATUSES),
        ("passkeys", "device_type", t.passkeys, DEVICE_TYPES), ("passkeys", "counter", t.passkeys, F.col("counter") >= 0),
        ("passkey_challenges", "purpose", t.passkey_challenges, PURPOSES)])


@query("h5_range_assertion", """
select bool_and(face_match_score between 0 and 100) face_match_score_ok, bool_and(liveness_score between 0 and 1) liveness_score_ok,
       bool_and(ocr_confidence_score between 0 and 1) ocr_confidence_score_ok, bool_and(blur_score >= 0) blur_score_ok,
       bool_and(brightness_score between 0 and 255) brightness_score_ok, bool_and(contrast_score between 0 and 127.5) contrast_score_ok,
       count(*) n from verification_scores""")
def _(t):
    return integrity.range_assertion(t.verification_scores)
