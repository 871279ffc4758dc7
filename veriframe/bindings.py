"""Domain tables derived from the generated star-schema tables.

Each binding is one SQL text that runs unchanged in Spark SQL and in the checking database.
``{name}`` refers to a raw table or to another binding.
"""

from __future__ import annotations

import re

RAW_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Clocks of the two bound worlds (requests and events), passed to every time-dependent job.
REQUEST_NOW = "2001-07-31 12:00:00"
EVENT_NOW = "2024-01-30 12:00:00"
DOCUMENT_TODAY = "2026-01-15"

_WEIGHTS = (7, 3, 1)


def _check_sql(field, length):
    """SQL for the 7-3-1 check digit of a digit string (used only to make well-formed test zones)."""
    terms = [
        f"{_WEIGHTS[i % 3]} * instr('123456789', substr({field}, {i + 1}, 1))" for i in range(length)
    ]
    return "cast((" + " + ".join(terms) + ") % 10 as string)"


_LETTERS = "translate(cast(c_custkey as string), '0123456789', 'ABCDEFGHIJ')"

BINDINGS = {
    "users": """
        select concat('user_', cast(c_custkey as string)) user_id,
               concat('a', cast(c_custkey as string),
                      case when c_custkey % 9 = 0 then '@mailinator.com'
                           when c_custkey % 9 = 1 then '@x.yopmail.com'
                           when c_custkey % 211 = 5 then '' else '@example.org' end) email,
               case when c_custkey % 97 = 0 then 'admin' when c_custkey % 389 = 7 then 'owner'
                    else 'agent' end as role
        from {customer}
        union all
        select concat('staff_', cast(s_suppkey as string)), concat('s', cast(s_suppkey as string), '@example.org'),
               'admin'
        from {supplier}""",
    "agents": f"""
        select cast(c_custkey as bigint) agent_id, concat('user_', cast(c_custkey as string)) user_id,
               concat(c_mktsegment, ' ', {_LETTERS}) full_name,
               case when c_custkey % 13 = 4 then ' ' else concat('+2547', cast(c_custkey as string)) end phone_number,
               cast(c_custkey % 1400 as string) national_id,
               case when c_custkey % 17 = 3 then cast(null as date)
                    else make_date(cast(1950 + c_custkey % 50 as int), cast(1 + c_custkey % 12 as int),
                                   cast(1 + c_custkey % 28 as int)) end date_of_birth,
               concat('a', cast(c_custkey as string),
                      case when c_custkey % 9 = 0 then '@mailinator.com'
                           when c_custkey % 9 = 1 then '@x.yopmail.com' else '@example.org' end) email,
               timestamp '1994-01-01 00:00:00' + (c_custkey * 7919 % 2500) * interval '1' hour created_at
        from {{customer}}""",
    "verification_requests": """
        select o_orderkey request_id, o_custkey agent_id, o_orderkey document_id,
               case when o_orderstatus = 'O' then 'pending' when o_orderstatus = 'P' then 'review'
                    when o_orderkey % 2 = 0 then 'verified' else 'rejected' end status,
               cast(o_orderdate as timestamp) created_at
        from {orders}""",
    "verification_scores": """
        select o_orderkey request_id,
               (o_orderkey * 3700 + 1300) % 10001 / 100.0e0 face_match_score,
               (o_orderkey * 5303) % 10001 / 10000.0e0 liveness_score,
               (o_orderkey * 7109) % 10001 / 10000.0e0 ocr_confidence_score,
               (o_orderkey * 6131) % 30001 / 100.0e0 blur_score,
               (o_orderkey * 9109) % 25501 / 100.0e0 brightness_score,
               (o_orderkey * 2909) % 12751 / 100.0e0 contrast_score
        from {orders}""",
    "score_bodies": """
        select o_orderkey request_id, case when o_orderkey % 41 = 0 then '[1, 2]' else concat('{',
               case o_orderkey % 9 when 0 then '"faceMatchScore":' when 1 then '"faceMatchScore":1,"face_match_score":'
                    else '"face_match_score":' end, cast((o_orderkey * 37) % 1201 / 10e0 as string),
               ',"liveness_score":', case o_orderkey % 11 when 0 then 'null' when 1 then 'true' when 2 then '"0.8"'
                    when 3 then '-0.5' else cast((o_orderkey * 53) % 110 / 100e0 as string) end,
               case when o_orderkey % 13 = 0 then '' else concat(',"ocrConfidenceScore":', cast(o_orderkey % 2 as string)) end,
               ',"blur_score":', cast(o_orderkey % 2000 as string), ',"brightness_score":', cast(o_orderkey % 260 as string),
               ',"contrastScore":', cast((o_orderkey % 260) / 2e0 as string),
               case when o_orderkey % 17 = 0 then ',"zeta":1,"alpha":2' else '' end, '}') end body
        from {orders}""",
    "admin_overrides": """
        select request_id, agent_id, case when request_id % 2 = 0 then 'approve' else 'reject' end verdict,
               concat('user_', cast(request_id % 50 as string)) admin_id,
               case when request_id % 3 = 0 then 'Documents look altered' end reason
        from {verification_requests} where status = 'review'""",
    "kyc_decisions": """
        select request_id decision_id, request_id,
               case when request_id % 41 = 0 then 'review' else status end final_decision,
               case when request_id % 41 = 0 then 0e0 when request_id % 37 = 0 then 0.2e0
                    when status = 'verified' then 1e0 else 0e0 end verified_probability,
               case when request_id % 41 = 0 then 1e0 when request_id % 37 = 0 then 0.7e0
                    when status = 'review' then 1e0 else 0e0 end review_probability,
               case when request_id % 41 = 0 then 0e0 when request_id % 37 = 0 then 0.1e0
                    when status = 'rejected' then 1e0 else 0e0 end rejected_probability,
               case when request_id % 5 = 0 then 'placeholder_threshold' when request_id % 29 = 1 then null
                    when request_id % 31 = 2 then 'image_quality_failure' else 'svm_model' end decision_basis,
               created_at + interval '37' minute + (request_id * 7 % 1440) * interval '1' minute decided_at
        from {verification_requests} where status <> 'pending' and request_id % 53 <> 0
        union all
        select -1 - o_orderkey, -1 - o_orderkey, 'rejected', 0e0, 0e0, 1e0, 'svm_model', cast(o_orderdate as timestamp)
        from {orders} where o_orderkey % 199 = 0""",
    "access_control_records": """
        select request_id record_id, agent_id, request_id decision_id, status = 'verified' access_granted,
               created_at + interval '40' minute + (request_id * 11 % 1440) * interval '1' minute enforced_at
        from {verification_requests} where status <> 'pending' and request_id % 47 <> 0""",
    "agent_documents": """
        select o_orderkey document_id, o_custkey agent_id,
               case o_orderkey % 7 when 0 then 'id_front' when 1 then 'id_back' when 2 then 'passport'
                    when 3 then 'selfie' when 4 then 'drivers_licence' when 5 then 'national_id'
                    else 'utility_bill' end document_type,
               case o_orderkey % 10
                    when 0 then concat('https://x.example.org/storage/v1/object/public/agent-documents/',
                                       cast(o_custkey as string), '/documents/id%20', cast(o_orderkey as string), '.jpg')
                    when 1 then concat('https://x.example.org/storage/v1/object/sign/agent-documents/',
                                       cast(o_custkey as string), '/selfies/s', cast(o_orderkey as string), '.png?token=abc')
                    when 2 then concat(cast(o_custkey as string), '/../', cast(o_orderkey as string), '.jpg')
                    when 3 then concat(cast(o_custkey + 1 as string), '/documents/', cast(o_orderkey as string), '.jpg')
                    when 4 then ''
                    when 5 then concat('https://cdn.example.org/agent-documents/', cast(o_custkey as string),
                                       '/documents/c', cast(o_orderkey as string), '.jpg?v=1')
                    when 6 then cast(null as string)
                    else concat(cast(o_custkey as string), '/documents/d', cast(o_orderkey as string), '.jpg') end file_url,
               cast(o_orderdate as timestamp) + (o_orderkey * 5 % 2880 - 720) * interval '1' minute uploaded_at
        from {orders}""",
    "stored_files": """
        select o_custkey agent_id,
               case when o_orderkey % 3 = 0 then 'selfies' when o_orderkey % 11 = 1 then 'exports'
                    else 'documents' end folder,
               concat('old', cast(o_orderkey as string), '.jpg') file_name,
               case when o_orderkey % 19 = 0 then null
                    else cast(o_orderdate as timestamp) + (o_orderkey * 13 % 2880 - 720) * interval '1' minute end modified_at
        from {orders}""",
    "audit_logs": """
        select event_id log_id, case when event_id % 83 = 0 then null else user_id end agent_id,
               cast(floor(event_id / 8e0) as bigint) request_id,
               case event_type
                    when 'signup' then case event_id % 3 when 0 then 'AGENT_REGISTERED' when 1 then 'OCR_VERIFIED'
                                       else 'ADMIN_APPROVED' end
                    when 'view' then case event_id % 3 when 0 then 'DOCUMENTS_UPLOADED' when 1 then 'IMAGE_QUALITY_ASSESSED'
                                     else 'MANUAL_REVIEW_FLAGGED' end
                    when 'click' then case event_id % 3 when 0 then 'VERIFICATION_INITIATED' when 1 then 'FACE_MATCH_COMPLETED'
                                      else 'ACCESS_DENIED' end
                    when 'purchase' then case event_id % 3 when 0 then 'KYC_DECISION_MADE' when 1 then 'LIVENESS_DETECTED'
                                         else 'ACCESS_GRANTED' end
                    else 'FRAUD_GUARDRAIL_TRIGGERED' end action,
               case when event_type = 'error' then 'BLOCKED' when value < 20 then 'FAILED'
                    when value < 60 then 'SUCCESS' else 'PASSED' end outcome,
               case when event_id % 89 = 0 then null
                    when event_type = 'error' then concat('{"', case when event_id % 4 = 0 then 'guardrail' else 'guardrailType' end,
                         '":"', case event_id % 5 when 0 then 'blocked_email_domain' when 1 then 'ip_rate_limit'
                                else 'verification_strike' end,
                         '","', case when event_id % 2 = 0 then 'attemptCount' else 'failureCount' end, '":',
                         cast(event_id % 4 as string), ',"ipAddress":"10.9.9.', cast(user_id % 5 as string),
                         '","deviceFingerprint":"fpd_', cast(user_id % 3 as string), '"}')
                    when event_type = 'signup' and event_id % 3 = 1 then concat('{"confidenceScore":0.',
                         cast(10 + event_id % 90 as string), ',"extractedName":"NAME ', cast(user_id as string),
                         '","idMatch":', case when event_id % 2 = 0 then 'true' else 'false' end,
                         case when event_id % 4 = 1 then ',"registeredName":"Registered Name"' else '' end,
                         case when event_id % 5 = 1 then ',"extractedDOB":null' else ',"extractedDOB":"01.02.1990"' end, '}')
                    when event_type = 'signup' and event_id % 3 = 2 then concat('{"strikesReset":',
                         case when event_id % 2 = 0 then 'true' else 'false' end, ',"previousStrikeCount":2}')
                    when event_type = 'view' and event_id % 3 = 0 then concat('{"documentFrontSource":',
                         case event_id % 4 when 0 then '"camera"' when 1 then '"upload"' else 'null' end,
                         ',"documentBackSource":', case event_id % 5 when 0 then '"upload"' else '"camera"' end,
                         ',"primaryPath":', case when event_id % 7 = 0 then 'null' else '"p.jpg"' end,
                         ',"backPath":', case when event_id % 3 = 0 then 'null' else '"b.jpg"' end, '}')
                    when event_type = 'purchase' and event_id % 3 = 0 then concat('{"svmFallback":',
                         case when event_id % 2 = 0 then 'true' else 'false' end, ',"decision":"review"}')
                    else props end details,
               case event_id % 6 when 0 then null when 1 then 'system' when 2 then concat('user_', cast(user_id as string))
                    when 3 then concat('staff_', cast(event_id % 7 as string)) when 4 then 'ghost'
                    else concat('user_', cast(user_id + 1 as string)) end performed_by,
               case when event_id % 23 = 0 then null
                    else concat('10.0.', cast(user_id % 7 as string), '.', cast(event_id % 13 as string)) end ip_address,
               case when event_id % 19 = 0 then null else concat('fp_', cast(event_id % 101 as string)) end device_fingerprint,
               cast(ts as timestamp) ts
        from {events}""",
    "registrations": """
        select agent_id, email, case when agent_id % 3 = 0 then concat(' ', national_id, ' ') else national_id end national_id,
               case when agent_id % 7 = 0 then null
                    else concat('10.0.', cast(agent_id % 7 as string), '.', cast(agent_id % 13 as string)) end ip_address,
               case when agent_id % 8 = 0 then null else concat('fp_', cast(agent_id % 101 as string)) end device_fingerprint,
               case when agent_id % 4 = 0 then concat('10.1.', cast(agent_id % 9 as string), '.1, 10.2.0.1')
                    when agent_id % 4 = 1 then concat(' 10.3.', cast(agent_id % 9 as string), '.1')
                    when agent_id % 4 = 2 then ' ' else null end forwarded_for,
               concat('192.168.0.', cast(agent_id % 250 as string)) remote_address,
               case agent_id % 8 when 0 then null when 1 then '1990-13-01' when 2 then '2015-06-01' when 3 then '1850-01-01'
                    when 4 then '01/02/1990' when 5 then '2030-01-01'
                    else concat(cast(1950 + agent_id % 50 as string), '-0', cast(1 + agent_id % 9 as string), '-11') end date_of_birth
        from {agents}""",
    "quality_measurements": """
        select o_orderkey request_id, o_custkey agent_id,
               case o_orderkey % 8 when 0 then 'national_id' when 1 then 'Passport' when 2 then 'drivers-licence'
                    when 3 then 'DL' when 4 then 'id front' when 5 then 'unknown' when 6 then null else 'passport' end document_kind,
               o_orderkey % 3 <> 0 document_found,
               (o_orderkey * 4001) % 9001 / 100.0e0 document_blur,
               20e0 + (o_orderkey * 877) % 24001 / 100.0e0 document_brightness,
               5e0 + (o_orderkey * 613) % 9001 / 100.0e0 document_contrast,
               0.5e0 + (o_orderkey * 389) % 5001 / 100.0e0 selfie_blur,
               5e0 + (o_orderkey * 521) % 25001 / 100.0e0 selfie_brightness,
               0.5e0 + (o_orderkey * 271) % 6001 / 100.0e0 selfie_contrast
        from {orders}""",
    "model_predictions": """
        select o_orderkey request_id, o_orderkey % 6 <> 0 available,
               case when o_orderkey % 17 = 0 then 'placeholder_threshold' else 'svm_model' end decision_basis,
               case o_orderkey % 4 when 0 then 'verified' when 1 then 'review' when 2 then 'rejected'
                    else case when o_orderkey % 5 = 0 then 'unknown' else 'review' end end final_decision,
               case when o_orderkey % 13 = 0 then null else (o_orderkey % 11) / 40e0 end verified_probability,
               case when o_orderkey % 19 = 0 then 1.5e0 else (o_orderkey % 7) / 10e0 end review_probability,
               1e0 - (o_orderkey % 11) / 40e0 - (o_orderkey % 7) / 10e0
                 + case when o_orderkey % 23 = 0 then 0.01e0 else 0e0 end rejected_probability,
               '3.1.1' model_version
        from {orders}""",
    "pipeline_results": """
        select o_orderkey request_id,
               o_orderkey % 9 = 0 needs_retake, o_orderkey % 7 = 0 needs_manual_review, o_orderkey % 4 <> 0 ocr_matched,
               o_orderkey % 10 <> 0 document_face_detected, o_orderkey % 14 <> 0 selfie_face_detected,
               case o_orderkey % 5 when 0 then null when 1 then 'passport' else 'id_v2_surname_given' end document_type,
               o_orderkey % 12 = 5 document_expired,
               case when o_orderkey % 12 = 5 then '01.01.2020' when o_orderkey % 3 = 0 then null else '31.12.2030' end extracted_expiry,
               case when o_orderkey % 8 = 1 then null else concat('NAME ', cast(o_custkey as string)) end extracted_name,
               case when o_orderkey % 11 = 1 then null else concat('ID', cast(o_custkey as string)) end extracted_id_number,
               case when o_orderkey % 13 = 1 then null else '01.02.1990' end extracted_dob,
               o_orderkey % 6 <> 1 name_match, o_orderkey % 10 <> 3 id_match, o_orderkey % 15 <> 2 dob_match,
               case o_orderkey % 9 when 1 then false when 2 then null else true end front_back_match,
               o_orderkey % 21 = 0 low_resolution,
               case when o_orderkey % 4 = 0 then 'Text could not be confirmed' end reject_reason,
               case when o_orderkey % 33 = 0 then 'Document: No face detected' end face_error,
               case when o_orderkey % 44 = 0 then 'timeout' end liveness_error,
               cast(o_orderkey % 5 as int) strike_count
        from {orders}""",
    "labelled_scores": """
        select s.*, case r.status when 'verified' then 'Verified' when 'review' then 'Manual Review' else 'Rejected' end target
        from {verification_scores} s join {verification_requests} r on r.request_id = s.request_id
        where r.status <> 'pending'""",
    "class_probabilities": """
        select request_id, target, candidate,
               a / cast(a + b + c as double) p_verified, b / cast(a + b + c as double) p_review,
               c / cast(a + b + c as double) p_rejected, native_label
        from (select request_id, target, candidate,
                     (request_id * 37 + shift) % 97 + case when target = 'Verified' then boost else 1 end a,
                     (request_id * 53 + shift) % 89 + case when target = 'Manual Review' then boost else 1 end b,
                     (request_id * 71 + shift) % 83 + case when target = 'Rejected' then boost else 1 end c,
                     case when request_id % (2 + shift % 5) = 0 then 'Rejected' else target end native_label
              from {labelled_scores}
              cross join (values ('raw_native_sigmoid', 0, 40), ('raw_native_isotonic', 11, 60),
                                 ('power_native_sigmoid', 23, 50)) as v(candidate, shift, boost)) x""",
    "face_pairs": """
        select a.vec_id vec_a, b.vec_id vec_b, case when a.label = b.label then 'genuine' else 'impostor' end pair_type
        from {embeddings} a join {embeddings} b on b.vec_id = a.vec_id + 1
        union all
        select vec_id, -1, 'genuine' from {embeddings} where vec_id % 50 = 0""",
    "passkeys": """
        select cast(c_custkey as bigint) id, concat('user_', cast(floor(c_custkey / 2e0) as bigint)) user_id,
               concat('cred_', cast(case when c_custkey % 151 = 3 then c_custkey - 1 else c_custkey end as string)) credential_id,
               c_custkey % 40 - case when c_custkey % 301 = 8 then 60 else 0 end counter,
               case when c_custkey % 77 = 5 then 'other' when c_custkey % 2 = 0 then 'singleDevice' else 'multiDevice' end device_type,
               case when c_custkey % 3 = 0 then '["internal"]' else '["usb","nfc"]' end transports
        from {customer} where c_custkey % 7 <> 1""",
    "login_methods": """
        select concat('user_', cast(c_custkey as string)) user_id,
               case when c_custkey % 3 = 0 then 'x' else '' end encrypted_password, c_custkey % 5 = 0 has_identity
        from {customer}""",
    "passkey_removals": """
        select cast(c_custkey as bigint) removal_id,
               concat('user_', cast(floor((c_custkey + case when c_custkey % 10 = 0 then 5 else 0 end) / 2e0) as bigint)) owner_id,
               cast(c_custkey as bigint) passkey_id
        from {customer}""",
    "passkey_hits": """
        select event_id hit_id, concat('bucket_', cast(user_id % 5 as string)) bucket,
               timestamp '2024-01-01 00:00:00' + (event_id * 13) * interval '1' second ts
        from {events}""",
    "passkey_challenges": """
        select event_id id, case when event_id % 157 = 4 then 'other' when event_id % 3 = 0 then 'register' else 'login' end purpose,
               case when event_id % 3 = 0 then concat('user_', cast(user_id as string)) end user_id,
               cast(ts as timestamp) + interval '5' minute expires_at
        from {events} where event_type in ('signup', 'click')""",
    "challenge_uses": """
        select event_id * 10 + attempt use_id, event_id challenge_id,
               case when event_id % 11 = 0 then 'login' when event_id % 3 = 0 then 'register' else 'login' end purpose,
               case when event_id % 3 = 0 then concat('user_', cast(user_id + case when event_id % 14 = 0 then 1 else 0 end as string)) end user_id,
               cast(ts as timestamp) + (event_id * 7 % 400) * interval '1' second + attempt * interval '2' second used_at
        from {events} cross join (values (0), (1), (2)) as v(attempt)
        where event_type in ('signup', 'click', 'view') and event_id % 4 >= attempt""",
    "credential_uses": """
        select event_id use_id, user_id passkey_id,
               case when event_id % 9 = 0 then 0 else cast(floor(event_id / 50e0) as bigint) + event_id * 7 % 13 end new_counter,
               cast(ts as timestamp) ts
        from {events} where event_type <> 'error'""",
    "request_changes": """
        select event_id change_id, event_id % 400 request_id, user_id agent_id,
               case when event_type = 'signup' then 'pending' when event_type in ('view', 'error') then 'review'
                    when event_type = 'click' then 'verified' else 'rejected' end status,
               cast(ts as timestamp) changed_at
        from {events}""",
    "mixture_components": """
        select c_mktsegment component, cast(c_nationkey % 3 as int) klass, count(*) * 1e0 mass
        from {customer} group by 1, 2""",
    # ---- identity documents -------------------------------------------------------------------
    "identity_facts": f"""
        select y.*, {_check_sql('num9', 9)} num_chk, {_check_sql('dob6', 6)} dob_chk, {_check_sql('exp6', 6)} exp_chk
        from (select x.*, concat(yy, mm, dd) dob6, concat(ex_yy, ex_mm, ex_dd) exp6
        from (select cast(c_custkey as bigint) doc_id, c_custkey % 6 kind, c_mktsegment surname,
                     concat('KIPTOO ', {_LETTERS}) given,
                     cast(100000000 + c_custkey * 7919 % 800000000 as string) num9,
                     cast(50 + c_custkey % 50 as string) yy,
                     lpad(cast(1 + c_custkey % 12 as string), 2, '0') mm, lpad(cast(1 + c_custkey % 28 as string), 2, '0') dd,
                     cast(24 + c_custkey % 11 as string) ex_yy,
                     lpad(cast(1 + c_custkey % 7 as string), 2, '0') ex_mm, lpad(cast(1 + c_custkey % 27 as string), 2, '0') ex_dd
              from {{customer}}) x) y""",
    "mrz_items": """
        select doc_id, read_no, line_no,
               case when doc_id % 23 = 0 and line_no = 1 then concat(' ', substr(lower(line), 1, 5), ' ', substr(line, 6)) else line end text,
               500e0 + 30 * line_no y
        from (
          select doc_id, read_no, 1 line_no, concat('ID', case when doc_id % 19 = 0 then 'KYA' else 'KEN' end,
                   case when doc_id % 11 = 0 then translate(num9, '15', 'IS') else num9 end,
                   case when (doc_id + read_no) % 13 = 0 then '7' else num_chk end, '<<<<<<<<<<<<<<<') line
          from {identity_facts} cross join (values (0), (1)) as w(read_no) where kind in (0, 4)
          union all
          select doc_id, read_no, 2, concat(case when (doc_id + read_no) % 17 = 0 then translate(dob6, '05', 'OS') else dob6 end, dob_chk,
                   case when doc_id % 2 = 0 then 'M' else 'F' end, exp6, case when (doc_id + read_no) % 29 = 0 then '0' else exp_chk end,
                   case when doc_id % 19 = 0 then '25<' else 'KEN' end,
                   case when doc_id % 19 = 0 then concat('<', substr(num9, 1, 8), '<') else '<<<<<<<<<<' end, '<0')
          from {identity_facts} cross join (values (0), (1)) as w(read_no) where kind in (0, 4)
          union all
          select doc_id, read_no, 3, rpad(case when doc_id % 14 = 0 then concat(surname, '<', replace(given, ' ', '<'))
                                               else concat(surname, '<<', replace(given, ' ', '<')) end, 30, '<')
          from {identity_facts} cross join (values (0), (1)) as w(read_no) where kind in (0, 4)
          union all
          select doc_id, read_no, 1, rpad(concat('P<KEN', surname, '<<', replace(given, ' ', '<')), 44, '<')
          from {identity_facts} cross join (values (0), (1)) as w(read_no) where kind = 1
          union all
          select doc_id, read_no, 2, concat(num9, case when (doc_id + read_no) % 13 = 0 then 'X' else num_chk end, 'KEN', dob6, dob_chk, 'F', exp6, exp_chk,
                                            '<<<<<<<<<<<<<<', '00')
          from {identity_facts} cross join (values (0), (1)) as w(read_no) where kind = 1
          union all
          select doc_id, read_no, line_no, case when line_no = 4 then 'REPUBLIC OF SOMEWHERE' else 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789' end
          from {identity_facts} cross join (values (4), (5)) as v(line_no) cross join (values (0), (1)) as w(read_no)
          where line_no = 4 or kind = 2) x
        where not (doc_id % 31 = 0 and line_no = 1)""",
    "ocr_items": """
        select doc_id, side, item_no, text,
               case when (doc_id * 13 + item_no * 7) % 61 = 0 then 0.35e0 else 0.5e0 + (doc_id * 7 + item_no) % 50 / 100e0 end confidence,
               x_min, x_max, y_min, y_max
        from (
          select doc_id, 'front' side, field_no * 2 + part item_no,
                 case when part = 0 then case when doc_id % 7 = 3 and value <> '' then concat(label, ': ', value) else label end
                      when doc_id % 7 = 3 then '' else value end text,
                 case when part = 0 or doc_id % 2 = 0 then 10e0 else 130e0 end x_min,
                 case when part = 0 then 110e0 when doc_id % 2 = 0 then 150e0 else 300e0 end x_max,
                 case when part = 1 and doc_id % 2 = 0 then field_no * 60e0 + 22 else field_no * 60e0 end y_min,
                 case when part = 1 and doc_id % 2 = 0 then field_no * 60e0 + 40 else field_no * 60e0 + 20 end y_max
          from (select doc_id, field_no, part,
                  case field_no
                    when 0 then case kind when 0 then 'REPUBLIC OF KENYA' when 1 then 'PASSPORT' when 2 then 'JAMHURI YA KENYA'
                                     when 3 then 'DRIVING LICENCE' when 4 then 'NATI0NAL IDENTIY CARD' else 'LIBRARY CARD' end
                    when 1 then case kind when 2 then 'FULL NAMES' when 4 then '' when 5 then '' else 'SURNAME' end
                    when 2 then case kind when 0 then 'GIVEN NAMES' when 1 then 'GIVEN NAME' when 3 then 'OTHER NAMES' else '' end
                    when 3 then case kind when 0 then 'ID NUMBER' when 1 then 'PASSPORT NO' when 2 then 'ID NO'
                                     when 3 then 'NATIONAL ID N0' else '' end
                    when 4 then case when kind in (4, 5) then '' when doc_id % 12 = 7 then '' else 'DATE OF BIRTH' end
                    else case when kind in (2, 4, 5) then '' else 'DATE OF EXPIRY' end end label,
                  case field_no
                    when 0 then ''
                    when 1 then case kind when 2 then concat(surname, ' ', given) else surname end
                    when 2 then case when kind in (0, 1, 3, 4) then given else '' end
                    when 3 then case when doc_id % 10 = 9 then concat('KEN-', num9) else num9 end
                    when 4 then case when doc_id % 16 = 5 then concat(dd, ' / ', mm, ' / 19', yy) when doc_id % 16 = 6 then concat('32.', mm, '.19', yy)
                                     else concat(dd, '.', mm, '.19', yy) end
                    else case when kind in (2, 4, 5) then '' else concat(ex_dd, '.', ex_mm, '.20', ex_yy) end end value
                from {identity_facts} cross join (values (0), (1), (2), (3), (4), (5)) as v(field_no)
                     cross join (values (0), (1)) as w(part)) a
          union all
          select doc_id, 'back', part,
                 case when part = 0 then 'ID NUMBER' when doc_id % 15 = 4 then concat('9', substr(num9, 2)) when doc_id % 15 = 5 then ''
                      when doc_id % 3 = 0 then concat('KEN', num9, '4') else num9 end,
                 case when part = 0 then 10e0 else 120e0 end, case when part = 0 then 100e0 else 250e0 end, 10e0, 30e0
          from {identity_facts} cross join (values (0), (1)) as w(part) where kind in (0, 2, 4)
          union all
          select doc_id, case when line_no > 3 or doc_id % 6 = 1 then 'front' else 'back' end, 20 + line_no, text, 10e0, 400e0, y, y + 20
          from {mrz_items} where read_no = 0 and line_no <= 3) z
        where text <> ''""",
    "registered_identities": """
        select doc_id,
               case doc_id % 8 when 0 then concat(lower(given), ' ', surname) when 1 then given when 2 then surname
                    when 3 then '' when 4 then concat(surname, '-', given) when 5 then concat('Peter ', surname)
                    else concat(surname, ' ', given) end name,
               case when doc_id % 9 = 4 then concat('9', substr(num9, 2)) when doc_id % 9 = 5 then concat(substr(num9, 1, 3), '-', substr(num9, 4))
                    when doc_id % 9 = 6 then null else num9 end id_number,
               case doc_id % 7 when 0 then concat(dd, '/', mm, '/19', yy) when 1 then 'unknown' when 2 then null
                    else concat('19', yy, '-', mm, '-', dd) end date_of_birth
        from {identity_facts}""",
    "id_readings": """
        select doc_id, reading_no, value from (
          select doc_id, reading_no,
                 case reading_no when 0 then num9 when 1 then case when doc_id % 4 = 0 then translate(num9, '1', '7') else num9 end
                      when 2 then case when doc_id % 5 = 0 then translate(num9, '0', '8') else concat(substr(num9, 1, 4), '-', substr(num9, 5)) end
                      else case when doc_id % 3 = 0 then 'AB12' else null end end value
          from {identity_facts} cross join (values (0), (1), (2), (3)) as v(reading_no)) x
        where value is not null""",
    "raw_records": """
        select doc_id, case kind when 0 then 'id_v2_surname_given' when 1 then 'passport' when 2 then 'id_v1_full_name' when 3 then 'drivers_licence'
                            when 4 then 'id_v2_surname_given' else 'id_back' end document_type,
               case when kind in (0, 1, 3, 4) and doc_id % 11 <> 3 then surname end surname,
               case when kind in (0, 1, 4) and doc_id % 13 <> 3 then given end given_names,
               case when kind = 3 then given end other_names, case when kind = 2 then concat(surname, ' ', given) end full_names,
               case when kind <> 1 and doc_id % 17 <> 3 then concat(substr(num9, 1, 3), ' ', substr(num9, 4)) end id_number,
               case when kind = 1 then lower(concat('ak', num9)) end passport_no,
               case when doc_id % 19 = 3 then '31.02.1990' when doc_id % 23 = 3 then '01.01.2031' when doc_id % 29 = 3 then '01.01.1890' when doc_id % 31 = 3 then ' '
                    else concat(dd, '.', mm, '.19', yy) end date_of_birth,
               case when kind = 2 or doc_id % 9 = 2 then null else concat(ex_dd, '.', ex_mm, '.20', ex_yy) end date_of_expiry
        from {identity_facts}""",
    "back_records": """
        select doc_id, case doc_id % 6 when 0 then concat('KEN', num9, '4') when 1 then concat('9', substr(num9, 2)) when 2 then null
                       when 3 then substr(num9, 2) else num9 end id_number
        from {identity_facts} where kind in (0, 2, 4)""",
    "zone_records": """
        select doc_id, case when doc_id % 7 = 0 then null when doc_id % 5 = 0 then concat(substr(num9, 1, 8), '7') else num9 end document_number,
               doc_id % 4 <> 0 id_number_verified, case when doc_id % 8 = 1 then null else upper(surname) end surname,
               case when doc_id % 8 = 1 or doc_id % 8 = 2 then null else given end given_names, concat(surname, ' ', given) full_names,
               make_date(1900 + cast(yy as int), cast(mm as int), cast(dd as int)) date_of_birth,
               case when doc_id % 10 = 0 then cast(null as date) else make_date(2000 + cast(ex_yy as int), cast(ex_mm as int), cast(ex_dd as int)) end date_of_expiry
        from {identity_facts} where doc_id % 3 <> 2""",
    "text_fields": """
        select i.doc_id, i.item_no, i.text read_text, f.num9 true_text
        from {ocr_items} i join {identity_facts} f on f.doc_id = i.doc_id where i.side = 'front'""",
}

_REF = re.compile(r"\{(\w+)\}")


def _ordered_names(sql):
    """Bound tables needed by ``sql``, parents first."""
    found = []

    def visit(name):
        if name in found or name not in BINDINGS:
            return
        for parent in _REF.findall(BINDINGS[name]):
            visit(parent)
        found.append(name)

    for name in BINDINGS:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    return found


def with_bindings(sql):
    """Prefix checking SQL with the bound tables it uses."""
    names = _ordered_names(sql)
    parts = [f"{name} as ({_REF.sub(lambda m: m.group(1), BINDINGS[name])})" for name in names]
    body = sql.strip()
    recursive = body.lower().startswith("with recursive")
    if body.lower().startswith("with"):
        body = body[len("with recursive"):] if recursive else body[len("with"):]
        head = ",\n".join(parts) + (",\n" if parts else "")
    else:
        head = ",\n".join(parts)
        return f"with {head}\n{body}" if parts else body
    return f"with {'recursive ' if recursive else ''}{head}{body}"


DEALT = {"identity_facts": "doc_id"}  # small tables that others are expanded from


class BoundTables:
    """Attribute access to raw tables and bindings as DataFrames of one data folder.

    Raw tables named in ``streams`` are read as file streams, and bindings over them are streams too.
    """

    def __init__(self, spark, sf_dir, streams=()):
        self.spark = spark
        self.sf_dir = sf_dir
        self.streams = streams
        self._cache = {}

    def path(self, name):
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name):
        if name in RAW_TABLES:
            return self._cached(name, lambda: self._read(name))
        if name in BINDINGS:
            return self._cached(name, lambda: self._bind(name))
        raise AttributeError(name)

    def _read(self, name):
        if name in self.streams:
            schema = self.spark.read.parquet(self.path(name)).schema
            # a pattern matches one file as well as a folder of files
            return self.spark.readStream.schema(schema).parquet(self.path(name)[:-1] + "[t]")
        return self.spark.read.parquet(self.path(name))

    def _cached(self, name, make):
        if name not in self._cache:
            self._cache[name] = make()
        return self._cache[name]

    def _bind(self, name):
        sql = BINDINGS[name]
        parents = {parent: getattr(self, parent) for parent in dict.fromkeys(_REF.findall(sql))}
        pieces = _REF.split(sql)
        pieces[::2] = [piece.replace("{", "{{").replace("}", "}}") for piece in pieces[::2]]
        pieces[1::2] = ["{" + parent + "}" for parent in pieces[1::2]]
        rows = self.spark.sql("".join(pieces), **parents)
        return self._dealt(rows, DEALT[name]) if name in DEALT and not self.streams else rows

    def _dealt(self, rows, key):
        """Rows of few file parts dealt by a key over all cores, as each of them is expanded into many more."""
        wanted = 2 * self.spark.sparkContext.defaultParallelism
        return rows if rows.rdd.getNumPartitions() >= wanted else rows.repartition(wanted, key)
