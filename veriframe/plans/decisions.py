"""Registered queries: score contract, decision rules, feedback (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.bindings import REQUEST_NOW
from veriframe.functions import feedback as fb
from veriframe.functions import quality as q
from veriframe.functions.scores import with_json_score_errors
from veriframe.operators import decisions as d
from veriframe.registry import query
from veriframe.schemas import FEATURE_ALIASES, FEATURE_BOUNDS, FEATURES


def joined(column, separator=" | "):
    return F.array_join(column, separator)


def js(column):
    """Checking SQL for a number printed without a trailing .0."""
    return f"regexp_replace(cast({column} as varchar), '\\.0$', '')"


DECISION_SQL = """
case when face_match_score < 50 or liveness_score < 0.5 or ocr_confidence_score < 0.4
       or (blur_score < 80 and face_match_score < 65) then 'rejected'
     when face_match_score > 80 and liveness_score > 0.75 and ocr_confidence_score > 0.7 then 'verified'
     else 'review' end"""


def _above(column, limit, label, shown):
    return (f"concat('{label} ', {js(column)}, case when {column} > {limit} then ' is above {shown}' "
            f"else ' is not above {shown}' end)")


_CHECKS = ", ".join([
    _above("face_match_score", 80, "Face match score", "80.0"), _above("liveness_score", 0.75, "Liveness score", "0.75"),
    _above("ocr_confidence_score", 0.7, "OCR confidence", "0.70")])
REASONS_SQL = f"""
case when {DECISION_SQL} = 'rejected' then concat_ws(' | ',
       case when face_match_score < 50 then concat('Face match score ', {js('face_match_score')}, ' is below 50.0') end,
       case when liveness_score < 0.5 then concat('Liveness score ', {js('liveness_score')}, ' is below 0.50') end,
       case when ocr_confidence_score < 0.4 then concat('OCR confidence ', {js('ocr_confidence_score')}, ' is below 0.40') end,
       case when blur_score < 80 and face_match_score < 65 then concat('Blur score ', {js('blur_score')},
            ' is below 80.0 and face match ', {js('face_match_score')}, ' is below 65.0') end)
     when {DECISION_SQL} = 'verified' then concat_ws(' | ', {_CHECKS})
     else concat_ws(' | ', {_CHECKS}, 'Scores fall between rejection and verification thresholds') end"""


def _json_check(name, alias, low, high):
    field = f"coalesce(json_extract(body, '$.{name}'), json_extract(body, '$.{alias}'))"
    top = "infinity" if high is None else high
    outside = f"cast({field} as double) < {low}" + ("" if high is None else f" or cast({field} as double) > {high}")
    return f"""case when not is_obj then null
        when json_exists(body, '$.{name}') and json_exists(body, '$.{alias}') then 'Provide only one of {name} and {alias}'
        when {field} is null or json_type({field}) = 'NULL' then '{name} is required'
        when json_type({field}) not in ('UBIGINT', 'BIGINT', 'DOUBLE') then '{name} must be a number'
        when {outside} then '{name} must be in [{low}, {top}]' end"""


_KNOWN = ", ".join(f"'{n}'" for n in FEATURES + FEATURE_ALIASES)


@query("d1_score_validation", f"""
select request_id, concat_ws(' | ', case when not is_obj then 'Request body must be a JSON object' end,
   case when is_obj and len(list_filter(json_keys(body), lambda k: k not in ({_KNOWN}))) > 0 then concat('Unknown score fields: ',
        array_to_string(list_sort(list_filter(json_keys(body), lambda k: k not in ({_KNOWN}))), ', ')) end,
   {", ".join(_json_check(n, a, lo, hi) for n, a, (lo, hi) in zip(FEATURES, FEATURE_ALIASES, FEATURE_BOUNDS))}) errors
from (select *, json_type(body) = 'OBJECT' is_obj from score_bodies)""")
def _(t):
    return with_json_score_errors(t.score_bodies).select("request_id", joined("errors").alias("errors"))


@query("d1_stored_score_validation", """
select request_id, case when face_match_score < 0 or face_match_score > 100 then 'face_match_score must be in [0, 100]' else '' end errors
from verification_scores""")
def _(t):
    return d.validate_scores(t.verification_scores).select("request_id", joined("errors").alias("errors"))


@query("d2_threshold_decision", f"""
select request_id, final_decision, (final_decision = 'verified')::double verified_probability, (final_decision = 'review')::double review_probability,
       (final_decision = 'rejected')::double rejected_probability, 'placeholder_threshold' decision_basis, reasons
from (select request_id, {DECISION_SQL} final_decision, {REASONS_SQL} reasons from verification_scores)""")
def _(t):
    rows = d.decide_by_threshold(t.verification_scores)
    return rows.select("request_id", "final_decision", "verified_probability", "review_probability", "rejected_probability",
                       "decision_basis", joined("reasons").alias("reasons"))


_MODEL_OK = """
coalesce(m.available and m.decision_basis = 'svm_model' and m.final_decision in ('verified', 'review', 'rejected')
  and m.verified_probability between 0 and 1 and m.review_probability between 0 and 1 and m.rejected_probability between 0 and 1
  and abs(m.verified_probability + m.review_probability + m.rejected_probability - 1) < 1e-5, false)"""
_MODEL_FIRST = f"""
decided as (select s.*, {DECISION_SQL.replace(chr(10), ' ')} t_decision, {REASONS_SQL} t_reasons from verification_scores s),
chosen as (select t.request_id, {_MODEL_OK} is_model, t_decision, t_reasons, m.* exclude (request_id) from decided t
           left join model_predictions m on m.request_id = t.request_id)"""


@query("d3_model_first_decision", f"""
with {_MODEL_FIRST}
select request_id, case when is_model then final_decision else t_decision end final_decision,
       case when is_model then verified_probability else (t_decision = 'verified')::double end verified_probability,
       case when is_model then rejected_probability else (t_decision = 'rejected')::double end rejected_probability,
       case when is_model then 'svm_model' else 'placeholder_threshold' end decision_basis,
       case when is_model then concat('SVM classifier v3.1.1 predicted ', case final_decision when 'verified' then 'Verified'
            when 'review' then 'Manual Review' else 'Rejected' end, ' with ', printf('%.1f', 100 * case final_decision when 'verified' then verified_probability
            when 'review' then review_probability else rejected_probability end), '% probability') else t_reasons end reasons
from chosen""")
def _(t):
    rows = d.decide_model_first(t.verification_scores, t.model_predictions)
    return rows.select("request_id", "final_decision", "verified_probability", "rejected_probability", "decision_basis",
                       joined("reasons").alias("reasons"))


@query("d3_fallback_audit", f"""
with {_MODEL_FIRST}
select request_id, 'KYC_DECISION_MADE' action, 'REVIEW' outcome,
       case when available then 'SVM returned an invalid prediction' else 'SVM unavailable' end reason
from chosen where not is_model""")
def _(t):
    rows = d.fallback_audit(d.decide_model_first(t.verification_scores, t.model_predictions))
    return rows.select("request_id", "action", "outcome", F.get_json_object("details", "$.reason").alias("reason"))


def _outcome(column, high, low):
    return f"case when {column} >= {high} then 'PASSED' when {column} >= {low} then 'BORDERLINE' else 'FAILED' end"


@query("d4_step_outcomes", f"""
select request_id, {_outcome('ocr_confidence_score', 0.7, 0.4)} ocr_outcome, {_outcome('face_match_score', 80, 50)} face_outcome,
       {_outcome('liveness_score', 0.75, 0.5)} liveness_outcome from verification_scores""")
def _(t):
    return d.step_outcomes(t.verification_scores)


@query("d5_ocr_review_flag", f"""
select p.request_id, (needs_manual_review or (not ocr_matched and ocr_confidence_score < 0.4)) flagged,
       case when needs_retake then 'FAILED' else {_outcome('ocr_confidence_score', 0.7, 0.4)} end outcome,
       (needs_manual_review or (not ocr_matched and ocr_confidence_score < 0.4)) and not needs_retake moves_to_review
from pipeline_results p join verification_scores s on s.request_id = p.request_id""")
def _(t):
    flagged, outcome, moves = d.ocr_flags()
    return t.pipeline_results.join(t.verification_scores, "request_id").select(
        "request_id", flagged.alias("flagged"), outcome.alias("outcome"), moves.alias("moves_to_review"))


@query("d6_face_outcome", f"""
select p.request_id, case when document_face_detected and selfie_face_detected then face_match_score else 0 end score,
       concat_ws(',', case when not document_face_detected then 'document' end, case when not selfie_face_detected then 'selfie' end) missing,
       case when document_face_detected and selfie_face_detected then {_outcome('face_match_score', 80, 50)} else 'FAILED' end outcome
from pipeline_results p join verification_scores s on s.request_id = p.request_id""")
def _(t):
    score, missing, outcome = d.face_result()
    return t.pipeline_results.join(t.verification_scores, "request_id").select(
        "request_id", score.alias("score"), joined(missing, ",").alias("missing"), outcome.alias("outcome"))


@query("d7_liveness_class", """
select request_id, round(greatest(0, least(1, x)), 4) score, case when greatest(0, least(1, x)) > 0.75 then 'live'
       when greatest(0, least(1, x)) < 0.5 then 'spoof' else 'borderline' end klass, greatest(0, least(1, x)) > 0.75 is_live
from (select request_id, liveness_score * 2e0 - 0.5e0 x from verification_scores)""")
def _(t):
    score, klass, live = d.liveness_result(F.col("liveness_score") * 2 - 0.5)
    return t.verification_scores.select("request_id", score.alias("score"), klass.alias("klass"), live.alias("is_live"))


@query("d8_quality_average", """
select request_id, round((document_blur + selfie_blur) / 2, 4) blur_score, round((document_brightness + selfie_brightness) / 2, 4) brightness_score,
       round((document_contrast + selfie_contrast) / 2, 4) contrast_score from quality_measurements""")
def _(t):
    return d.averaged_quality(t.quality_measurements).select("request_id", "blur_score", "brightness_score", "contrast_score")


_KIND = ("case replace(replace(lower(trim(coalesce(document_kind, ''))), '-', '_'), ' ', '_') "
         + " ".join(f"when '{k}' then '{v}'" for k, v in q.KIND_ALIASES.items()) + " end")


def _n(value):
    return f"cast(cast(round_even({value}, 0) as bigint) as varchar)"


_GATE = f"""
limits as (select *, case coalesce({_KIND}, 'national_id') when 'national_id' then 25e0 else 20e0 end lim from quality_measurements),
gate as (select *,
   concat_ws(' | ', case when document_blur < lim and not (document_found and document_blur >= lim * 0.6e0)
       then concat('Image is too blurry (sharpness ', {_n('document_blur')}, ', needs ', {_n('lim')}, ')') end,
     case when document_brightness < 30 then concat('Image is too dark (brightness ', {_n('document_brightness')}, ', needs at least 30)')
          when document_brightness > 248 then concat('Image is too bright (brightness ', {_n('document_brightness')}, ', limit 248)') end,
     case when document_contrast < 12 then concat('Image has low contrast (contrast ', {_n('document_contrast')}, ', needs 12)') end) document_failures,
   concat_ws(' | ', case when document_blur < lim and document_found and document_blur >= lim * 0.6e0 then concat('Image is a little soft (sharpness ',
       {_n('document_blur')}, ', ideal ', {_n('lim')}, '). It will be tried, but a steadier, better-focused shot reads more reliably.') end) document_warnings,
   concat_ws(' | ', case when selfie_blur < 2 then concat('Image is too blurry (sharpness ', {_n('selfie_blur')}, ', needs 2)') end,
     case when selfie_brightness < 10 then concat('Image is too dark (brightness ', {_n('selfie_brightness')}, ', needs at least 10)')
          when selfie_brightness > 245 then concat('Image is too bright (brightness ', {_n('selfie_brightness')}, ', limit 245)') end,
     case when selfie_contrast < 2 then concat('Image has low contrast (contrast ', {_n('selfie_contrast')}, ', needs 2)') end) selfie_failures
 from limits)"""


@query("d9_quality_gate", f"""
with {_GATE}
select request_id, document_failures, document_warnings, selfie_failures, document_failures = '' and selfie_failures = '' overall_passed from gate""")
def _(t):
    rows = q.with_quality_gate(t.quality_measurements)
    return rows.select("request_id", *[joined(c).alias(c) for c in ("document_failures", "document_warnings", "selfie_failures")],
                       "overall_passed")


def _friendly(text, side):
    return f"""case when contains({text}, 'too blurry') then 'Your {side} is too blurry' when contains({text}, 'too dark') then 'Your {side} is too dark'
        when contains({text}, 'too bright') then 'Your {side} is too bright' when contains({text}, 'low contrast') then 'Your {side} has low contrast' end"""


_MESSAGES = f"""array_to_string(list_concat(
  list_transform(list_filter(string_split(document_failures, ' | '), lambda x: x <> ''), lambda x: {_friendly('x', 'document image')}),
  list_transform(list_filter(string_split(selfie_failures, ' | '), lambda x: x <> ''), lambda x: {_friendly('x', 'selfie')})), ' | ')"""


@query("d10_failure_messages", f"with {_GATE} select request_id, {_MESSAGES} messages from gate")
def _(t):
    rows = q.with_quality_gate(t.quality_measurements)
    return rows.select("request_id", joined(q.failure_messages(F.col("document_failures"), F.col("selfie_failures"))).alias("messages"))


@query("d11_quality_fail_decision", f"""
with {_GATE}
select request_id, agent_id, 'rejected' final_decision, 1e0 rejected_probability, 'image_quality_failure' decision_basis, false access_granted,
       concat_ws(',', case when document_failures <> '' then 'document' end, case when selfie_failures <> '' then 'selfie' end) failed_images,
       {_MESSAGES} messages
from gate where document_failures <> '' or selfie_failures <> ''""")
def _(t):
    rows = d.quality_failures(t.quality_measurements)
    return rows.select("request_id", "agent_id", "final_decision", "rejected_probability", "decision_basis", "access_granted",
                       joined("failed_images", ",").alias("failed_images"), joined("messages").alias("messages"))


@query("d12_enforce_access", f"""
select d.decision_id, r.agent_id, x.record_id, d.final_decision = 'verified' access_granted, timestamp '{REQUEST_NOW}' enforced_at,
       case when x.record_id is null then 'insert' else 'update' end as change
from kyc_decisions d join verification_requests r on r.request_id = d.request_id
     left join access_control_records x on x.decision_id = d.decision_id""")
def _(t):
    decisions = t.kyc_decisions.join(t.verification_requests.select("request_id", "agent_id"), "request_id")
    return d.enforce_access(decisions, t.access_control_records, REQUEST_NOW)


@query("d13_apply_overrides", f"""
select d.decision_id, d.request_id,
       case o.verdict when 'approve' then 'verified' when 'reject' then 'rejected' else d.final_decision end final_decision,
       case o.verdict when 'approve' then 1 when 'reject' then 0 else d.verified_probability end verified_probability,
       case when o.verdict is not null then 0 else d.review_probability end review_probability,
       case o.verdict when 'approve' then 0 when 'reject' then 1 else d.rejected_probability end rejected_probability,
       case when o.verdict is null then d.decided_at else timestamp '{REQUEST_NOW}' end decided_at, o.verdict is not null overridden
from kyc_decisions d left join admin_overrides o on o.request_id = d.request_id""")
def _(t):
    return d.apply_overrides(t.kyc_decisions, t.admin_overrides, REQUEST_NOW).drop("decision_basis")


@query("d13_override_audit", """
select o.request_id, o.agent_id, o.admin_id performed_by, seq,
   case when seq = 1 then if(verdict = 'approve', 'ADMIN_APPROVED', 'ADMIN_REJECTED') else if(verdict = 'approve', 'ACCESS_GRANTED', 'ACCESS_DENIED') end action,
   case when verdict = 'reject' then 'REJECTED' when seq = 1 then 'VERIFIED' else 'SUCCESS' end outcome,
   case when verdict = 'approve' then if(seq = 1, '{"accessGranted":true}', '{"source":"admin_approval"}')
        when seq = 1 then concat('{"reason":', coalesce('"' || reason || '"', 'null'), ',"accessGranted":false}')
        else concat('{"source":"admin_rejection","reason":', coalesce('"' || reason || '"', 'null'), '}') end details
from admin_overrides o cross join (values (1), (2)) v(seq) where o.request_id in (select request_id from kyc_decisions)""")
def _(t):
    return d.override_audit(t.admin_overrides, t.kyc_decisions)


def _lit(text):
    return "'" + text.replace("'", "''") + "'"


_has = lambda c: f"coalesce({c} <> '', false)"
_FEEDBACK_SQL = f"""
base as (select p.*, s.face_match_score face, s.liveness_score live, {DECISION_SQL} final_decision, coalesce(document_type, '') = '' unknown
         from pipeline_results p join verification_scores s on s.request_id = p.request_id),
flags as (select *, {_has('extracted_name')} and not name_match name_bad, {_has('extracted_id_number')} and not id_match id_bad,
            {_has('extracted_dob')} and not dob_match dob_bad,
            concat_ws(', ', case when not {_has('extracted_name')} then 'name' end, case when not {_has('extracted_id_number')} then 'ID number' end,
                      case when not {_has('extracted_dob')} then 'date of birth' end) missing from base),
doc as (select *,
  concat_ws(' | ', case when document_expired then concat('The document has expired', coalesce(concat(' (expiry ', extracted_expiry, ')'), ''), '.') end,
    case when missing <> '' then concat('We could not read the ', missing, ' from the document.') end,
    case when name_bad then concat('The name on the document ("', extracted_name, '") does not match the name you registered.') end,
    case when id_bad then concat('The ID number on the document (', extracted_id_number, ') does not match the ID number you registered.') end,
    case when dob_bad then concat('The date of birth on the document (', extracted_dob, ') does not match the date of birth you registered.') end,
    case when front_back_match = false then {_lit(fb.BACK_MISMATCH)} end) doc_reasons,
  concat_ws(' | ', case when document_expired then 'document_expired' end, case when name_bad and id_bad then 'name_and_id_mismatch' end,
    case when id_bad then 'id_mismatch' end, case when dob_bad then 'dob_mismatch' end) doc_hard,
  concat_ws(' | ', case when missing <> '' then {_lit(fb.RETAKE_CLOSER)} end, case when name_bad and not id_bad then {_lit(fb.CHECK_PROFILE)} end,
    case when front_back_match = false then {_lit(fb.RETAKE_BACK)} end, case when low_resolution then {_lit(fb.HOLD_CLOSER)} end) doc_tips from flags),
side as (select *,
  case when needs_retake then {_lit(fb.TOO_BLURRY)} when unknown then {_lit(fb.UNKNOWN_TYPE)}
       when doc_reasons = '' and reject_reason is not null and not ocr_matched then reject_reason else doc_reasons end r1,
  case when needs_retake or unknown then '' else doc_hard end h1,
  case when needs_retake then {_lit(fb.RETAKE_STILL)} when unknown then {_lit(fb.WHOLE_FRAME)} else doc_tips end s1,
  concat_ws(' | ', case when face < 50 then concat('Your selfie did not match the photo on the document closely enough (', cast(floor(face + 0.5e0) as int), '% similarity, 50% needed).')
      when face < 80 then concat('Your selfie matched the document photo, but not strongly (', cast(floor(face + 0.5e0) as int), '% similarity, 80% needed for automatic approval).') end,
    case when face_error is not null then concat('Face comparison could not be completed: ', face_error) end,
    case when live < 0.5 then concat('The liveness check did not pass (', cast(floor(live * 100 + 0.5e0) as int), '% confidence that a live person was in front of the camera).')
      when live < 0.75 then concat('The liveness check passed, but with low confidence (', cast(floor(live * 100 + 0.5e0) as int), '%).') end,
    case when liveness_error is not null then concat('Liveness detection could not be completed: ', liveness_error) end) r2,
  concat_ws(' | ', case when face < 35 then 'face_mismatch' end, case when live < 0.25 then 'liveness_fail' end) h2,
  concat_ws(' | ', case when face >= 35 and face < 50 then {_lit(fb.RETAKE_SELFIE)} when face >= 50 and face < 80 then {_lit(fb.CLEARER_SELFIE)} end,
    case when live >= 0.25 and live < 0.5 then {_lit(fb.BRIGHT_ROOM)} end) s2 from doc),
done as (select *, concat_ws(' | ', nullif(r1, ''), nullif(r2, '')) reasons, concat_ws(' | ', nullif(h1, ''), nullif(h2, '')) hard_failures,
    concat_ws(' | ', nullif(s1, ''), nullif(s2, '')) suggestions, greatest(0, 3 - strike_count) attempts_remaining from side)"""


@query("d14_feedback", f"""
with {_FEEDBACK_SQL}
select request_id, reasons, hard_failures, suggestions, attempts_remaining, final_decision = 'rejected' and hard_failures = '' borderline,
       final_decision = 'rejected' and hard_failures = '' and attempts_remaining > 0 can_retry,
       case when final_decision = 'verified' then {_lit(fb.SUMMARIES['verified'])} when final_decision = 'review' then {_lit(fb.SUMMARIES['review'])}
            when hard_failures = '' and attempts_remaining > 0 then {_lit(fb.SUMMARIES['retry'])}
            when hard_failures = '' then {_lit(fb.SUMMARIES['exhausted'])} else {_lit(fb.SUMMARIES['mismatch'])} end summary
from done""")
def _(t):
    decided = d.decide_by_threshold(t.verification_scores).drop("reasons")
    rows = fb.with_feedback(t.pipeline_results.join(decided, "request_id"))
    return rows.select("request_id", *[joined(c).alias(c) for c in ("reasons", "hard_failures", "suggestions")],
                       "attempts_remaining", "borderline", "can_retry", "summary")


_PIPELINE = f"""
{_GATE},
steps as (select g.request_id, g.agent_id, document_failures = '' and selfie_failures = '' overall_passed, needs_retake,
     case when document_face_detected and selfie_face_detected then s.face_match_score else 0 end face_match_score,
     round(s.liveness_score, 4) liveness_score, s.ocr_confidence_score, round((document_blur + selfie_blur) / 2, 4) blur_score,
     case when needs_retake then 'FAILED' else {_outcome('s.ocr_confidence_score', 0.7, 0.4)} end ocr_outcome,
     case when document_face_detected and selfie_face_detected then {_outcome('s.face_match_score', 80, 50)} else 'FAILED' end face_outcome,
     {_outcome('s.liveness_score', 0.75, 0.5)} liveness_outcome, {_MODEL_OK} is_model, m.final_decision m_decision
   from gate g join pipeline_results p on p.request_id = g.request_id join verification_scores s on s.request_id = g.request_id
        left join model_predictions m on m.request_id = g.request_id),
pipe as (select *, case when not overall_passed then 'quality_failed' when needs_retake then 'retake' else 'decided' end stage,
   case when not overall_passed then 'rejected' when needs_retake then null when is_model then m_decision else {DECISION_SQL} end final_decision,
   case when not overall_passed then 'image_quality_failure' when needs_retake then null when is_model then 'svm_model' else 'placeholder_threshold' end decision_basis
   from steps)"""


@query("d15_pipeline_decisions", f"""
with {_PIPELINE}
select request_id, agent_id, stage, coalesce(final_decision, 'pending') status, final_decision, decision_basis,
       case when stage <> 'retake' then final_decision = 'verified' end access_granted, case when overall_passed then blur_score end blur_score,
       case when overall_passed then face_match_score end face_match_score from pipe""")
def _(t):
    rows = d.run_pipeline(t.quality_measurements, t.pipeline_results, t.verification_scores, t.model_predictions)
    return rows.select("request_id", "agent_id", "stage", "status", "final_decision", "decision_basis", "access_granted",
                       "blur_score", "face_match_score")


@query("d15_pipeline_audit", f"""
with {_PIPELINE}
select request_id, agent_id, 1 seq, 'VERIFICATION_INITIATED' action, if(overall_passed, 'SUCCESS', 'FAILED') outcome from pipe
union all select request_id, agent_id, 2, 'IMAGE_QUALITY_ASSESSED', if(overall_passed, 'PASSED', 'FAILED') from pipe
union all select request_id, agent_id, 3, 'OCR_VERIFIED', ocr_outcome from pipe where overall_passed
union all select request_id, agent_id, 4, 'FACE_MATCH_COMPLETED', face_outcome from pipe where stage = 'decided'
union all select request_id, agent_id, 5, 'LIVENESS_DETECTED', liveness_outcome from pipe where stage = 'decided'
union all select request_id, agent_id, 6, 'KYC_DECISION_MADE', 'REVIEW' from pipe where stage = 'decided' and not is_model
union all select request_id, agent_id, 7, 'KYC_DECISION_MADE', upper(final_decision) from pipe where stage <> 'retake'
union all select request_id, agent_id, 8, 'MANUAL_REVIEW_FLAGGED', 'REVIEW' from pipe where final_decision = 'review'
union all select request_id, agent_id, 9, if(final_decision = 'verified', 'ACCESS_GRANTED', 'ACCESS_DENIED'),
                 if(final_decision = 'verified', 'SUCCESS', 'REJECTED') from pipe where final_decision in ('verified', 'rejected')
union all select request_id, agent_id, 10, 'FRAUD_GUARDRAIL_TRIGGERED', 'BLOCKED' from pipe where final_decision = 'rejected'""")
def _(t):
    rows = d.run_pipeline(t.quality_measurements, t.pipeline_results, t.verification_scores, t.model_predictions)
    return d.pipeline_audit(rows)


@query("d16_face_bands", f"""
select case when face_match_score < 25 then 'below_25' when face_match_score <= 50 then '25_through_50' else 'above_50' end band,
       count(*) filter (where {DECISION_SQL} = 'verified') verified, count(*) filter (where {DECISION_SQL} = 'review') review,
       count(*) filter (where {DECISION_SQL} = 'rejected') rejected from verification_scores group by 1""")
def _(t):
    return d.count_by_band(d.decide_by_threshold(t.verification_scores))


