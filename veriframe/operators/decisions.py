"""Decisions: thresholds, model-first choice, access, overrides and the whole batch pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions.quality import failure_messages, with_quality_gate
from veriframe.functions.scores import (
    clamp, compact_array, face_band, liveness_class, mean4, outcome_of, score_errors, threshold_decision, threshold_reasons,
)
from veriframe.schemas import CLASS_KEYS, CLASS_OF_KEY, FEATURES, FINAL_STATUSES


def one_hot(decision):
    return [(decision == key).cast("double").alias(f"{key}_probability") for key in CLASS_KEYS]


def validate_scores(scores):
    """Scores with an error array; an empty array means the row may be decided."""
    return scores.withColumn("errors", score_errors())


def decide_by_threshold(scores):
    """Threshold decision with one-hot probabilities, basis and reasons."""
    decided = scores.withColumn("final_decision", threshold_decision())
    return decided.select(
        "*", *one_hot(F.col("final_decision")), F.lit("placeholder_threshold").alias("decision_basis"),
        threshold_reasons().alias("reasons"),
    )


def usable_prediction():
    """True for a model row with the model basis, a known label and probabilities that sum to one."""
    probabilities = [F.col(f"m_{key}_probability") for key in CLASS_KEYS]
    inside = lambda p: p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p <= 1)
    total = probabilities[0] + probabilities[1] + probabilities[2]
    valid = (
        (F.col("m_decision_basis") == "svm_model") & F.col("m_final_decision").isin(CLASS_KEYS)
        & inside(probabilities[0]) & inside(probabilities[1]) & inside(probabilities[2]) & (F.abs(total - 1) < 1e-5)
    )
    return F.coalesce(F.col("m_available") & valid, F.lit(False))


def decide_model_first(scores, predictions):
    """Model decision where the prediction is usable, threshold decision otherwise.

    ``fallback_reason`` is null for model rows; :func:`fallback_audit` turns the others into audit rows.
    """
    model = predictions.select(
        "request_id", *[F.col(c).alias(f"m_{c}") for c in predictions.columns if c != "request_id"]
    )
    rows = decide_by_threshold(scores).join(model, "request_id", "left").withColumn("_model", usable_prediction())
    label = F.create_map(*[F.lit(x) for pair in CLASS_OF_KEY.items() for x in pair])
    chosen = F.coalesce(*[F.when(F.col("m_final_decision") == k, F.col(f"m_{k}_probability")) for k in CLASS_KEYS])
    sentence = F.concat(
        F.lit("SVM classifier v"), F.coalesce("m_model_version", F.lit("unknown")), F.lit(" predicted "),
        F.try_element_at(label, F.col("m_final_decision")), F.lit(" with "), F.format_string("%.1f", chosen * 100),
        F.lit("% probability"),
    )
    pick = lambda name: F.when(F.col("_model"), F.col(f"m_{name}")).otherwise(F.col(name)).alias(name)
    reason = F.when(~F.col("_model"), F.when(F.coalesce("m_available", F.lit(False)), F.lit("SVM returned an invalid prediction")).otherwise(F.lit("SVM unavailable")))
    return rows.select(
        *scores.columns, pick("final_decision"), *[pick(f"{k}_probability") for k in CLASS_KEYS], pick("decision_basis"),
        F.when(F.col("_model"), F.array(sentence)).otherwise(F.col("reasons")).alias("reasons"),
        F.when(F.col("_model"), F.col("m_model_version")).alias("model_version"), reason.alias("fallback_reason"),
    )


def fallback_audit(decided):
    """One audit row per decision that fell back to the thresholds."""
    details = F.to_json(F.struct(
        F.lit("SVM unavailable — placeholder threshold used").alias("warning"), F.lit(True).alias("svmFallback"),
        F.col("fallback_reason").alias("reason"),
    ))
    return decided.where(F.col("fallback_reason").isNotNull()).select(
        "request_id", F.lit("KYC_DECISION_MADE").alias("action"), F.lit("REVIEW").alias("outcome"),
        F.lit("system").alias("performed_by"), details.alias("details"),
    )


def step_outcomes(scores):
    """PASSED / BORDERLINE / FAILED per step."""
    return scores.select(
        "request_id", outcome_of(F.col("ocr_confidence_score"), 0.7, 0.4).alias("ocr_outcome"),
        outcome_of(F.col("face_match_score"), 80, 50).alias("face_outcome"),
        outcome_of(F.col("liveness_score"), 0.75, 0.5).alias("liveness_outcome"),
    )


def ocr_flags():
    """(flagged for review, outcome, moves status to review) of the text step."""
    retake, manual = F.coalesce("needs_retake", F.lit(False)), F.coalesce("needs_manual_review", F.lit(False))
    low = ~F.coalesce("ocr_matched", F.lit(False)) & (F.coalesce("ocr_confidence_score", F.lit(0.0)) < 0.4)
    flagged = manual | low
    outcome = F.when(retake, F.lit("FAILED")).otherwise(outcome_of(F.col("ocr_confidence_score"), 0.7, 0.4))
    return flagged, outcome, flagged & ~retake


def face_result():
    """(score, missing sides, outcome): a missing face scores 0 and fails."""
    missing = compact_array(
        F.when(~F.coalesce("document_face_detected", F.lit(False)), F.lit("document")),
        F.when(~F.coalesce("selfie_face_detected", F.lit(False)), F.lit("selfie")),
    )
    lost = F.size(missing) > 0
    score = F.when(lost, F.lit(0.0)).otherwise(F.coalesce("face_match_score", F.lit(0.0)))
    outcome = F.when(lost, F.lit("FAILED")).otherwise(outcome_of(F.col("face_match_score"), 80, 50))
    return score, missing, outcome


def liveness_result(score):
    """(score clamped and rounded, class, is live)."""
    bounded = clamp(score, 0.0, 1.0)
    return F.round(bounded, 4), liveness_class(bounded), bounded > 0.75


def averaged_quality(rows):
    names = ["blur", "brightness", "contrast"]
    return rows.select(
        "*", *[mean4(F.col(f"document_{n}"), F.col(f"selfie_{n}")).alias(f"{n}_score") for n in names]
    )


def quality_failures(measurements):
    """Rejected decisions for requests that fail the quality gate, with friendly messages."""
    rows = with_quality_gate(measurements).where(~F.col("overall_passed"))
    failed = compact_array(
        F.when(F.size("document_failures") > 0, F.lit("document")), F.when(F.size("selfie_failures") > 0, F.lit("selfie"))
    )
    decision = F.lit("rejected")
    return rows.select(
        "request_id", "agent_id", decision.alias("final_decision"), *one_hot(decision),
        F.lit("image_quality_failure").alias("decision_basis"), F.lit(False).alias("access_granted"),
        failed.alias("failed_images"), failure_messages(F.col("document_failures"), F.col("selfie_failures")).alias("messages"),
    )


def enforce_access(decisions, access, now):
    """Access record per decision: updated when one exists, else new; granted only when verified."""
    existing = access.select("decision_id", "record_id")
    return decisions.join(existing, "decision_id", "left").select(
        "decision_id", "agent_id", "record_id", (F.col("final_decision") == "verified").alias("access_granted"),
        F.lit(now).cast("timestamp").alias("enforced_at"),
        F.when(F.col("record_id").isNull(), F.lit("insert")).otherwise(F.lit("update")).alias("change"),
    )


def apply_overrides(decisions, overrides, now):
    """Decisions after administrator approvals and rejections, with one-hot probabilities."""
    verdict = overrides.select(
        "request_id", F.when(F.col("verdict") == "approve", F.lit("verified")).otherwise(F.lit("rejected")).alias("_new")
    )
    rows = decisions.join(verdict, "request_id", "left")
    changed = F.col("_new").isNotNull()
    pick = lambda new, old: F.when(changed, new).otherwise(F.col(old)).alias(old)
    return rows.select(
        "decision_id", "request_id", pick(F.col("_new"), "final_decision"),
        *[pick((F.col("_new") == k).cast("double"), f"{k}_probability") for k in CLASS_KEYS], "decision_basis",
        pick(F.lit(now).cast("timestamp"), "decided_at"), changed.alias("overridden"),
    )


def override_audit(overrides, decisions):
    """Two audit rows per applied override: the administrator's act and the access change."""
    applied = overrides.join(decisions, "request_id", "left_semi")
    approve = F.col("verdict") == "approve"
    row = lambda order, action, outcome, details: F.struct(
        F.lit(order).alias("seq"), action.alias("action"), outcome.alias("outcome"), details.alias("details")
    )
    when = lambda yes, no: F.when(approve, F.lit(yes)).otherwise(F.lit(no))
    keep_nulls = {"ignoreNullFields": "false"}
    first = F.when(approve, F.lit('{"accessGranted":true}')).otherwise(
        F.to_json(F.struct(F.col("reason"), F.lit(False).alias("accessGranted")), keep_nulls)
    )
    second = F.when(approve, F.lit('{"source":"admin_approval"}')).otherwise(
        F.to_json(F.struct(F.lit("admin_rejection").alias("source"), F.col("reason")), keep_nulls)
    )
    rows = F.array(
        row(1, when("ADMIN_APPROVED", "ADMIN_REJECTED"), when("VERIFIED", "REJECTED"), first),
        row(2, when("ACCESS_GRANTED", "ACCESS_DENIED"), when("SUCCESS", "REJECTED"), second),
    )
    return applied.select("request_id", "agent_id", F.col("admin_id").alias("performed_by"), F.inline(rows))


def count_by_band(rows, label="final_decision", values=FINAL_STATUSES):
    """Face-score bands with the count of each predicted class."""
    banded = rows.withColumn("band", face_band(F.col("face_match_score")))
    return banded.groupBy("band").agg(*[F.count_if(F.col(label) == v).alias(v.lower().replace(" ", "_")) for v in values])


def run_pipeline(measurements, results, scores, predictions=None):
    """Whole verification of a batch of requests as one plan.

    gate → text → face → liveness → decision → access, one row per request with every step's outcome.
    All inputs join on request id, so the planner keeps one partitioning through the plan.
    """
    gated = averaged_quality(with_quality_gate(measurements))
    raw = scores.select("request_id", "face_match_score", "liveness_score", "ocr_confidence_score")
    rows = gated.join(results, "request_id").join(raw, "request_id")
    flagged, ocr_outcome, _ = ocr_flags()
    face_score, missing, face_outcome = face_result()
    live_score, _, _ = liveness_result(F.coalesce("liveness_score", F.lit(0.0)))
    rows = rows.select(
        *[c for c in rows.columns if c not in ("face_match_score", "liveness_score")], flagged.alias("flagged"),
        ocr_outcome.alias("ocr_outcome"), face_score.alias("face_match_score"), missing.alias("missing_faces"),
        face_outcome.alias("face_outcome"), live_score.alias("liveness_score"),
        outcome_of(live_score, 0.75, 0.5).alias("liveness_outcome"),
    )
    kept = [c for c in rows.columns if c != "reject_reason"]
    decided = decide_by_threshold(rows.select(*kept)) if predictions is None else decide_model_first(rows.select(*kept), predictions)
    if predictions is None:
        decided = decided.withColumn("fallback_reason", F.lit(None).cast("string"))
    stage = (
        F.when(~F.col("overall_passed"), F.lit("quality_failed")).when(F.coalesce("needs_retake", F.lit(False)), F.lit("retake"))
        .otherwise(F.lit("decided"))
    )
    decided = decided.withColumn("stage", stage)
    by_stage = lambda quality, retake, done: F.when(F.col("stage") == "quality_failed", quality).when(F.col("stage") == "retake", retake).otherwise(done)
    nothing = F.lit(None)
    return decided.select(
        "request_id", "agent_id", "stage", by_stage(F.lit("rejected"), F.lit("pending"), F.col("final_decision")).alias("status"),
        by_stage(F.lit("rejected"), nothing, F.col("final_decision")).alias("final_decision"),
        by_stage(F.lit("image_quality_failure"), nothing, F.col("decision_basis")).alias("decision_basis"),
        by_stage(F.lit(False), nothing, F.col("final_decision") == "verified").alias("access_granted"),
        *[F.when(F.col("stage") != "quality_failed", F.col(c)).alias(c) for c in FEATURES],
        "ocr_outcome", "face_outcome", "liveness_outcome", "flagged", "missing_faces", "fallback_reason",
        failure_messages(F.col("document_failures"), F.col("selfie_failures")).alias("messages"),
    )


def pipeline_audit(pipeline):
    """Audit rows of every pipeline run in their fixed order."""
    quality = F.col("stage") == "quality_failed"
    decided = F.col("stage") == "decided"
    past_gate = ~quality
    outcome = F.upper("final_decision")
    step = lambda seq, when, action, result: F.when(when, F.struct(F.lit(seq).alias("seq"), action.alias("action"), result.alias("outcome")))
    text = F.lit
    review = F.col("final_decision") == "review"
    rows = compact_array(
        step(1, F.lit(True), text("VERIFICATION_INITIATED"), F.when(quality, "FAILED").otherwise("SUCCESS")),
        step(2, F.lit(True), text("IMAGE_QUALITY_ASSESSED"), F.when(quality, "FAILED").otherwise("PASSED")),
        step(3, past_gate, text("OCR_VERIFIED"), F.col("ocr_outcome")),
        step(4, decided, text("FACE_MATCH_COMPLETED"), F.col("face_outcome")),
        step(5, decided, text("LIVENESS_DETECTED"), F.col("liveness_outcome")),
        step(6, decided & F.col("fallback_reason").isNotNull(), text("KYC_DECISION_MADE"), text("REVIEW")),
        step(7, decided | quality, text("KYC_DECISION_MADE"), outcome),
        step(8, decided & review, text("MANUAL_REVIEW_FLAGGED"), text("REVIEW")),
        step(9, F.coalesce(decided & ~review, F.lit(False)) | quality,
             F.when(F.col("access_granted"), "ACCESS_GRANTED").otherwise("ACCESS_DENIED"),
             F.when(F.col("access_granted"), "SUCCESS").otherwise("REJECTED")),
        step(10, F.coalesce(F.col("final_decision") == "rejected", F.lit(False)), text("FRAUD_GUARDRAIL_TRIGGERED"), text("BLOCKED")),
    )
    return pipeline.select("request_id", "agent_id", F.inline(rows))
