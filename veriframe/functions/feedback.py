"""Plain-language feedback as array expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions.scores import compact_array

# Fixed texts shown to applicants.
TOO_BLURRY = "The document photo was too blurry to read."
RETAKE_STILL = "Retake the document photo in good light and hold the phone still."
UNKNOWN_TYPE = "We could not recognise the type of document in the photo."
WHOLE_FRAME = "Make sure the whole document is inside the frame and the text is readable."
RETAKE_CLOSER = "Retake the document photo closer, in good light, with no glare on the text."
CHECK_PROFILE = "Check that the name on your profile is exactly as printed on the document."
BACK_MISMATCH = "The ID number on the back of the card could not be matched to the front."
RETAKE_BACK = "Retake the back of the ID so the bottom lines of text (the <<< zone) are sharp."
HOLD_CLOSER = "Hold the document closer to the camera so it fills most of the frame."
RETAKE_SELFIE = "Retake the selfie facing the camera directly, without glasses or a hat, in even lighting."
CLEARER_SELFIE = "A clearer, well-lit selfie usually raises this score."
BRIGHT_ROOM = "Do the liveness step in a bright room, with your whole face inside the ring."
SUMMARIES = {
    "verified": "All checks passed.",
    "review": "Your scores were not high enough for automatic approval, so an administrator will review your case.",
    "retry": "Verification did not pass, but nothing indicates a wrong document or person, so you can try again with better photos.",
    "exhausted": "Verification did not pass and you have used all automatic attempts. Please contact support.",
    "mismatch": "Verification did not pass because the details on the document do not match your registration.",
}


def _present(column):
    return F.coalesce(F.col(column) != "", F.lit(False))


def _is_false(column):
    return F.coalesce(~F.col(column), F.lit(False))


def _whole(value):
    return F.floor(value + 0.5).cast("string")


def document_feedback():
    """(reasons, hard failures, suggestions) of the document step.

    Columns used: needs_retake, document_type, document_expired, extracted_expiry, extracted_name,
    extracted_id_number, extracted_dob, name_match, id_match, dob_match, front_back_match,
    low_resolution, reject_reason, ocr_matched.
    """
    retake = F.coalesce(F.col("needs_retake"), F.lit(False))
    unknown = ~_present("document_type")
    expired = F.coalesce(F.col("document_expired"), F.lit(False))
    missing = compact_array(
        F.when(~_present("extracted_name"), F.lit("name")),
        F.when(~_present("extracted_id_number"), F.lit("ID number")),
        F.when(~_present("extracted_dob"), F.lit("date of birth")),
    )
    some_missing = F.size(missing) > 0
    name_bad = _present("extracted_name") & _is_false("name_match")
    id_bad = _present("extracted_id_number") & _is_false("id_match")
    dob_bad = _present("extracted_dob") & _is_false("dob_match")
    sides_differ = _is_false("front_back_match")
    expiry_text = F.when(
        _present("extracted_expiry"), F.concat(F.lit(" (expiry "), F.col("extracted_expiry"), F.lit(")"))
    ).otherwise("")
    reasons = compact_array(
        F.when(expired, F.concat(F.lit("The document has expired"), expiry_text, F.lit("."))),
        F.when(some_missing, F.concat(F.lit("We could not read the "), F.array_join(missing, ", "), F.lit(" from the document."))),
        F.when(name_bad, F.concat(F.lit('The name on the document ("'), F.col("extracted_name"), F.lit('") does not match the name you registered.'))),
        F.when(id_bad, F.concat(F.lit("The ID number on the document ("), F.col("extracted_id_number"), F.lit(") does not match the ID number you registered."))),
        F.when(dob_bad, F.concat(F.lit("The date of birth on the document ("), F.col("extracted_dob"), F.lit(") does not match the date of birth you registered."))),
        F.when(sides_differ, F.lit(BACK_MISMATCH)),
    )
    fallback = _present("reject_reason") & _is_false("ocr_matched")
    reasons = F.when(F.size(reasons) > 0, reasons).when(fallback, F.array("reject_reason")).otherwise(reasons)
    hard = compact_array(
        F.when(expired, F.lit("document_expired")),
        F.when(name_bad & id_bad, F.lit("name_and_id_mismatch")),
        F.when(id_bad, F.lit("id_mismatch")),
        F.when(dob_bad, F.lit("dob_mismatch")),
    )
    suggestions = compact_array(
        F.when(some_missing, F.lit(RETAKE_CLOSER)),
        F.when(name_bad & ~id_bad, F.lit(CHECK_PROFILE)),
        F.when(sides_differ, F.lit(RETAKE_BACK)),
        F.when(F.coalesce(F.col("low_resolution"), F.lit(False)), F.lit(HOLD_CLOSER)),
    )
    none = F.array().cast("array<string>")
    choose = lambda on_retake, on_unknown, otherwise: F.when(retake, on_retake).when(unknown, on_unknown).otherwise(otherwise)
    return (
        choose(F.array(F.lit(TOO_BLURRY)), F.array(F.lit(UNKNOWN_TYPE)), reasons),
        choose(none, none, hard),
        choose(F.array(F.lit(RETAKE_STILL)), F.array(F.lit(WHOLE_FRAME)), suggestions),
    )


def biometric_feedback():
    """(reasons, hard failures, suggestions) of face match and liveness.

    Columns used: face_match_score, liveness_score, face_error, liveness_error. Null scores give no text.
    """
    face, live = F.col("face_match_score"), F.col("liveness_score")
    reasons = compact_array(
        F.when(face < 50, F.concat(F.lit("Your selfie did not match the photo on the document closely enough ("), _whole(face), F.lit("% similarity, 50% needed).")))
        .when(face < 80, F.concat(F.lit("Your selfie matched the document photo, but not strongly ("), _whole(face), F.lit("% similarity, 80% needed for automatic approval)."))),
        F.when(_present("face_error"), F.concat(F.lit("Face comparison could not be completed: "), F.col("face_error"))),
        F.when(live < 0.5, F.concat(F.lit("The liveness check did not pass ("), _whole(live * 100), F.lit("% confidence that a live person was in front of the camera).")))
        .when(live < 0.75, F.concat(F.lit("The liveness check passed, but with low confidence ("), _whole(live * 100), F.lit("%)."))),
        F.when(_present("liveness_error"), F.concat(F.lit("Liveness detection could not be completed: "), F.col("liveness_error"))),
    )
    hard = compact_array(
        F.when(face < 35, F.lit("face_mismatch")), F.when(live < 0.25, F.lit("liveness_fail"))
    )
    suggestions = compact_array(
        F.when((face >= 35) & (face < 50), F.lit(RETAKE_SELFIE)).when((face >= 50) & (face < 80), F.lit(CLEARER_SELFIE)),
        F.when((live >= 0.25) & (live < 0.5), F.lit(BRIGHT_ROOM)),
    )
    return reasons, hard, suggestions


def with_feedback(rows, max_strikes=3):
    """Add reasons, hard_failures, suggestions, borderline, can_retry, attempts_remaining and summary."""
    doc_reasons, doc_hard, doc_tips = document_feedback()
    bio_reasons, bio_hard, bio_tips = biometric_feedback()
    rows = rows.select(
        "*", F.concat(doc_reasons, bio_reasons).alias("reasons"), F.concat(doc_hard, bio_hard).alias("hard_failures"),
        F.array_distinct(F.concat(doc_tips, bio_tips)).alias("suggestions"),
        F.greatest(F.lit(0), F.lit(max_strikes) - F.coalesce("strike_count", F.lit(0))).alias("attempts_remaining"),
    )
    rejected = F.coalesce(F.col("final_decision") == "rejected", F.lit(False))
    borderline = rejected & (F.size("hard_failures") == 0)
    can_retry = borderline & (F.col("attempts_remaining") > 0)
    text = lambda key: F.lit(SUMMARIES[key])
    summary = (
        F.when(F.col("final_decision") == "verified", text("verified"))
        .when(F.col("final_decision") == "review", text("review"))
        .when(can_retry, text("retry")).when(borderline, text("exhausted")).when(rejected, text("mismatch"))
    )
    return rows.select("*", borderline.alias("borderline"), can_retry.alias("can_retry"), summary.alias("summary"))
