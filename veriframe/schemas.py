"""Domain schemas, enumerations and fixed value tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec):
    kinds = {
        "s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(),
        "b": T.BooleanType(), "t": T.TimestampType(), "D": T.DateType(),
        "as": T.ArrayType(T.StringType()), "ad": T.ArrayType(T.DoubleType()),
    }
    fields = [part.split(":") for part in spec.split()]
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


TABLES = {
    "users": _struct("user_id:s email:s role:s created_at:t"),
    "agents": _struct(
        "agent_id:l user_id:s full_name:s phone_number:s national_id:s date_of_birth:D email:s created_at:t"
    ),
    "agent_documents": _struct("document_id:l agent_id:l document_type:s file_url:s uploaded_at:t"),
    "verification_requests": _struct("request_id:l agent_id:l document_id:l status:s created_at:t"),
    "verification_scores": _struct(
        "request_id:l face_match_score:d liveness_score:d ocr_confidence_score:d "
        "blur_score:d brightness_score:d contrast_score:d"
    ),
    "kyc_decisions": _struct(
        "decision_id:l request_id:l final_decision:s verified_probability:d review_probability:d "
        "rejected_probability:d decision_basis:s decided_at:t"
    ),
    "access_control_records": _struct(
        "record_id:l agent_id:l decision_id:l access_granted:b enforced_at:t"
    ),
    "audit_logs": _struct(
        "log_id:l agent_id:l request_id:l action:s outcome:s details:s performed_by:s "
        "ip_address:s device_fingerprint:s ts:t"
    ),
    "passkeys": _struct(
        "id:l user_id:s credential_id:s public_key:s counter:l transports:as device_type:s "
        "backed_up:b label:s created_at:t last_used_at:t"
    ),
    "passkey_challenges": _struct("id:l challenge:s purpose:s user_id:s expires_at:t"),
    "passkey_rate_limits": _struct("bucket:s attempts:i expires_at:t"),
}

FEATURES = [
    "face_match_score", "liveness_score", "ocr_confidence_score",
    "blur_score", "brightness_score", "contrast_score",
]
FEATURE_ALIASES = [
    "faceMatchScore", "livenessScore", "ocrConfidenceScore",
    "blurScore", "brightnessScore", "contrastScore",
]
# Lower and upper bound per feature, None = open.
FEATURE_BOUNDS = [(0, 100), (0, 1), (0, 1), (0, None), (0, 255), (0, 127.5)]
BOUNDS = dict(zip(FEATURES, FEATURE_BOUNDS))

CLASSES = ["Verified", "Manual Review", "Rejected"]
CLASS_KEYS = ["verified", "review", "rejected"]
CLASS_OF_KEY = dict(zip(CLASS_KEYS, CLASSES))

STATUSES = ["pending", "verified", "review", "rejected"]
FINAL_STATUSES = ["verified", "review", "rejected"]
ROLES = ["agent", "admin"]
DEVICE_TYPES = ["singleDevice", "multiDevice"]
PURPOSES = ["login", "register"]

# Audit actions and outcomes.
ACTIONS = [
    "AGENT_REGISTERED", "DOCUMENTS_UPLOADED", "VERIFICATION_INITIATED", "IMAGE_QUALITY_ASSESSED",
    "OCR_VERIFIED", "FACE_MATCH_COMPLETED", "LIVENESS_DETECTED", "KYC_DECISION_MADE",
    "ACCESS_GRANTED", "ACCESS_DENIED", "MANUAL_REVIEW_FLAGGED", "ADMIN_APPROVED", "ADMIN_REJECTED",
    "FRAUD_GUARDRAIL_TRIGGERED", "LOGIN_SUCCESS", "LOGIN_FAILED", "LOGOUT",
    "PASSWORD_RESET_REQUESTED", "PASSWORD_RESET",
]
OUTCOMES = [
    "SUCCESS", "FAILED", "PASSED", "BORDERLINE", "VERIFIED", "REVIEW", "REJECTED", "BLOCKED",
]

# The pipeline's audit rows in order, and the shorter trail after a quality failure.
CORE_TRAIL = [
    "AGENT_REGISTERED", "DOCUMENTS_UPLOADED", "VERIFICATION_INITIATED", "IMAGE_QUALITY_ASSESSED",
    "OCR_VERIFIED", "FACE_MATCH_COMPLETED", "LIVENESS_DETECTED", "KYC_DECISION_MADE",
]
QUALITY_FAILURE_TRAIL = [
    "AGENT_REGISTERED", "DOCUMENTS_UPLOADED", "VERIFICATION_INITIATED", "IMAGE_QUALITY_ASSESSED",
    "KYC_DECISION_MADE", "ACCESS_DENIED",
]

# Labels shown for codes.
ACTION_LABELS = {
    "AGENT_REGISTERED": "Account registered",
    "DOCUMENTS_UPLOADED": "Documents uploaded",
    "VERIFICATION_INITIATED": "Verification started",
    "IMAGE_QUALITY_ASSESSED": "Document quality checked",
    "OCR_VERIFIED": "Document text verified",
    "FACE_MATCH_COMPLETED": "Face match completed",
    "LIVENESS_DETECTED": "Liveness check completed",
    "KYC_DECISION_MADE": "Verification decision made",
    "ACCESS_GRANTED": "Platform access granted",
    "ACCESS_DENIED": "Platform access denied",
    "MANUAL_REVIEW_FLAGGED": "Flagged for manual review",
    "ADMIN_APPROVED": "Approved by administrator",
    "ADMIN_REJECTED": "Rejected by administrator",
    "FRAUD_GUARDRAIL_TRIGGERED": "Fraud guardrail triggered",
    "LOGIN_SUCCESS": "Signed in successfully",
    "LOGIN_FAILED": "Sign-in failed",
    "LOGOUT": "Signed out",
}
GUARDRAIL_LABELS = {
    "blocked_email_domain": "Blocked email",
    "duplicate_national_id": "Duplicate national ID",
    "ip_rate_limit": "IP rate limit",
    "device_fingerprint_rate_limit": "Device rate limit",
    "verification_strike": "Verification strike",
}
BASIS_LABELS = {
    "svm_model": "Decision made by SVM classifier",
    "placeholder_threshold": "Decision made by threshold rules",
    "image_quality_failure": "Rejected at image quality check",
}

# Disposable e-mail domains.
BLOCKED_EMAIL_DOMAINS = [
    "mailinator.com", "guerrillamail.com", "tempmail.com", "throwaway.email", "yopmail.com",
    "sharklasers.com", "trashmail.com", "10minutemail.com", "temp-mail.org", "fakeinbox.com",
]

# Document types; the first four are identity documents in order of preference.
IDENTITY_TYPES = ["id_front", "passport", "drivers_licence", "national_id"]
DOCUMENT_TYPES = ["national_id", "id_front", "id_back", "passport", "drivers_licence", "selfie"]

# Score scales (maximum, amber from, green from).
SCORE_SCALES = {
    "ocr_confidence_score": (1.0, 0.4, 0.7),
    "face_match_score": (100.0, 50.0, 80.0),
    "liveness_score": (1.0, 0.5, 0.75),
}

LOOKBACK_HOURS = 24
MAX_FAILURES = 3
MAX_STRIKES = 3

# Parents of each foreign key: child table, child column, parent table, parent column.
FOREIGN_KEYS = [
    ("agents", "user_id", "users", "user_id"),
    ("agent_documents", "agent_id", "agents", "agent_id"),
    ("verification_requests", "agent_id", "agents", "agent_id"),
    ("verification_requests", "document_id", "agent_documents", "document_id"),
    ("verification_scores", "request_id", "verification_requests", "request_id"),
    ("kyc_decisions", "request_id", "verification_requests", "request_id"),
    ("access_control_records", "agent_id", "agents", "agent_id"),
    ("access_control_records", "decision_id", "kyc_decisions", "decision_id"),
    ("audit_logs", "agent_id", "agents", "agent_id"),
    ("audit_logs", "request_id", "verification_requests", "request_id"),
]
UNIQUE_KEYS = [
    ("users", "email"), ("agents", "user_id"), ("agents", "national_id"),
    ("verification_scores", "request_id"), ("kyc_decisions", "request_id"),
    ("access_control_records", "decision_id"), ("passkeys", "credential_id"),
]
