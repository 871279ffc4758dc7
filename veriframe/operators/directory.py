"""Admin and agent views: directory, queues, histories, audit lists, status and document choice.

Every per-row lookup is one join. The larger side is reduced to the latest row per key first.
Lookups on agents carry no broadcast hint: the planner broadcasts only below its size limit, and
adaptive execution splits hot agents in the shuffled join.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions.clock import at, audit_window
from veriframe.functions.scores import percent_of, tone
from veriframe.operators.keyed import latest_by
from veriframe.schemas import (
    ACTION_LABELS, BASIS_LABELS, DOCUMENT_TYPES, FINAL_STATUSES, GUARDRAIL_LABELS,
    IDENTITY_TYPES, SCORE_SCALES,
)

PROBABILITIES = ["verified_probability", "review_probability", "rejected_probability"]


def latest_requests(requests):
    """Newest request per agent, ties broken by request id."""
    return latest_by(requests, "agent_id", ["created_at", "request_id"])


def _decisions(decisions):
    return decisions.select("request_id", "decision_id", "final_decision", *PROBABILITIES, "decision_basis", "decided_at")


def with_scores_and_decision(requests, scores, decisions):
    """1:1 left joins request → scores and decision, both on request id (one shuffle key)."""
    return requests.join(scores, "request_id", "left").join(_decisions(decisions), "request_id", "left")


def agent_directory(agents, requests, scores, decisions, now, status=None, window_open=False):
    """Every agent with its latest request, scores, decision and audit window, newest agent first."""
    latest = latest_requests(requests).withColumnRenamed("created_at", "requested_at")
    rows = agents.join(latest, "agent_id", "left")
    rows = with_scores_and_decision(rows, scores, decisions)
    rows = rows.withColumn("status", F.coalesce("status", F.lit("pending")))
    if status:
        rows = rows.where(F.col("status") == status)
    verified_at, expires_at, is_open = audit_window(
        F.col("status"), F.col("final_decision"), F.col("decided_at"), at(now)
    )
    rows = rows.withColumn("verified_at", verified_at).withColumn("expires_at", expires_at).withColumn(
        "window_open", is_open
    )
    if window_open:
        rows = rows.where("window_open")
    return rows.orderBy(F.desc("created_at"), "agent_id")


def pending_review(requests, agents, scores, decisions):
    """Requests in review with agent, scores and decision, newest first."""
    waiting = requests.where(F.col("status") == "review")
    people = agents.select("agent_id", "full_name", "national_id")
    rows = with_scores_and_decision(waiting.join(people, "agent_id"), scores, decisions)
    return rows.orderBy(F.desc("created_at"), F.desc("request_id"))


def latest_access(access):
    return latest_by(
        access.select("agent_id", "enforced_at", "record_id", "access_granted"), "agent_id", ["enforced_at", "record_id"]
    )


def agent_history(agents, users, requests, scores, decisions, access, now):
    """All requests with scores, decision, the agent's latest access row and the audit window."""
    people = agents.select("agent_id", "user_id", "full_name").join(
        users.select("user_id", F.when(F.col("email") != "", F.col("email")).alias("user_email")), "user_id", "left"
    )
    newest = latest_access(access).select(
        "agent_id", F.col("record_id").alias("access_record_id"), "access_granted", "enforced_at"
    )
    people = people.join(newest, "agent_id", "left")
    rows = with_scores_and_decision(requests.join(people, "agent_id"), scores, decisions)
    verified_at, expires_at, is_open = audit_window(
        F.col("status"), F.col("final_decision"), F.col("decided_at"), at(now)
    )
    return rows.withColumn("expires_at", expires_at).withColumn("window_open", is_open)


OCR_FIELDS = [
    "confidenceScore", "extractedName", "extractedIDNumber", "extractedDOB", "extractedExpiry",
    "nameMatch", "idMatch", "dobMatch", "documentType", "needsManualReview", "rejectReason",
]


def latest_ocr_summary(logs, agents):
    """Newest OCR row per agent: JSON fields, registered values falling back to the profile."""
    newest = latest_by(
        logs.where(F.col("action") == "OCR_VERIFIED").select("agent_id", "ts", "log_id", "details"),
        "agent_id", ["ts", "log_id"],
    ).where(F.col("details").isNotNull())
    rows = newest.join(agents.select("agent_id", "full_name", "national_id", "date_of_birth"), "agent_id")
    field = lambda name: F.get_json_object("details", f"$.{name}")
    return rows.select(
        "agent_id", "ts", *[field(n).alias(n) for n in OCR_FIELDS],
        F.coalesce(field("registeredName"), "full_name").alias("registeredName"),
        F.coalesce(field("registeredIDNumber"), "national_id").alias("registeredIDNumber"),
        F.coalesce(field("registeredDOB"), F.col("date_of_birth").cast("string")).alias("registeredDOB"),
    )


def with_agent_name(logs, agents, missing="Unknown"):
    """Left lookup of the agent name; empty or absent names become ``missing``."""
    names = agents.select("agent_id", F.col("full_name").alias("agent_name"))
    name = F.when(F.col("agent_name") != "", F.col("agent_name"))
    return logs.join(names, "agent_id", "left").withColumn("agent_name", F.coalesce(name, F.lit(missing)))


PART_ROWS = 100_000  # a page is cut out of a part of about this size
DIRECTORY_BUCKETS = 1024
NO_TIME = -(1 << 62)  # a missing time is older than all others


def _narrowed(rows, key, first, last, part_rows):
    """The range [low, high] of ``key`` that holds the ranks first..last (from 0, greatest first): (low, high, rows above, rows in all).

    Each round counts the rows of the range in buckets of equal width and keeps those that hold the wanted ranks.
    """
    limits = rows.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n")).first()
    low, high, total, above = limits["low"], limits["high"], limits["n"], 0
    size = total
    while size > part_rows and low < high:
        width = (high - low) // DIRECTORY_BUCKETS + 1
        inside = rows.where(key.between(low, high))
        counts = inside.groupBy(((key - low) / width).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        kept, seen = [], above
        for r in sorted(counts.collect(), key=lambda r: -r["bucket"]):  # DIRECTORY_BUCKETS rows
            if seen + r["n"] > first and seen <= last:
                kept.append((seen, r))
            seen += r["n"]
        if not kept:
            return low, high, above, total
        shrunk = (min(r["low"] for _, r in kept), max(r["high"] for _, r in kept))
        above, size = kept[0][0], sum(r["n"] for _, r in kept)
        if shrunk == (low, high) and len(kept) > 1:
            break  # the wanted ranks take up the whole range
        low, high = shrunk
    return low, high, above, total


def audit_page(logs, agents, page=1, page_size=20, part_rows=None):
    """One page of the audit list, newest first, with the total row count.

    Counts by time find the part that holds the page's ranks, and counts by log_id do so inside one moment; only that part is
    ordered, so a late page costs what the first one does. The page is cut before names are looked up.
    """
    part_rows = part_rows or PART_ROWS
    page = max(1, int(page or 1))
    size = min(100, max(1, int(page_size or 20)))
    first = (page - 1) * size
    moment = F.coalesce(F.unix_micros("ts"), F.lit(NO_TIME))
    low, high, above, total = _narrowed(logs, moment, first, first + size - 1, part_rows)
    if low is None or first >= total:
        part, above = logs.where("false"), first
    elif low > NO_TIME:
        part = logs.where(F.col("ts").between(F.timestamp_micros(F.lit(low)), F.timestamp_micros(F.lit(high))))  # reaches the scan
    else:
        part = logs.where(moment.between(low, high))
    if low is not None and low == high and first < total:  # one moment: its rows are ordered by number
        number = F.coalesce("log_id", F.lit(NO_TIME))
        low, high, more, _ = _narrowed(part, number, first - above, first - above + size - 1, part_rows)
        part, above = part.where(number.between(low, high)), above + more
    rows = part.orderBy(F.desc("ts"), F.desc("log_id")).offset(first - above).limit(size)
    return with_agent_name(rows, agents).withColumn("total", F.lit(total).cast("bigint"))


def recent_activity(logs, agents, count=20):
    rows = logs.orderBy(F.desc("ts"), F.desc("log_id")).limit(count)
    return with_agent_name(rows, agents)


def with_performer_label(logs, users, agents):
    """System for null/system, else agent name, else e-mail, else the raw id."""
    people = users.select(F.col("user_id").alias("performed_by"), F.col("email").alias("_email")).join(
        agents.select(F.col("user_id").alias("performed_by"), F.col("full_name").alias("_name")), "performed_by", "left"
    )
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    label = F.when(
        F.col("performed_by").isNull() | F.col("performed_by").isin("", "system"), F.lit("System")
    ).otherwise(F.coalesce(filled("_name"), filled("_email"), F.col("performed_by")))
    return logs.join(people, "performed_by", "left").withColumn("performed_by_label", label).drop("_email", "_name")


def agent_visible_logs(logs):
    """Rows an agent may see: everything but truthy ``svmFallback`` notices."""
    flag = F.get_json_object("details", "$.svmFallback")
    truthy = flag.isNotNull() & ~flag.isin("false", "0", "", "null")
    return logs.where(~F.coalesce(truthy, F.lit(False)))


def search_agents(agents, text):
    """Case-insensitive contains on name or national id; blank text keeps every agent."""
    wanted = (text or "").strip().lower()
    if not wanted:
        return agents
    return agents.where(
        F.lower(F.coalesce("full_name", F.lit(""))).contains(wanted)
        | F.lower(F.coalesce("national_id", F.lit(""))).contains(wanted)
    )


def in_date_range(logs, start=None, end=None, column="ts"):
    """Half-open range from the start day through the whole end day."""
    if start:
        logs = logs.where(F.col(column) >= F.to_timestamp(F.lit(start)))
    if end:
        logs = logs.where(F.col(column) < F.date_add(F.to_date(F.lit(end)), 1).cast("timestamp"))
    return logs


def by_agent_name(logs, agents, pattern):
    """Rows of agents whose name matches ``%pattern%`` without case (semi join)."""
    matched = agents.where(F.col("full_name").ilike(f"%{pattern}%")).select("agent_id")
    return logs.join(matched, "agent_id", "left_semi")


def verification_status(agents, requests, scores, decisions, access):
    """Current status per agent with step flags; ``not_started`` without a request."""
    latest = latest_requests(requests)
    rows = agents.select("agent_id").join(latest, "agent_id", "left")
    rows = with_scores_and_decision(rows, scores, decisions).join(latest_access(access), "agent_id", "left")
    started = F.col("request_id").isNotNull()
    has_scores = F.col("face_match_score").isNotNull()
    has_decision = F.col("final_decision").isNotNull()
    step = lambda done: F.when(started & done, F.lit("complete")).otherwise(F.lit("pending"))
    return rows.select(
        "agent_id", "request_id", F.when(started, F.col("status")).otherwise(F.lit("not_started")).alias("status"),
        F.coalesce(F.col("status").isin(FINAL_STATUSES) & has_decision, F.lit(False)).alias("is_final"),
        *[step(has_scores).alias(name) for name in
          ("image_quality", "document_verification", "face_matching", "liveness_detection")],
        step(has_decision).alias("verification_decision"), "final_decision",
        F.when(has_decision, F.coalesce("decision_basis", F.lit("placeholder_threshold"))).alias("decision_basis"),
        F.when(started, F.col("access_granted")).alias("access_granted"),
    )


def verification_result(requests, decisions, access, scores):
    """Latest request per agent that has a decision, with the access row of that decision."""
    latest = latest_requests(requests)
    rows = latest.join(_decisions(decisions), "request_id")
    gate = access.select("decision_id", "record_id", "access_granted", "enforced_at")
    return rows.join(gate, "decision_id", "left").join(scores, "request_id", "left")


def _filled(column):
    return F.coalesce(F.trim(F.col(column)) != "", F.lit(False))


def registration_stage(agents, documents):
    """incomplete → documents_submitted → verification_pending from profile fields and document types."""
    kinds = documents.groupBy("agent_id").agg(
        F.bool_or(F.col("document_type").isin(IDENTITY_TYPES)).alias("has_identity"),
        F.bool_or(F.col("document_type") == "selfie").alias("has_selfie"),
    )
    complete = (
        _filled("full_name") & _filled("phone_number") & _filled("national_id") & F.col("date_of_birth").isNotNull()
    )
    both = F.coalesce(F.col("has_identity") & F.col("has_selfie"), F.lit(False))
    stage = F.when(~complete, F.lit("incomplete")).when(both, F.lit("verification_pending")).otherwise(
        F.lit("documents_submitted")
    )
    return agents.join(kinds, "agent_id", "left").select("agent_id", stage.alias("stage"))


def document_choice(documents):
    """Primary, back and selfie document per agent: newest of the most preferred type, and its kind.

    One aggregation over (agent, type) maxima; at most six types remain per agent.
    """
    known = documents.where(F.col("document_type").isin(DOCUMENT_TYPES))
    newest = latest_by(
        known.select("agent_id", "document_type", "uploaded_at", "document_id"),
        ["agent_id", "document_type"], ["uploaded_at", "document_id"],
    )
    pick = lambda kind: F.max(F.when(F.col("document_type") == kind, F.col("document_id")))
    picks = newest.groupBy("agent_id").agg(
        *[pick(k).alias(f"_{k}") for k in IDENTITY_TYPES], pick("id_back").alias("back_document_id"),
        pick("selfie").alias("selfie_document_id"),
    )
    primary = F.coalesce(*[F.col(f"_{k}") for k in IDENTITY_TYPES])
    kind = F.when(F.col("_id_front").isNotNull(), F.lit("national_id")).when(
        F.col("_passport").isNotNull(), F.lit("passport")
    ).when(F.col("_drivers_licence").isNotNull(), F.lit("drivers_licence")).otherwise(F.lit("national_id"))
    return picks.select(
        "agent_id", primary.alias("primary_document_id"), "back_document_id", "selfie_document_id",
        kind.alias("document_kind"),
        (primary.isNotNull() & F.col("selfie_document_id").isNotNull()).alias("can_start"),
    )


CAPTURE_MESSAGE = (
    "On a second or later verification attempt, take a new photo of your document using the camera. "
    "File uploads are not allowed."
)


def camera_required(agents, requests):
    """Flag per agent: any earlier request makes the camera compulsory."""
    seen = requests.select("agent_id").distinct().withColumn("_seen", F.lit(True))
    return agents.select("agent_id").join(seen, "agent_id", "left").select(
        "agent_id", F.coalesce("_seen", F.lit(False)).alias("camera_required")
    )


def capture_violations(logs, requests):
    """Document uploads that were not taken by camera although an earlier request exists."""
    uploads = logs.where(F.col("action") == "DOCUMENTS_UPLOADED")
    first = requests.groupBy("agent_id").agg(F.min("created_at").alias("first_request_at"))
    json = lambda name: F.get_json_object("details", f"$.{name}")
    not_camera = lambda name: F.coalesce(json(name) != "camera", F.lit(True))
    bad = (json("primaryPath").isNotNull() & not_camera("documentFrontSource")) | (
        json("backPath").isNotNull() & not_camera("documentBackSource")
    )
    return (
        uploads.join(first, "agent_id").where((F.col("first_request_at") < F.col("ts")) & bad)
        .select("log_id", "agent_id", "ts", "first_request_at", F.lit(CAPTURE_MESSAGE).alias("message"))
    )


STEP_ACTIONS = ["OCR_VERIFIED", "FACE_MATCH_COMPLETED", "LIVENESS_DETECTED", "KYC_DECISION_MADE"]


def latest_step_details(logs, actions=STEP_ACTIONS):
    """Newest details per request and step, one column per step."""
    newest = latest_by(
        logs.where(F.col("action").isin(actions) & F.col("request_id").isNotNull())
        .select("request_id", "action", "ts", "log_id", "details"),
        ["request_id", "action"], ["ts", "log_id"],
    )
    return newest.groupBy("request_id").pivot("action", actions).agg(F.first("details"))


def visible_rows(rows, viewer_id, users, agents=None):
    """Rows a viewer may read: all for an admin, else rows of the viewer's own agent or user id."""
    admin = users.where((F.col("user_id") == viewer_id) & (F.col("role") == "admin")).select(F.lit(1).alias("_admin"))
    is_admin = admin.limit(1).agg((F.count(F.lit(1)) > 0).alias("_is_admin"))
    if agents is not None:
        own = agents.where(F.col("user_id") == viewer_id).select("agent_id", F.lit(True).alias("_own"))
        marked = rows.join(own, "agent_id", "left")
        mine = F.coalesce(F.col("_own"), F.lit(False))
    else:
        marked, mine = rows, F.col("user_id") == viewer_id
    return (
        marked.crossJoin(F.broadcast(is_admin))  # one-row side
        .where(F.col("_is_admin") | mine).select(*rows.columns)
    )


def date_of_birth_error(value, now):
    """Registration check of a YYYY-MM-DD birth date; null means valid. Years are 365.25 days."""
    text = F.trim(value)
    # browser dates roll day 29-31 of a short month over, so only month and day ranges are checked
    well_formed = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    year, month, day = (F.substring(text, a, b).try_cast("int") for a, b in ((1, 4), (6, 2), (9, 2)))
    in_range = month.between(1, 12) & day.between(1, 31)
    first = F.when(well_formed & in_range, F.make_date(F.greatest(year, F.lit(1)), month, F.lit(1)))
    born = F.date_add(first, day - 1).cast("timestamp")
    age = (F.unix_micros(now) - F.unix_micros(born)) / (365.25 * 86400e6)
    invalid = F.lit("Enter a valid date of birth")
    return (
        F.when(value.isNull() | (value == ""), F.lit("Date of birth is required"))
        .when(~well_formed | ~in_range, invalid)
        .when(born >= now, F.lit("Date of birth must be in the past"))
        .when(age < 18, F.lit("You must be at least 18 years old"))
        .when(age > 120, invalid)
    )


def activity_days(logs):
    """Log rows with their calendar day label and that day's row count.

    Entries stay rows (not nested lists), so a busy day never has to fit into one record.
    """
    day = F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("Date unavailable"))
    rows = logs.withColumn("day", day)
    counts = rows.groupBy("day").agg(F.count(F.lit(1)).alias("entries"))
    return rows.join(counts, "day")


def score_tones(scores):
    """Tone and percent of maximum for the three identity scores, and brightness in range mode."""
    columns = []
    for name, (maximum, amber, green) in SCORE_SCALES.items():
        columns += [
            tone(F.col(name), amber, green).alias(f"{name}_tone"),
            percent_of(F.col(name), maximum).alias(f"{name}_percent"),
        ]
    columns.append(tone(F.col("brightness_score"), 40, 220, range_mode=True).alias("brightness_score_tone"))
    return scores.select("request_id", *columns)


def with_label(rows, column, labels, out, fallback=None):
    """Label of a code from a fixed table; unknown codes keep ``fallback`` or themselves."""
    mapping = F.create_map(*[F.lit(part) for pair in labels.items() for part in pair])
    found = F.try_element_at(mapping, F.col(column))
    return rows.withColumn(out, F.coalesce(found, fallback if fallback is not None else F.col(column)))


def with_all_labels(logs, basis_column=None):
    rows = with_label(logs, "action", ACTION_LABELS, "action_label")
    guardrail = F.coalesce(F.get_json_object("details", "$.guardrailType"), F.get_json_object("details", "$.guardrail"))
    rows = rows.withColumn("guardrail", guardrail)
    return with_label(rows, "guardrail", GUARDRAIL_LABELS, "guardrail_label", F.coalesce("guardrail", F.lit("Unknown")))


def with_basis_label(decisions):
    basis = F.coalesce("decision_basis", F.lit("placeholder_threshold"))
    rows = decisions.withColumn("basis", basis)
    return with_label(rows, "basis", BASIS_LABELS, "basis_label", F.concat(F.lit("Decision basis: "), F.col("basis")))


def requests_without_decision(requests, decisions):
    return requests.join(decisions, "request_id", "left_anti")


def orphan_decisions(decisions, requests):
    return decisions.join(requests, "request_id", "left_anti")


def superseded_files(files, documents_with_path):
    """Stored files that no document row points at any more."""
    return files.join(documents_with_path.select("path"), "path", "left_anti")
