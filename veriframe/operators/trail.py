"""Audit-trail completeness, order, immutability, and document retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions.clock import at, audit_window
from veriframe.functions.storage import owned_path
from veriframe.operators.directory import latest_requests
from veriframe.schemas import CORE_TRAIL, DOCUMENT_TYPES, QUALITY_FAILURE_TRAIL


def _texts(names):
    return F.array(*[F.lit(n) for n in names])


def expected_actions(status, present, quality_failed):
    """Expected action list of an agent from its latest status."""
    review = (
        F.when(F.array_contains(present, "ADMIN_APPROVED"), _texts(CORE_TRAIL + ["MANUAL_REVIEW_FLAGGED", "ADMIN_APPROVED", "ACCESS_GRANTED"]))
        .when(F.array_contains(present, "ADMIN_REJECTED"), _texts(CORE_TRAIL + ["MANUAL_REVIEW_FLAGGED", "ADMIN_REJECTED", "ACCESS_DENIED"]))
        .otherwise(_texts(CORE_TRAIL + ["MANUAL_REVIEW_FLAGGED"]))
    )
    return (
        F.when(quality_failed, _texts(QUALITY_FAILURE_TRAIL)).when(status == "verified", _texts(CORE_TRAIL + ["ACCESS_GRANTED"]))
        .when(status == "rejected", _texts(CORE_TRAIL + ["ACCESS_DENIED"])).when(status == "review", review)
        .otherwise(_texts(CORE_TRAIL))
    )


def audit_trails(agents, logs, requests):
    """Completeness and order of every agent's trail.

    The log is reduced to first and last time per (agent, action), at most 19 rows per agent, before
    anything is gathered. The trail is out of order exactly when some action of a later step happens
    before the last occurrence of an earlier step.
    """
    known = logs.where(F.col("agent_id").isNotNull())
    spans = known.groupBy("agent_id", "action").agg(
        F.min(F.struct("ts", "log_id")).alias("first"), F.max(F.struct("ts", "log_id")).alias("last"),
        F.bool_or((F.col("action") == "IMAGE_QUALITY_ASSESSED") & (F.col("outcome") == "FAILED")).alias("quality_failed"),
    )
    per_agent = spans.groupBy("agent_id").agg(
        F.collect_list(F.struct("action", "first", "last")).alias("spans"), F.bool_or("quality_failed").alias("quality_failed")
    )
    latest = latest_requests(requests).select("agent_id", F.col("status").alias("final_status"))
    rows = agents.select("agent_id").join(per_agent, "agent_id", "left").join(latest, "agent_id", "left")
    empty = F.filter(F.array(F.struct(F.lit("").alias("action"))), lambda s: F.lit(False))
    rows = rows.withColumn("present_all", F.coalesce(F.transform("spans", lambda s: s["action"]), F.transform(empty, lambda s: s["action"])))
    rows = rows.withColumn("expected", expected_actions(F.col("final_status"), F.col("present_all"), F.coalesce("quality_failed", F.lit(False))))
    step = lambda span: F.array_position(F.col("expected"), span["action"])
    kept = F.filter(F.col("spans"), lambda s: F.array_contains(F.col("expected"), s["action"]))
    drop = F.exists(kept, lambda late: F.exists(kept, lambda early: (step(late) > step(early)) & (late["first"] < early["last"])))
    return rows.select(
        "agent_id", "final_status", "expected",
        F.filter("expected", lambda a: F.array_contains(F.col("present_all"), a)).alias("present"),
        F.filter("expected", lambda a: ~F.array_contains(F.col("present_all"), a)).alias("missing"),
        F.coalesce(drop, F.lit(False)).alias("unexpected_order"),
    ).withColumn("complete", F.size("missing") == 0)


def audit_windows(requests, decisions, now):
    """Audit window per decided request."""
    rows = requests.join(decisions.select("request_id", "final_decision", "decided_at"), "request_id")
    verified_at, expires_at, is_open = audit_window(F.col("status"), F.col("final_decision"), F.col("decided_at"), at(now))
    return rows.select("request_id", "agent_id", verified_at.alias("verified_at"), expires_at.alias("expires_at"), is_open.alias("open"))


def expired_agents(requests, decisions, now):
    """Agents whose latest request is verified and whose window has ended."""
    latest = latest_requests(requests).where(F.col("status") == "verified").select("agent_id", "request_id", "status", "created_at")
    windows = audit_windows(latest, decisions, now)
    return windows.where(F.col("expires_at") <= at(now)).select("agent_id", "verified_at")


def purge_plan(requests, decisions, documents, files, now):
    """Paths to remove and document rows to blank, as one plan table; nothing is deleted.

    kind ``file``: distinct path to remove; kind ``row``: document row whose URL is to be emptied.
    """
    due = expired_agents(requests, decisions, now)
    old = documents.where(F.col("document_type").isin(DOCUMENT_TYPES) & (F.col("file_url") != "")).join(due, "agent_id").where(
        F.col("uploaded_at") <= F.col("verified_at")
    )
    rows = old.select("agent_id", "document_id", owned_path(F.col("file_url"), F.col("agent_id")).alias("path")).where(F.col("path").isNotNull())
    listed = files.where(F.col("folder").isin("documents", "selfies")).join(due, "agent_id").where(F.col("modified_at") <= F.col("verified_at"))
    listed = listed.select("agent_id", F.concat_ws("/", F.col("agent_id").cast("string"), "folder", "file_name").alias("path"))
    paths = rows.select("agent_id", "path").unionByName(listed).distinct()
    none = F.lit(None).cast("bigint")
    return paths.select(F.lit("file").alias("kind"), "agent_id", none.alias("document_id"), "path").unionByName(
        rows.select(F.lit("row").alias("kind"), "agent_id", "document_id", "path")
    )


def rows_to_blank(plan, removals):
    """Document rows that may be blanked: all of an agent, unless one of the agent's removals failed."""
    failed = removals.where(~F.col("removed")).select("agent_id").distinct()
    return plan.where(F.col("kind") == "row").join(failed, "agent_id", "left_anti").select("agent_id", "document_id", "path")


def signed_url_lifetime(agents, requests, decisions, now, longest=3600):
    """Seconds a signed URL may live: at most until the audit window ends; expired flag at or past it."""
    latest = latest_requests(requests)
    windows = audit_windows(latest, decisions, now).select("agent_id", "expires_at")
    rows = agents.select("agent_id").join(windows, "agent_id", "left")
    left = F.floor((F.unix_millis("expires_at") - F.unix_millis(at(now))) / 1000).cast("bigint")
    seconds = F.when(F.col("expires_at").isNull(), F.lit(longest).cast("bigint")).otherwise(F.least(F.lit(longest).cast("bigint"), left))
    return rows.select("agent_id", F.greatest(seconds, F.lit(0).cast("bigint")).alias("seconds"), (seconds <= 0).alias("retention_expired"))


def snapshot_changes(before, after, key):
    """Rows of the earlier log snapshot that were changed or removed in the later one.

    One join on the key compares whole rows null-safely; rows that are only new are fine.
    """
    columns = sorted(c for c in before.columns if c != key)
    old = before.select(key, F.struct(*columns).alias("_old"))
    new = after.select(key, F.struct(*columns).alias("_new"))
    rows = old.join(new, key, "left")
    change = F.when(F.col("_new").isNull(), F.lit("removed")).when(~F.col("_old").eqNullSafe(F.col("_new")), F.lit("changed"))
    return rows.select(key, change.alias("change")).where(F.col("change").isNotNull())
