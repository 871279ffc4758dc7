"""Guardrails over the audit log: look-back counts, verdicts, strikes, flagged registrations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veriframe.functions.clock import at, plus_seconds, retry_after_seconds
from veriframe.operators.directory import latest_requests
from veriframe.operators.keyed import running
from veriframe.schemas import BLOCKED_EMAIL_DOMAINS, LOOKBACK_HOURS, MAX_FAILURES, MAX_STRIKES


def email_domain(email):
    parts = F.split(F.lower(F.trim(email)), "@")
    return F.when((F.size(parts) == 2) & (F.get(parts, F.lit(1)) != ""), F.get(parts, F.lit(1)))


def is_blocked_domain(email, blocked=tuple(BLOCKED_EMAIL_DOMAINS)):
    """True for a blocked domain or any of its sub-domains; malformed addresses are not blocked."""
    domain = email_domain(email)
    hits = [(domain == b) | domain.endswith("." + b) for b in blocked]
    result = hits[0]
    for hit in hits[1:]:
        result = result | hit
    return F.coalesce(result, F.lit(False))


def client_ip(forwarded, remote):
    """First entry of a forwarded-for list, else the connection address."""
    first = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.when(F.trim(forwarded) != "", first).otherwise(remote)


def duplicate_identities(agents, requests):
    """Agents sharing a trimmed national id with another agent, with that agent's latest status.

    The group's smallest and largest agent id are enough to name another owner, so no pairs are built.
    """
    people = agents.select("agent_id", F.trim("national_id").alias("national_id")).where(F.col("national_id") != "")
    groups = people.groupBy("national_id").agg(
        F.min("agent_id").alias("_low"), F.max("agent_id").alias("_high"), F.count(F.lit(1)).alias("owners")
    ).where("_low <> _high")
    shared = people.join(groups, "national_id").select(
        "agent_id", "national_id", "owners",
        F.when(F.col("agent_id") == F.col("_low"), F.col("_high")).otherwise(F.col("_low")).alias("conflicting_agent_id"),
    )
    status = latest_requests(requests).select(
        F.col("agent_id").alias("conflicting_agent_id"), F.col("status").alias("conflicting_status")
    )
    rows = shared.join(status, "conflicting_agent_id", "left").withColumn(
        "conflicting_status", F.coalesce("conflicting_status", F.lit("pending"))
    )
    return rows.withColumn("message", conflict_message(F.col("conflicting_status")))


def conflict_message(status):
    return (
        F.when(status == "verified", F.lit("This national ID is already registered to a verified agent"))
        .when(status == "rejected", F.lit("This national ID has been previously rejected. Please contact support."))
        .otherwise(F.lit("A registration with this national ID is already in progress"))
    )


def counted_failures(logs):
    """Rows that count towards the limits: every guardrail row and failed starts."""
    return logs.where(
        (F.col("action") == "FRAUD_GUARDRAIL_TRIGGERED")
        | ((F.col("action") == "VERIFICATION_INITIATED") & (F.col("outcome") == "FAILED"))
    )


def failures_in_window(logs, key, now, hours=LOOKBACK_HOURS):
    """Count and oldest time per key in the window that ends at ``now``."""
    moment = at(now)
    recent = counted_failures(logs).where(
        (F.col("ts") >= plus_seconds(moment, -hours * 3600)) & (F.col("ts") <= moment) & F.col(key).isNotNull()
    )
    return recent.groupBy(key).agg(F.count(F.lit(1)).alias("failures"), F.min("ts").alias("oldest"))


def rolling_failures(logs, key, hours=LOOKBACK_HOURS):
    """For each counted row: failures of its key within the window ending at that row (inclusive).

    Each row enters at its time and leaves just after the window; a running sum of both gives the
    count. The sum is cut by hour, so even one address with most of the log is spread over tasks.
    """
    rows = counted_failures(logs).where(F.col(key).isNotNull()).select("log_id", key, "ts")
    enter = rows.select("log_id", key, F.unix_micros("ts").alias("_at"), F.lit(1).alias("_delta"))
    # leaves one microsecond after the last moment it still counts
    leave = rows.select(
        F.lit(None).cast("bigint").alias("log_id"), key,
        (F.unix_micros("ts") + (hours * 3600 * 1000000 + 1)).alias("_at"), F.lit(-1).alias("_delta"),
    )
    # rows of one moment all count for each other: add up per moment before running
    moments = enter.unionByName(leave).groupBy(key, "_at").agg(F.sum("_delta").alias("_delta"))
    counted = running(
        moments, [key], ["_at"], F.floor(F.col("_at") / 3600000000), F.col("_delta"), "sum", "failures"
    )
    return enter.drop("_delta").join(counted.select(key, "_at", "failures"), [key, "_at"]).select(
        "log_id", key, F.timestamp_micros("_at").alias("ts"), F.col("failures").cast("bigint").alias("failures")
    )


def guardrail_verdicts(registrations, agents, requests, logs, now, hours=LOOKBACK_HOURS, limit=MAX_FAILURES):
    """First matching guardrail per registration: domain, duplicate id, address, device.

    ``registrations``: agent_id, email, national_id, ip_address, device_fingerprint.
    """
    moment = at(now)
    # a registration conflicts when another agent already holds its national id
    people = agents.select("agent_id", F.trim("national_id").alias("_nid"))
    owners = people.groupBy("_nid").agg(F.min("agent_id").alias("_low"), F.max("agent_id").alias("_high"))
    other = F.when(F.col("_low") != F.col("agent_id"), F.col("_low")).when(F.col("_high") != F.col("agent_id"), F.col("_high"))
    rows = registrations.withColumn("_nid", F.trim("national_id")).join(owners, "_nid", "left").withColumn("_other", other)
    status = latest_requests(requests).select(F.col("agent_id").alias("_other"), F.col("status").alias("_status"))
    rows = rows.join(status, "_other", "left")
    for key, tag in (("ip_address", "ip"), ("device_fingerprint", "device")):
        counts = failures_in_window(logs, key, now, hours).select(
            key, F.col("failures").alias(f"_{tag}_n"), F.col("oldest").alias(f"_{tag}_oldest")
        )
        rows = rows.join(counts, key, "left")
    verdict = lambda kind, code, n, message, oldest: F.struct(
        F.lit(kind).alias("guardrail_type"), F.lit(code).alias("code"), n.cast("bigint").alias("attempt_count"), message.alias("message"),
        oldest.alias("retry_after"),
    )
    no_retry = F.lit(None).cast("bigint")
    wait = lambda where: F.lit(f"Too many failed attempts from this {where}. Please try again in {hours} hours.")
    chosen = F.coalesce(
        F.when(is_blocked_domain(F.col("email")), verdict("blocked_email_domain", 400, F.lit(1), F.lit("Please use a valid permanent email address to register"), no_retry)),
        F.when((F.col("_nid") != "") & F.col("_other").isNotNull(), verdict("duplicate_national_id", 409, F.lit(1), conflict_message(F.coalesce("_status", F.lit("pending"))), no_retry)),
        F.when(F.col("_ip_n") >= limit, verdict("ip_rate_limit", 429, F.col("_ip_n"), wait("location"), retry_after_seconds(F.col("_ip_oldest"), moment, hours))),
        F.when(F.col("_device_n") >= limit, verdict("device_fingerprint_rate_limit", 429, F.col("_device_n"), wait("device"), retry_after_seconds(F.col("_device_oldest"), moment, hours))),
    )
    return rows.select("agent_id", chosen.alias("_v")).select("agent_id", "_v.*")


def last_resets(logs, newest=None):
    """Last strike reset per agent; with ``newest`` only among that many of its newest approvals.

    The rank filter is pushed below the shuffle, so each task sends at most ``newest`` rows per agent.
    """
    reset = F.get_json_object("details", "$.strikesReset") == "true"
    if newest is None:
        found = logs.where((F.col("action") == "ADMIN_APPROVED") & F.col("agent_id").isNotNull() & reset)
        return found.groupBy("agent_id").agg(F.max("ts").alias("reset_at"))
    order = Window.partitionBy("agent_id").orderBy(F.desc("ts"), F.desc("log_id"))
    approvals = logs.where((F.col("action") == "ADMIN_APPROVED") & F.col("agent_id").isNotNull()).select("agent_id", "ts", "log_id", "details")
    ranked = approvals.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= newest)
    return ranked.where(reset).groupBy("agent_id").agg(F.max("ts").alias("reset_at"))


def strike_counts(logs, now, hours=LOOKBACK_HOURS):
    """Strikes per agent since the later of window start and last reset (as-of join on the reset)."""
    moment = at(now)
    start = plus_seconds(moment, -hours * 3600)
    known = logs.where(F.col("ts") <= moment)
    kind = F.get_json_object("details", "$.guardrailType")
    strikes = known.where(
        (F.col("action") == "FRAUD_GUARDRAIL_TRIGGERED") & (F.col("ts") >= start) & (kind == "verification_strike")
    ).select("agent_id", "ts")
    rows = strikes.join(last_resets(known), "agent_id", "left")
    since = F.when(F.col("reset_at") > start, F.col("reset_at")).otherwise(start)
    return rows.where(F.col("ts") >= since).groupBy("agent_id").agg(F.count(F.lit(1)).alias("strikes"))


def auto_rejections(logs, requests, now, limit=MAX_STRIKES):
    """Agents at the strike limit: their latest request turns rejected; details for the audit row."""
    over = strike_counts(logs, now).where(F.col("strikes") >= limit)
    latest = latest_requests(requests).select("agent_id", "request_id", F.col("status").alias("old_status"))
    details = F.to_json(F.struct(
        F.lit("Maximum verification attempts exceeded").alias("reason"), F.col("strikes").alias("strikeCount"), F.lit(limit).alias("threshold")
    ))
    changed = F.coalesce(F.col("old_status") != "rejected", F.lit(False))
    return over.join(latest, "agent_id", "left").select(
        "agent_id", "strikes", "request_id", "old_status", F.when(F.col("request_id").isNotNull(), F.lit("rejected")).alias("new_status"),
        changed.alias("changed"), F.lit("ACCESS_DENIED").alias("action"), F.lit("REJECTED").alias("outcome"), details.alias("details"),
    )


def strike_resets(agents, logs, now, performed_by="system"):
    """Reset rows with the strike count they clear, one per agent asked for."""
    counts = strike_counts(logs, now)
    details = F.to_json(F.struct(
        F.lit(True).alias("strikesReset"), F.col("previous_count").alias("previousStrikeCount"),
        F.lit("Administrator reset verification strike count").alias("note"),
    ))
    rows = agents.select("agent_id").join(counts, "agent_id", "left").withColumn("previous_count", F.coalesce("strikes", F.lit(0)))
    return rows.select(
        "agent_id", "previous_count", F.lit("ADMIN_APPROVED").alias("action"), F.lit("SUCCESS").alias("outcome"),
        F.lit(performed_by).alias("performed_by"), details.alias("details"),
    )


def flagged_entries(logs, now, days=7):
    """Guardrail rows of the last days with address, device, type and attempts normalised."""
    moment = at(now)
    json = lambda name: F.get_json_object("details", f"$.{name}")
    rows = logs.where(
        (F.col("action") == "FRAUD_GUARDRAIL_TRIGGERED") & (F.col("ts") >= plus_seconds(moment, -days * 86400)) & (F.col("ts") <= moment)
    )
    return rows.select(
        "log_id", "ts", "agent_id", F.coalesce("ip_address", json("ipAddress")).alias("ip_address"),
        F.coalesce("device_fingerprint", json("deviceFingerprint")).alias("device_fingerprint"),
        F.coalesce(json("guardrailType"), json("guardrail"), F.lit("unknown")).alias("guardrail_type"),
        F.coalesce(json("attemptCount"), json("failureCount")).cast("bigint").alias("attempt_count"), "outcome",
    )


def flagged_by_address(entries):
    """Entries with their address group and the group's size, largest group first.

    Entries stay rows beside the group count instead of one nested list per address.
    """
    rows = entries.withColumn("group_ip", F.coalesce("ip_address", F.lit("unknown")))
    counts = rows.groupBy("group_ip").agg(F.count(F.lit(1)).alias("group_count"))
    return rows.join(counts, "group_ip").orderBy(F.desc("group_count"), "group_ip", F.desc("ts"))
