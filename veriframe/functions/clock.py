"""Time arithmetic: business-day windows, retry delays, exact look-back limits."""

from __future__ import annotations

from pyspark.sql import functions as F


def at(moment):
    """A clock parameter as a timestamp column (text, datetime or column)."""
    return F.to_timestamp(F.lit(moment)) if isinstance(moment, str) else F.lit(moment)


def plus_seconds(ts, seconds):
    return ts + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))


def audit_expiry(verified_at):
    """Three Nairobi business days later at the same time of day (closed form by local weekday).

    Nairobi has been UTC+3 without daylight saving since 1960, so a fixed shift is exact.
    """
    local_day = F.dayofweek(verified_at + F.expr("interval '3' hour"))  # 1 = Sunday
    days = F.when(local_day.isin(4, 5, 6), 5).when(local_day == 7, 4).otherwise(3)
    return verified_at + F.make_dt_interval(days=days)


def audit_window(status, final_decision, decided_at, now):
    """(verified_at, expires_at, open) columns; open from verification until just before expiry."""
    verified_at = F.when((status == "verified") & (final_decision == "verified"), decided_at)
    expires_at = audit_expiry(verified_at)
    is_open = F.coalesce((verified_at <= now) & (expires_at > now), F.lit(False))
    return verified_at, expires_at, is_open


def retry_after_seconds(oldest, now, hours):
    """Whole seconds until the oldest counted failure leaves the look-back window, at least 1."""
    waited = (F.unix_millis(oldest) + hours * 3600000 - F.unix_millis(now)) / 1000
    return F.when(oldest.isNull(), F.lit(hours * 3600).cast("bigint")).otherwise(
        F.greatest(F.lit(1).cast("bigint"), F.ceil(waited).cast("bigint"))
    )
