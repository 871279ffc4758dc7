"""Passkey rules: fixed-window rate buckets, single-use challenges, counters, removal protection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from veriframe.operators.keyed import running
from veriframe.session import cut_lineage

BUCKET_SECONDS = 300
_CHUNK_SECONDS = 6 * 3600


def _openers(times, expiry, width):
    """Opening hit of each hit's bucket. ``expiry`` closes the bucket carried in (or None)."""
    openers = np.empty(len(times), dtype=np.int64)
    i = 0
    if expiry is not None:
        i = int(np.searchsorted(times, expiry, side="right"))
        openers[:i] = expiry - width
    while i < len(times):
        end = times[i] + width
        j = int(np.searchsorted(times, end, side="right"))
        openers[i:j] = times[i]
        i = j
    return openers


def _closing_times(times, closes, width):
    """Closing time of the last bucket for each closing time carried in.

    Every hit points to the hit that would open the next bucket; following the pointers by doubling gives the last
    opener of every chain at once.
    """
    count = len(times)
    following = np.searchsorted(times, times + width, side="right")
    last = np.where(following < count, following, np.arange(count))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    start = np.searchsorted(times, closes, side="right")
    return np.where(start < count, times[last[np.minimum(start, count - 1)]] + width, closes)


def rate_buckets(hits, limit, width_seconds=BUCKET_SECONDS, chunk_seconds=_CHUNK_SECONDS):
    """Attempts and verdict per hit: the first hit opens a bucket, later hits add until it expires.

    ``hits``: hit_id, bucket, ts. A bucket's log is cut into time chunks. Each chunk is summarised as
    "closing time carried in → closing time carried out"; only these short summaries are chained per
    bucket, then every chunk is numbered on its own. No task sees all hits of a busy bucket.
    """
    width = width_seconds * 1000000
    span = chunk_seconds * 1000000
    moments = hits.select("bucket", F.unix_micros("ts").alias("_at")).groupBy("bucket", "_at").agg(F.count(F.lit(1)).alias("_n"))
    moments = moments.withColumn("_chunk", F.floor(F.col("_at") / span).cast("bigint"))

    def summarise(key, rows):
        times = np.sort(rows["_at"].to_numpy())
        # a bucket still open at the start of the chunk closes inside its first ``width``
        head = times[times <= key[1] * span + width]
        carried = np.concatenate([[key[1] * span - 1], head])
        out = _closing_times(times, carried, width)
        new = np.concatenate([[True], out[1:] != out[:-1]])
        first = np.where(np.arange(len(carried)) == 0, np.iinfo(np.int64).min, carried)
        return pd.DataFrame({"bucket": key[0], "_chunk": key[1], "_from": first[new], "_out": out[new]})

    steps = moments.groupBy("bucket", "_chunk").applyInPandas(summarise, "bucket string, _chunk bigint, _from bigint, _out bigint")

    def chain(key, rows):
        rows = rows.sort_values(["_chunk", "_from"])
        carried, chunks, carries = np.iinfo(np.int64).min, [], []
        for chunk, step in rows.groupby("_chunk", sort=True):
            chunks.append(chunk)
            carries.append(carried)
            at_step = int(np.searchsorted(step["_from"].to_numpy(), carried, side="right")) - 1
            carried = int(step["_out"].to_numpy()[at_step])
        return pd.DataFrame({"bucket": key[0], "_chunk": chunks, "_carry": carries})

    carries = steps.groupBy("bucket").applyInPandas(chain, "bucket string, _chunk bigint, _carry bigint")

    def number(key, rows):
        rows = rows.sort_values("_at")
        carry = int(rows["_carry"].iloc[0])
        opener = _openers(rows["_at"].to_numpy(), None if carry == np.iinfo(np.int64).min else carry, width)
        return pd.DataFrame({"bucket": key[0], "_at": rows["_at"].to_numpy(), "_opener": opener})

    opened = moments.join(carries, ["bucket", "_chunk"]).select("bucket", "_chunk", "_at", "_carry").groupBy("bucket", "_chunk").applyInPandas(
        number, "bucket string, _at bigint, _opener bigint"
    )
    # the numbering below reads its input twice
    rows = cut_lineage(hits.withColumn("_at", F.unix_micros("ts")).join(opened, ["bucket", "_at"]), "opened-hits")
    counted = running(rows, ["bucket", "_opener"], ["_at", "hit_id"], F.floor((F.col("_at") - F.col("_opener")) / 10000000), F.lit(1), "sum", "attempts")
    return counted.select(
        "hit_id", "bucket", "ts", F.timestamp_micros("_opener").alias("opened_at"), F.col("attempts").cast("bigint").alias("attempts"),
        (F.col("attempts") <= limit).alias("allowed"),
    )


def consume_challenges(uses, challenges):
    """Outcome per use of a challenge: the first use takes it, whatever its outcome.

    ok / wrong_purpose_or_user / expired / missing. The first use per challenge is one aggregated
    minimum, so replays of one challenge are never gathered.
    """
    first = uses.groupBy("challenge_id").agg(F.min(F.struct("used_at", "use_id"))["use_id"].alias("_first"))
    known = challenges.select(
        F.col("id").alias("challenge_id"), F.col("purpose").alias("_purpose"), F.col("user_id").alias("_user"), "expires_at"
    )
    rows = uses.join(known, "challenge_id", "left").join(first, "challenge_id")
    same = (F.col("purpose") == F.col("_purpose")) & F.col("user_id").eqNullSafe(F.col("_user"))
    outcome = (
        F.when(F.col("_purpose").isNull() | (F.col("use_id") != F.col("_first")), F.lit("missing"))
        .when(~same, F.lit("wrong_purpose_or_user")).when(F.col("expires_at") <= F.col("used_at"), F.lit("expired"))
        .otherwise(F.lit("ok"))
    )
    return rows.select("use_id", "challenge_id", outcome.alias("outcome"))


def uses_within_expiry(uses, challenges):
    """Interval join: uses that fall before their challenge expires and after it was issued."""
    known = challenges.select(F.col("id").alias("challenge_id"), "expires_at")
    return uses.join(known, "challenge_id").where(
        (F.col("used_at") < F.col("expires_at")) & (F.col("used_at") >= F.col("expires_at") - F.expr("interval '5' minute"))
    )


def counter_regressions(uses, passkeys):
    """Verdict per credential use: refused unless the counter grows (two zero counters are fine).

    A refused use leaves the counter alone and an accepted one raises it, so the value to beat is the
    running maximum of earlier counters, cut by day.
    """
    start = passkeys.select(F.col("id").alias("passkey_id"), F.col("counter").alias("_start"))
    rows = uses.join(start, "passkey_id")
    rows = running(
        rows, ["passkey_id"], ["ts", "use_id"], F.to_date("ts"), F.col("new_counter"), "max", "_seen", include_current=False
    )
    current = F.greatest("_start", F.coalesce("_seen", F.col("_start")))
    regressed = ((F.col("new_counter") > 0) | (current > 0)) & (F.col("new_counter") <= current)
    return rows.select("use_id", "passkey_id", "new_counter", current.alias("current_counter"), regressed.alias("rejected"))


def removal_verdicts(removals, passkeys, login_methods):
    """not_found / last_method / removed per asked removal, judged one by one (nothing is deleted)."""
    counts = passkeys.groupBy(F.col("user_id").alias("owner_id")).agg(F.count(F.lit(1)).alias("_remaining"))
    owned = passkeys.select(F.col("user_id").alias("owner_id"), F.col("id").alias("passkey_id"), F.lit(True).alias("_owned"))
    other = login_methods.groupBy(F.col("user_id").alias("owner_id")).agg(
        F.bool_or(F.coalesce(F.col("encrypted_password") != "", F.lit(False)) | F.col("has_identity")).alias("_other")
    )
    rows = removals.join(owned, ["owner_id", "passkey_id"], "left").join(counts, "owner_id", "left").join(other, "owner_id", "left")
    verdict = (
        F.when(F.col("_owned").isNull(), F.lit("not_found"))
        .when((F.col("_remaining") <= 1) & ~F.coalesce("_other", F.lit(False)), F.lit("last_method")).otherwise(F.lit("removed"))
    )
    return rows.select("removal_id", "owner_id", "passkey_id", verdict.alias("verdict"))
