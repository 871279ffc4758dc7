"""Writers: audit export, audit append, measurements, manifests, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.operators.directory import by_agent_name, in_date_range, with_agent_name
from veriframe.schemas import TABLES


def export_rows(logs, agents, start=None, end=None, agent_id=None, action=None, agent_name=None, limit=None):
    """Matching audit rows for the export, newest first; with ``limit`` only that many of the newest.

    Filters run before the top-k, and names are looked up only for the rows that remain.
    """
    rows = in_date_range(logs, start, end)
    if agent_id is not None:
        rows = rows.where(F.col("agent_id") == agent_id)
    if action:
        rows = rows.where(F.col("action") == action)
    if agent_name:
        rows = by_agent_name(rows, agents, agent_name)
    rows = rows.select("ts", "log_id", "agent_id", "action", "outcome")
    if limit is not None:
        rows = rows.orderBy(F.desc("ts"), F.desc("log_id")).limit(limit)
    named = with_agent_name(rows, agents)
    return named.orderBy(F.desc("ts"), F.desc("log_id")).select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("Timestamp"),
        F.coalesce(F.col("agent_id").cast("string"), F.lit("")).alias("AgentID"),
        F.col("agent_name").alias("AgentName"), F.col("action").alias("Action"), F.col("outcome").alias("Outcome"),
    )


def csv_field(value):
    """Quote only values with a comma, quote or line break; inner quotes are doubled."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(
        text.rlike(r'[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    ).otherwise(text)


def csv_lines(rows):
    """The export as text lines with their number; line 0 is the header, also when no row matches."""
    header = rows.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("place"), F.lit(",".join(rows.columns)).alias("line"))
    return header.unionByName(rows.select(F.monotonically_increasing_id().alias("place"), F.concat_ws(",", *[csv_field(F.col(c)) for c in rows.columns]).alias("line")))


def write_export(rows, path):
    rows.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)


def audit_payload(entries, now):
    """Valid audit rows: action and outcome are required, empty optionals become null.

    ``entries``: agent_id, request_id, action, outcome, details (struct, map or JSON text),
    performed_by, ip_address, device_fingerprint.
    """
    blank = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    details = F.col("details")
    if entries.schema["details"].dataType.simpleString() != "string":
        details = F.to_json(details)
    valid = entries.where(
        F.coalesce((F.col("action") != "") & (F.col("outcome") != ""), F.lit(False))
    )
    return valid.select(
        blank("agent_id").alias("agent_id"), blank("request_id").alias("request_id"), "action", "outcome",
        details.alias("details"), F.col("performed_by").cast("string").alias("performed_by"),
        blank("ip_address").cast("string").alias("ip_address"),
        blank("device_fingerprint").cast("string").alias("device_fingerprint"),
        F.lit(now).cast("timestamp").alias("ts"),
    )


def append_audit(entries, path, now):
    """Append valid audit rows below ``path``, split by day so look-back filters prune folders."""
    rows = audit_payload(entries, now).withColumn("day", F.to_date("ts"))
    rows.write.mode("append").partitionBy("day").parquet(path)


def read_audit(spark, path):
    return spark.read.schema(TABLES["audit_logs"]).parquet(path)


def write_measurements(rows, path, format="parquet"):
    """Per-sample measurement rows as CSV (with header) or parquet."""
    writer = rows.write.mode("overwrite")
    writer = writer.option("header", True) if format == "csv" else writer
    writer.format(format).save(path)


def write_report(rows, path, run_id, format="json"):
    """Manifest, candidate or report rows, one folder per run."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").format(format).save(path)


def fingerprint(rows, columns=None):
    """Row count and an order-independent digest of a table.

    Each row's digest becomes a number and the numbers are added, so no sort is needed.
    """
    names = sorted(columns or rows.columns)
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in names])
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    totals = rows.select(number.alias("_h")).agg(F.count(F.lit(1)).alias("n"), F.sum("_h").alias("_s"))
    digest = F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.coalesce(F.col("_s").cast("string"), F.lit("0"))), 256)
    return totals.select("n", digest.alias("sha256"))
