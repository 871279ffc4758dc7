"""Batch reading of machine-readable zones from tables of text lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veriframe.functions import mrz as m
from veriframe.session import cut_lineage

FIELDS = [
    "format", "variant", "document_code", "issuing_country", "document_number", "id_number_verified", "serial_number", "date_of_birth",
    "sex", "date_of_expiry", "date_of_issue", "nationality", "surname", "given_names", "full_names", "number_ok", "dob_ok", "expiry_ok",
]


def candidate_lines(items, keys=("doc_id",)):
    """Zone-looking lines per document with their place from top to bottom (y, then item order)."""
    lines = items.select(*keys, "y", "item_no", m.clean_line(F.col("text")).alias("line"))
    return lines.where(m.is_candidate(F.col("line")))


def td1_rows(candidates, keys=("doc_id",)):
    """First line of each kind per document (dates row required), in one aggregation."""
    typed = candidates.where(F.length("line").between(22, 34)).withColumn("kind", m.td1_kind(F.col("line")))
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("y", "item_no", "line")))["line"].alias(kind.lower())
    return typed.where(F.col("kind").isNotNull()).groupBy(*keys).agg(first("L1"), first("L2"), first("L3")).where(F.col("l2").isNotNull())


def _with_dates(rows, current_year):
    """Add parsed dates, their checks and the sex from the cut fields b, b_check, e, e_check and sex_mark."""
    step = rows.select("*", *[m.as_digits(F.col(c)).alias(f"_{c}") for c in ("b", "b_check", "e", "e_check")], m.as_letters(F.col("sex_mark")).alias("_sex"))
    ok = lambda c: F.col(f"_{c}_check").rlike("^[0-9]$") & (m.check_digit(F.col(f"_{c}"), 6) == F.col(f"_{c}_check"))
    return step.select(
        *rows.columns, m.short_date(F.col("_b"), current_year).alias("date_of_birth"), m.short_date(F.col("_e"), current_year, expiry=True).alias("expires"),
        ok("b").alias("dob_ok"), ok("e").alias("expiry_ok"), F.when(F.col("_sex").isin("M", "F"), F.col("_sex")).alias("sex"),
    )


def _cut(line, start, end):
    return F.substring(line, start + 1, end - start)


def parse_td1(rows, current_year, keys=("doc_id",)):
    """Fields of three-line zones, with the older national layout told apart."""
    padded = rows.select(*keys, F.rpad("l1", 30, "<").alias("l1"), F.rpad("l2", 30, "<").alias("l2"), F.rpad(F.coalesce("l3", F.lit("<")), 30, "<").alias("l3"))
    cut = padded.select(
        *keys, "l3", F.col("l1").isNotNull().alias("known"), _cut("l1", 5, 14).alias("n"), _cut("l1", 14, 15).alias("n_check"),
        m.as_letters(_cut("l1", 0, 2)).alias("document_code"), m.as_letters(_cut("l1", 2, 5)).alias("issuing_country"),
        _cut("l2", 0, 6).alias("b"), _cut("l2", 6, 7).alias("b_check"), _cut("l2", 7, 8).alias("sex_mark"), _cut("l2", 8, 14).alias("e"), _cut("l2", 14, 15).alias("e_check"),
        m.as_letters(_cut("l2", 15, 18)).alias("nationality"), F.regexp_extract(m.as_digits(_cut("l2", 18, 29)), r"^\d{6,10}", 0).alias("optional"),
    )
    full = m.with_names(_with_dates(m.with_resolved_number(cut, "n", "n_check"), current_year), "l3")
    old = (F.coalesce(F.col("issuing_country") == "KYA", F.lit(False)) | ~F.col("nationality").rlike("^[A-Z]{3}$")) & (F.col("optional") != "")
    full = full.select("*", old.alias("old"), F.when(F.col("known") & (F.col("number") != ""), F.col("number")).alias("read_number"))
    pick = lambda yes, no: F.when(F.col("old"), yes).otherwise(no)
    return full.select(
        *keys, F.lit("TD1").alias("format"), pick(F.lit("kenya_old"), F.lit("standard")).alias("variant"), "document_code", "issuing_country",
        pick(F.col("optional"), F.col("read_number")).alias("document_number"), (~F.col("old") & F.coalesce("number_ok", F.lit(False))).alias("id_number_verified"),
        F.when(F.col("old"), F.col("read_number")).alias("serial_number"), "date_of_birth", "sex", F.when(~F.col("old"), F.col("expires")).alias("date_of_expiry"),
        F.when(F.col("old"), F.col("expires")).alias("date_of_issue"), "nationality", "surname", "given_names", "full_names",
        F.when(F.col("known"), F.col("number_ok")).alias("number_ok"), "dob_ok", "expiry_ok",
    )


def td3_rows(candidates, keys=("doc_id",)):
    """Data lines of two-line zones with the names line directly above them, if it looks like one."""
    lines = candidates.where(F.length("line").between(36, 48))
    order = Window.partitionBy(*keys).orderBy("y", "item_no")  # lines of one document
    above = F.lag("line").over(order)
    rows = lines.withColumn("above", above).where(m.is_td3_data(F.col("line")))
    return rows.select(*keys, "y", "item_no", F.when(m.is_td3_names(F.col("above")), F.col("above")).alias("l1"), F.col("line").alias("l2"))


def parse_td3(rows, current_year, keys=("doc_id",)):
    """Fields of two-line zones; the first data line with a birth date or a verified number counts."""
    padded = rows.select(*keys, "y", "item_no", F.rpad("l1", 44, "<").alias("l1"), F.rpad("l2", 44, "<").alias("l2"))
    cut = padded.select(
        *keys, "y", "item_no", _cut("l1", 5, 44).alias("name_part"), m.as_letters(_cut("l1", 0, 2)).alias("document_code"), m.as_letters(_cut("l1", 2, 5)).alias("issuing_country"),
        _cut("l2", 0, 9).alias("n"), _cut("l2", 9, 10).alias("n_check"), m.as_letters(_cut("l2", 10, 13)).alias("nationality"),
        _cut("l2", 13, 19).alias("b"), _cut("l2", 19, 20).alias("b_check"), _cut("l2", 20, 21).alias("sex_mark"), _cut("l2", 21, 27).alias("e"), _cut("l2", 27, 28).alias("e_check"),
    )
    full = m.with_names(_with_dates(m.with_resolved_number(cut, "n", "n_check"), current_year), "name_part")
    parsed = full.select(
        *keys, "y", "item_no", F.lit("TD3").alias("format"), F.lit("standard").alias("variant"), "document_code", "issuing_country",
        F.nullif("number", F.lit("")).alias("document_number"), F.col("number_ok").alias("id_number_verified"), F.lit(None).cast("string").alias("serial_number"), "date_of_birth", "sex",
        F.col("expires").alias("date_of_expiry"), F.lit(None).cast("date").alias("date_of_issue"), "nationality", "surname", "given_names", "full_names", "number_ok", "dob_ok", "expiry_ok",
    )
    usable = parsed.where(F.col("date_of_birth").isNotNull() | F.col("number_ok"))
    first = usable.groupBy(*keys).agg(F.min(F.struct("y", "item_no", *FIELDS)).alias("_r"))
    return first.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in FIELDS])


def with_validity(zones):
    """valid: everything that was read verifies; an unread number line is no failure."""
    valid = F.coalesce(F.col("number_ok"), F.lit(True)) & F.col("dob_ok") & F.col("expiry_ok")
    passed = sum(F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("number_ok", "dob_ok", "expiry_ok"))
    return zones.select("*", valid.alias("valid"), passed.alias("checks_passed"))


def parse_zones(items, current_year, keys=("doc_id",)):
    """Zone per document: the three-line form when one of its dates verifies, else the two-line form.

    Candidate lines are found once and written; both forms and their choice stay partitioned by document.
    """
    lines = cut_lineage(candidate_lines(items, keys), "zone-lines")
    td1 = parse_td1(td1_rows(lines, keys), current_year, keys).where(F.col("dob_ok") | F.col("expiry_ok"))
    td3 = parse_td3(td3_rows(lines, keys), current_year, keys)
    both = td1.withColumn("_p", F.lit(0)).unionByName(td3.withColumn("_p", F.lit(1)))
    best = both.groupBy(*keys).agg(F.min(F.struct("_p", *FIELDS)).alias("_r"))
    return with_validity(best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in FIELDS]))


def merge_reads(zones, keys=("doc_id",)):
    """Reads 0 and 1 of one zone merged: every checked field from the read that verified it, other fields from read 0 first."""
    read = lambda k, name: F.max(F.when(F.col("read_no") == k, F.struct(*FIELDS))).alias(name)
    rows = zones.groupBy(*keys).agg(read(0, "p"), read(1, "s"))
    both = F.col("p").isNotNull() & F.col("s").isNotNull()
    verified = {"document_number": "number_ok", "date_of_birth": "dob_ok", "date_of_expiry": "expiry_ok"}
    true = lambda side, check: F.coalesce(F.col(f"{side}.{check}"), F.lit(False))
    rows = rows.select("*", both.alias("_both"), *[(~true("p", c) & true("s", c)).alias(f"_better_{c}") for c in verified.values()])
    better = lambda check: F.col(f"_better_{check}")
    fill = {"surname", "given_names", "full_names", "serial_number", "date_of_issue", "sex", "nationality"}

    def merged(name):
        first, second = F.col(f"p.{name}"), F.col(f"s.{name}")
        if name in verified:
            return F.when(better(verified[name]), second).otherwise(first)
        if name in verified.values():
            return F.when(better(name), F.lit(True)).otherwise(first)
        if name == "id_number_verified":
            return F.when(better("number_ok"), second).otherwise(first)
        return F.coalesce(first, second) if name in fill else first

    choose = lambda name: F.when(F.col("_both"), merged(name)).otherwise(F.coalesce(F.col(f"p.{name}"), F.col(f"s.{name}"))).alias(name)
    return with_validity(rows.select(*keys, *[choose(name) for name in FIELDS]))
