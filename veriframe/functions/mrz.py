"""Column functions over machine-readable-zone text."""

from __future__ import annotations

from pyspark.sql import functions as F

# Character values by position, check weights, and reading confusions both ways.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WEIGHTS = (7, 3, 1)
LETTERS_LIKE_DIGITS, DIGITS_FOR_LETTERS = "OQDILZSBG", "000112586"
DIGITS_LIKE_LETTERS, LETTERS_FOR_DIGITS = "012586", "OIZSBG"


def as_digits(text):
    return F.translate(text, LETTERS_LIKE_DIGITS, DIGITS_FOR_LETTERS)


def as_letters(text):
    return F.translate(text, DIGITS_LIKE_LETTERS, LETTERS_FOR_DIGITS)


def check_digit(field, length):
    """7-3-1 check digit of a field of at most ``length`` characters; fillers and missing characters count 0."""
    weights = F.array(*[F.lit(WEIGHTS[i % 3]) for i in range(length)])
    # an empty character is found at the first place, so it counts 0 like a filler
    value = lambda i: F.greatest(F.position(F.substr(field, i, F.lit(1)), F.lit(ALPHABET)) - 1, F.lit(0))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(length)), F.lit(0), lambda acc, i: acc + value(i) * F.element_at(weights, i))
    return (total % 10).cast("string")


def check_ok(field, digit, length):
    digit = as_digits(digit)
    return digit.rlike("^[0-9]$") & (check_digit(field, length) == digit)


def with_resolved_number(rows, field, digit, number="number", verified="number_ok", length=9):
    """Add the number without fillers and whether it verifies: as read, or with letters read as digits.

    The steps are named columns, so each check digit is computed once per row.
    """
    step = rows.select("*", as_digits(F.col(field)).alias("_fixed"), as_digits(F.col(digit)).alias("_digit"))
    step = step.select("*", check_digit(F.col(field), length).alias("_raw_check"), check_digit(F.col("_fixed"), length).alias("_fixed_check"))
    raw_ok = F.col("_digit").rlike("^[0-9]$") & (F.col("_raw_check") == F.col("_digit"))
    fixed_ok = F.col("_digit").rlike("^[0-9]$") & (F.col("_fixed") != F.col(field)) & (F.col("_fixed_check") == F.col("_digit"))
    step = step.select("*", raw_ok.alias("_raw_ok"), fixed_ok.alias("_fixed_ok"))
    chosen = F.when(~F.col("_raw_ok") & F.col("_fixed_ok"), F.col("_fixed")).otherwise(F.col(field))
    return step.select(
        *rows.columns, F.regexp_replace(chosen, "<+$", "").alias(number), (F.col("_raw_ok") | F.col("_fixed_ok")).alias(verified)
    )


def clean_line(text):
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9<]", "")


def is_candidate(line):
    """Long enough, and either with fillers or dense characters of zone length."""
    dense = line.contains("<") | line.rlike("^[A-Z0-9]{28,44}$")
    return dense & line.rlike("^[A-Z0-9<]{20,50}$")


def digit_count(text):
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def td1_kind(line):
    """Row of a three-line zone judged by shape: dates, document number, or names."""
    dates = F.concat(as_digits(F.substring(line, 1, 15)), as_letters(F.substring(line, 16, 3)))
    number = digit_count(as_digits(F.substring(line, 6, 10))) >= 4
    return (
        F.when(dates.rlike(r"^\d{7}[MF0<]\d{7}[A-Z0-9<]{3}"), F.lit("L2"))
        .when(line.rlike("^[IAC][A-Z0-9<][A-Z0-9]{3}") & number, F.lit("L1"))
        .when(line.contains("<<") & (digit_count(line) <= 2), F.lit("L3"))
    )


def is_td3_data(line):
    p = F.rpad(line, 44, "<")
    piece = lambda start, size: F.substring(p, start + 1, size)
    shaped = F.concat(
        piece(0, 9), as_digits(piece(9, 1)), as_letters(piece(10, 3)), as_digits(piece(13, 7)), as_letters(piece(20, 1)), as_digits(piece(21, 7))
    )
    return shaped.rlike(r"^[A-Z0-9<]{9}\d[A-Z<]{3}\d{7}[MF<]\d{7}")


def is_td3_names(line):
    fillers = F.length(line) - F.length(F.replace(line, F.lit("<"), F.lit("")))
    return (digit_count(line) <= 2) & (fillers >= 3) & line.rlike("^[A-Z][A-Z<]")


def short_date(field, current_year, expiry=False):
    """yymmdd as a date; birth years after the current year fall in the last century."""
    digits = as_digits(field)
    year = 2000 + F.substring(digits, 1, 2).try_cast("int")
    if not expiry:
        year = F.when(year > current_year, year - 100).otherwise(year)
    text = F.concat_ws("-", year.cast("string"), F.substring(digits, 3, 2), F.substring(digits, 5, 2))
    return F.when(digits.rlike(r"^\d{6}$"), F.try_to_date(text, "yyyy-MM-dd"))


def with_names(rows, field):
    """Add surname, given_names and full_names; without a double filler only the full name is known."""
    step = rows.select("*", F.regexp_replace(as_letters(F.col(field)), "^<+|<+$", "").alias("_names"))
    step = step.select("*", F.instr("_names", "<<").alias("_cut"))

    def spaced(part):
        text = F.trim(F.regexp_replace(part, "<+", " "))
        return F.nullif(text, F.lit(""))

    split = F.col("_cut") > 0
    return step.select(
        *rows.columns, F.when(split, spaced(F.substr("_names", F.lit(1), F.col("_cut") - 1))).alias("surname"),
        F.when(split, spaced(F.substr("_names", F.col("_cut") + 2))).alias("given_names"), spaced(F.col("_names")).alias("full_names"),
    )
