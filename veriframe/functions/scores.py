"""Column functions over verification scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from veriframe.schemas import FEATURE_ALIASES, FEATURE_BOUNDS, FEATURES


def plain_number(value):
    """A double as text the way a browser prints it: no trailing ``.0``, no small exponents."""
    text = value.cast("string")
    small = F.regexp_replace(value.cast("decimal(30,17)").cast("string"), r"\.?0+$", "")
    return F.when((F.abs(value) < 1e-3) & (value != 0), small).otherwise(
        F.regexp_replace(text, r"\.0$", "")
    )


def compact_array(*items):
    """Array of the non-null items, in order."""
    return F.filter(F.array(*items), lambda item: item.isNotNull())


def score_errors(columns=FEATURES):
    """Array of error texts for six numeric score columns; empty means valid."""
    checks = []
    for name, (low, high) in zip(columns, FEATURE_BOUNDS):
        value = F.col(name)
        outside = value < low if high is None else (value < low) | (value > high)
        top = "infinity" if high is None else high
        checks.append(
            F.when(value.isNull(), F.lit(f"{name} is required"))
            .when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(f"{name} must be finite"))
            .when(outside, F.lit(f"{name} must be in [{low}, {top}]"))
        )
    return compact_array(*checks)


def with_json_score_errors(rows, body="body", out="errors"):
    """Add the error array of a JSON request body that may use either naming style.

    The body is parsed once per row into a variant column; types are judged on the parsed value, so
    quoted numbers and booleans are refused.
    """
    columns = rows.columns
    parsed = rows.withColumn("_v", F.try_parse_json(body)).withColumn("_keys", F.json_object_keys(body))
    names = list(zip(FEATURES, FEATURE_ALIASES))
    fields = parsed.select(*columns, "_keys", *[
        F.coalesce(F.try_variant_get("_v", f"$.{a}", "variant"), F.try_variant_get("_v", f"$.{b}", "variant")).alias(f"_f{i}")
        for i, (a, b) in enumerate(names)
    ])
    typed = fields.select(*columns, "_keys", *[
        part for i in range(len(names)) for part in (
            F.when(~F.is_variant_null(f"_f{i}"), F.schema_of_variant(f"_f{i}")).alias(f"_t{i}"),
            F.try_variant_get(f"_f{i}", "$", "double").alias(f"_d{i}"),
        )
    ])
    is_object = F.col("_keys").isNotNull()
    known = F.array(*[F.lit(n) for n in FEATURES + FEATURE_ALIASES])
    unknown = F.array_sort(F.array_except("_keys", known))
    checks = [
        F.when(~is_object, F.lit("Request body must be a JSON object")),
        F.when(F.size(unknown) > 0, F.concat(F.lit("Unknown score fields: "), F.array_join(unknown, ", "))),
    ]
    for i, ((name, alias), (low, high)) in enumerate(zip(names, FEATURE_BOUNDS)):
        kind, value = F.col(f"_t{i}"), F.col(f"_d{i}")
        outside = value < low if high is None else (value < low) | (value > high)
        top = "infinity" if high is None else high
        both = F.array_contains("_keys", name) & F.array_contains("_keys", alias)
        checks.append(
            F.when(~is_object, None)
            .when(both, F.lit(f"Provide only one of {name} and {alias}"))
            .when(kind.isNull(), F.lit(f"{name} is required"))
            .when(~kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(f"{name} must be a number"))
            .when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(f"{name} must be finite"))
            .when(outside, F.lit(f"{name} must be in [{low}, {top}]"))
        )
    return typed.select(*columns, compact_array(*checks).alias(out))


def threshold_reject_reasons():
    """Reasons that reject outright. All limits are strict."""
    face, live, ocr, blur = (F.col(c) for c in FEATURES[:4])
    return compact_array(
        F.when(face < 50, F.concat(F.lit("Face match score "), plain_number(face), F.lit(" is below 50.0"))),
        F.when(live < 0.5, F.concat(F.lit("Liveness score "), plain_number(live), F.lit(" is below 0.50"))),
        F.when(ocr < 0.4, F.concat(F.lit("OCR confidence "), plain_number(ocr), F.lit(" is below 0.40"))),
        F.when(
            (blur < 80) & (face < 65),
            F.concat(
                F.lit("Blur score "), plain_number(blur), F.lit(" is below 80.0 and face match "),
                plain_number(face), F.lit(" is below 65.0"),
            ),
        ),
    )


def threshold_decision():
    """verified / review / rejected from the six score columns."""
    face, live, ocr, blur = (F.col(c) for c in FEATURES[:4])
    rejected = (face < 50) | (live < 0.5) | (ocr < 0.4) | ((blur < 80) & (face < 65))
    verified = (face > 80) & (live > 0.75) & (ocr > 0.7)
    return F.when(rejected, F.lit("rejected")).when(verified, F.lit("verified")).otherwise(F.lit("review"))


def threshold_reasons():
    def passed(column, limit, label, shown):
        text = F.concat(F.lit(f"{label} "), plain_number(column))
        return F.when(column > limit, F.concat(text, F.lit(f" is above {shown}"))).otherwise(
            F.concat(text, F.lit(f" is not above {shown}"))
        )

    face, live, ocr = (F.col(c) for c in FEATURES[:3])
    checks = F.array(
        passed(face, 80, "Face match score", "80.0"),
        passed(live, 0.75, "Liveness score", "0.75"),
        passed(ocr, 0.7, "OCR confidence", "0.70"),
    )
    rejects = threshold_reject_reasons()
    between = F.array(F.lit("Scores fall between rejection and verification thresholds"))
    return (
        F.when(F.size(rejects) > 0, rejects)
        .when((face > 80) & (live > 0.75) & (ocr > 0.7), checks)
        .otherwise(F.concat(checks, between))
    )


def outcome_of(value, passing, borderline):
    """PASSED / BORDERLINE / FAILED, inclusive limits; a missing score counts as 0."""
    value = F.coalesce(value, F.lit(0.0))
    return (
        F.when(F.isnan(value), F.lit("FAILED"))
        .when(value >= passing, F.lit("PASSED"))
        .when(value >= borderline, F.lit("BORDERLINE"))
        .otherwise(F.lit("FAILED"))
    )


def clamp(value, low, high):
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def liveness_class(score):
    return (
        F.when(score > 0.75, F.lit("live")).when(score < 0.5, F.lit("spoof")).otherwise(F.lit("borderline"))
    )


def mean4(left, right):
    return F.round((left + right) / 2, 4)


def tone(value, amber, green, range_mode=False):
    if range_mode:
        return F.when((value >= amber) & (value <= green), F.lit("green")).otherwise(F.lit("red"))
    return F.when(value >= green, F.lit("green")).when(value >= amber, F.lit("amber")).otherwise(F.lit("red"))


def percent_of(value, maximum):
    if not maximum:
        return F.lit(0.0)
    return clamp(value / maximum * 100, 0.0, 100.0)


def face_band(face):
    return (
        F.when(face < 25, F.lit("below_25")).when(face <= 50, F.lit("25_through_50")).otherwise(F.lit("above_50"))
    )


def all_of(conditions):
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions):
    return reduce(lambda a, b: a | b, conditions)
