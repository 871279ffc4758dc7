"""Image-quality gate over measured scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions.scores import compact_array

# Blur limits per document kind, frame limits, and the soft-blur factor.
BLUR_LIMITS = {"national_id": 25.0, "passport": 20.0, "drivers_licence": 20.0}
DOCUMENT_LIMITS = {"dark": 30.0, "bright": 248.0, "contrast": 12.0}
SELFIE_LIMITS = {"blur": 2.0, "dark": 10.0, "bright": 245.0, "contrast": 2.0}
DEFAULT_LIMITS = {"blur": 40.0, "dark": 40.0, "bright": 220.0, "contrast": 25.0}
SOFT_FACTOR = 0.6
# Accepted spellings of document kinds.
KIND_ALIASES = {
    "id": "national_id", "id_front": "national_id", "id_back": "national_id", "nationalid": "national_id",
    "national_id": "national_id", "passport": "passport", "drivers_licence": "drivers_licence",
    "drivers_license": "drivers_licence", "driving_licence": "drivers_licence",
    "driving_license": "drivers_licence", "dl": "drivers_licence",
}


def document_kind(kind):
    key = F.translate(F.lower(F.trim(F.coalesce(kind, F.lit("")))), "- ", "__")
    mapping = F.create_map(*[F.lit(part) for pair in KIND_ALIASES.items() for part in pair])
    return F.try_element_at(mapping, key)


def blur_limit(kind):
    mapping = F.create_map(*[F.lit(part) for pair in BLUR_LIMITS.items() for part in pair])
    return F.try_element_at(mapping, F.coalesce(document_kind(kind), F.lit("national_id")))


def _shown(value):
    return F.bround(value, 0).cast("bigint").cast("string")


def _failures(blur, brightness, contrast, limit, dark, bright, flat, soft):
    return compact_array(
        F.when((blur < limit) & ~soft, F.concat(F.lit("Image is too blurry (sharpness "), _shown(blur), F.lit(", needs "), _shown(limit), F.lit(")"))),
        F.when(brightness < dark, F.concat(F.lit("Image is too dark (brightness "), _shown(brightness), F.lit(f", needs at least {dark:.0f})")))
        .when(brightness > bright, F.concat(F.lit("Image is too bright (brightness "), _shown(brightness), F.lit(f", limit {bright:.0f})"))),
        F.when(contrast < flat, F.concat(F.lit("Image has low contrast (contrast "), _shown(contrast), F.lit(f", needs {flat:.0f})"))),
    )


def document_failures(kind, found, blur, brightness, contrast):
    """(failures, warnings) of a document photo; a located, slightly soft one only warns."""
    limit = blur_limit(kind)
    soft = F.coalesce(found, F.lit(False)) & (blur >= limit * SOFT_FACTOR)
    failures = _failures(blur, brightness, contrast, limit, DOCUMENT_LIMITS["dark"], DOCUMENT_LIMITS["bright"], DOCUMENT_LIMITS["contrast"], soft)
    warning = F.when(
        (blur < limit) & soft,
        F.concat(F.lit("Image is a little soft (sharpness "), _shown(blur), F.lit(", ideal "), _shown(limit),
                 F.lit("). It will be tried, but a steadier, better-focused shot reads more reliably.")),
    )
    return failures, compact_array(warning)


def plain_failures(blur, brightness, contrast, limits):
    """Failures of a selfie or of an image without a stated purpose."""
    return _failures(blur, brightness, contrast, F.lit(limits["blur"]), limits["dark"], limits["bright"], limits["contrast"], F.lit(False))


def with_quality_gate(rows):
    """Add document/selfie failures, warnings and the overall verdict."""
    failures, warnings = document_failures(
        F.col("document_kind"), F.col("document_found"), F.col("document_blur"),
        F.col("document_brightness"), F.col("document_contrast"),
    )
    selfie = plain_failures(F.col("selfie_blur"), F.col("selfie_brightness"), F.col("selfie_contrast"), SELFIE_LIMITS)
    rows = rows.select(
        "*", failures.alias("document_failures"), warnings.alias("document_warnings"), selfie.alias("selfie_failures")
    )
    return rows.withColumn("overall_passed", (F.size("document_failures") == 0) & (F.size("selfie_failures") == 0))


def failure_messages(document, selfie):
    """Friendly message per failure, document first."""

    def friendly(side, failure):
        short = F.lower(F.regexp_replace(failure, "^Image ", ""))
        verb = lambda text: F.lit(f"Your {side} is {text}")
        return (
            F.when(short.contains("too blurry"), verb("too blurry")).when(short.contains("too dark"), verb("too dark"))
            .when(short.contains("too bright"), verb("too bright"))
            .when(short.contains("low contrast"), F.lit(f"Your {side} has low contrast"))
            .otherwise(F.concat(F.lit(f"Your {side}: "), short))
        )

    return F.concat(
        F.transform(document, lambda f: friendly("document image", f)), F.transform(selfie, lambda f: friendly("selfie", f))
    )
