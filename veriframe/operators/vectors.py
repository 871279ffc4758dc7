"""Face-vector similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions.scores import clamp
from veriframe.operators.dashboards import describe

MATCH_THRESHOLD = 70


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_score(a, b):
    """Cosine times 100, clamped to 0-100 and rounded; zero vectors and missing vectors score 0."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    score = F.when(norms == 0, F.lit(0.0)).otherwise(clamp(_dot(a, b) / norms * 100, 0.0, 100.0))
    return F.coalesce(F.round(score, 4), F.lit(0.0))


def score_pairs(pairs, embeddings):
    """Score per pair of image ids: two equi joins, each vector read once per side."""
    side = lambda tag: embeddings.select(F.col("vec_id").alias(f"vec_{tag}"), F.col("embedding").alias(f"_{tag}"))
    rows = pairs.join(side("a"), "vec_a", "left").join(side("b"), "vec_b", "left")
    detected = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    scored = rows.select("vec_a", "vec_b", "pair_type", detected.alias("faces_detected"), cosine_score(F.col("_a"), F.col("_b")).alias("score"))
    return scored.withColumn("matched", F.col("faces_detected") & (F.col("score") > MATCH_THRESHOLD))


def similarity_summary(scored):
    """Detection rate and score description per pair type."""
    rate = scored.groupBy("pair_type").agg(F.round(F.avg(F.col("faces_detected").cast("double")), 4).alias("detected_rate"))
    return describe(scored, ["pair_type"], "score").join(rate, "pair_type")
