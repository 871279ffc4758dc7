"""Splits, scaling, policies and calibrated model selection."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import functions as F

from veriframe.operators.evaluation import CELLS, calibration_scores, summary
from veriframe.operators.keyed import hash_rank
from veriframe.schemas import CLASSES, FEATURES
from veriframe.session import cut_lineage

SPLITS = (("train", 0.7), ("validation", 0.85), ("test", 1.0))


def stratified_split(rows, key, target="target", seed=42, parts=SPLITS):
    """Disjoint train/validation/test split with the same class shares, by hash order within class."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    ranked = hash_rank(rows, [target], digest, key, "_rank")
    sizes = rows.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked.join(F.broadcast(sizes), target)  # one row per class
    split = F.lit(parts[-1][0])
    for name, share in reversed(parts[:-1]):
        split = F.when(F.col("_rank") <= F.floor(F.col("_n") * share + 0.5), F.lit(name)).otherwise(split)
    return ranked.withColumn("split", split).drop("_rank", "_n")


def folds(rows, key, k=5, target="target", seed=42):
    """Stratified fold number 0..k-1 per row."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(f"fold{seed}")))
    return hash_rank(rows, [target], digest, key, "_rank").withColumn("fold", F.col("_rank") % k).drop("_rank")


def class_weights(rows, target="target"):
    """Balanced weight n / (k * n_c) per row."""
    sizes = rows.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    weights = sizes.crossJoin(F.broadcast(total)).select(target, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return rows.join(F.broadcast(weights), target)  # one row per class


def fit_min_max(train, features=FEATURES):
    """One row with minimum and maximum per feature."""
    return train.agg(*[f(c).alias(f"{p}_{c}") for c in features for f, p in ((F.min, "lo"), (F.max, "hi"))])


def apply_min_max(rows, limits, features=FEATURES, clip=True):
    """Features scaled to the fitted range, clipped to [0, 1]; constant features become 0."""
    joined = rows.crossJoin(F.broadcast(limits))  # one-row side

    def scaled(c):
        width = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        value = (F.col(c) - F.col(f"lo_{c}")) / F.when(width == 0, 1.0).otherwise(width)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) if clip else value

    return joined.select(*[scaled(c).alias(c) if c in features else F.col(c) for c in rows.columns])


def yeo_johnson(value, power):
    """Power transform of one column; ``power`` is a column or number."""
    power = power if not isinstance(power, (int, float)) else F.lit(float(power))
    up = F.when(F.abs(power) < 1e-12, F.log1p(value)).otherwise((F.pow(value + 1, power) - 1) / power)
    down = F.when(F.abs(power - 2) < 1e-12, -F.log1p(-value)).otherwise(-(F.pow(1 - value, 2 - power) - 1) / (2 - power))
    return F.when(value >= 0, up).otherwise(down)


def power_likelihoods(long, powers):
    """Log-likelihood per (feature, power); ``powers``: feature, power rows. One grouped pass.

    A column ``copies`` tells how many rows a value stands for; ``centre`` beside it is a value near the mean, from which deviations are taken.
    """
    rows = long.join(F.broadcast(powers), "feature")  # a fixed grid
    if "copies" in long.columns:
        shaped, copies = yeo_johnson(F.col("value"), F.col("power")) - yeo_johnson(F.col("centre"), F.col("power")), F.col("copies")
        stats = rows.select("*", shaped.alias("_y")).groupBy("feature", "power").agg(
            F.sum("copies").alias("_n"), F.sum(F.when(F.col("_y").isNotNull(), copies)).alias("_m"), F.sum(copies * F.col("_y")).alias("_s"),
            F.sum(copies * F.col("_y") * F.col("_y")).alias("_ss"), F.sum(copies * F.signum("value") * F.log1p(F.abs("value"))).alias("_jacobian"))
        variance = F.col("_ss") / F.col("_m") - (F.col("_s") / F.col("_m")) * (F.col("_s") / F.col("_m"))
        return stats.select("feature", "power", (-F.col("_n") / 2 * F.log(variance) + (F.col("power") - 1) * F.col("_jacobian")).alias("log_likelihood"))
    stats = rows.groupBy("feature", "power").agg(
        F.count(F.lit(1)).alias("_n"), F.var_pop(yeo_johnson(F.col("value"), F.col("power"))).alias("_var"),
        F.sum(F.signum("value") * F.log1p(F.abs("value"))).alias("_jacobian"),
    )
    return stats.select("feature", "power", (-F.col("_n") / 2 * F.log("_var") + (F.col("power") - 1) * F.col("_jacobian")).alias("log_likelihood"))


def fit_power(train, features=tuple(FEATURES[3:]), low=-2.0, high=4.0, points=25, rounds=3):
    """Power per feature that maximises the likelihood: grid search narrowed ``rounds`` times. Equal values meet the grid once."""
    spark = train.sparkSession
    long = train.unpivot([], list(features), "feature", "value").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("copies"))
    long = cut_lineage(long, "power-values")
    known = F.when(F.col("value").isNotNull(), F.col("copies"))
    centres = long.groupBy("feature").agg((F.sum(F.col("value") * F.col("copies")) / F.sum(known)).alias("centre"))
    long = long.join(F.broadcast(centres), "feature")  # one row per feature
    grid = {f: np.linspace(low, high, points) for f in features}
    step = (high - low) / (points - 1)
    for _ in range(rounds):
        powers = spark.createDataFrame([(f, float(p)) for f in features for p in grid[f]], "feature string, power double")
        best = power_likelihoods(long, powers).groupBy("feature").agg(F.max_by("power", "log_likelihood").alias("power"))
        chosen = {row["feature"]: row["power"] for row in best.collect()}  # one row per feature
        grid = {f: np.linspace(chosen[f] - step, chosen[f] + step, points) for f in features}
        step = 2 * step / (points - 1)
    return chosen


def apply_power(rows, powers):
    return rows.select(*[yeo_johnson(F.col(c), powers[c]).alias(c) if c in powers else F.col(c) for c in rows.columns])


def decide_policy(review_multiplier, verified_threshold, verified_margin):
    """Class label under a decision policy; probabilities stay as they are.

    Ties go to the first class in alphabetical order.
    """
    as_col = lambda x: x if not isinstance(x, (int, float)) else F.lit(float(x))
    v, r, j = F.col("p_verified"), F.col("p_review"), F.col("p_rejected")
    weighted = r * as_col(review_multiplier)
    label = (
        F.when((weighted >= j) & (weighted >= v), F.lit("Manual Review")).when(j >= v, F.lit("Rejected")).otherwise(F.lit("Verified"))
    )
    uncertain = (v < as_col(verified_threshold)) | (v - F.greatest(r, j) < as_col(verified_margin))
    return F.when((label == "Verified") & uncertain, F.lit("Manual Review")).otherwise(label)


# Policy grid.
MULTIPLIERS, THRESHOLDS, MARGINS = (1.0, 1.25, 1.5, 2.0), (0.0, 0.5, 0.6, 0.7, 0.8), (0.0, 0.1)


def policy_rows():
    return [("probability", w, t, m) for w, t, m in product(MULTIPLIERS, THRESHOLDS, MARGINS)] + [("native", 1.0, 0.0, 0.0)]


def policy_grid(spark):
    return spark.createDataFrame(policy_rows(), "policy string, review_multiplier double, verified_threshold double, verified_margin double")


POLICY_KEYS = ["candidate", "policy", "review_multiplier", "verified_threshold", "verified_margin"]


def _decision_cells(rows):
    """(candidate, target, native_label, comparisons, n): rows that no policy of the grid tells apart, counted together.

    A policy looks at nothing but these comparisons: review against the others for each multiplier, rejected against verified,
    verified against each threshold and its lead against each margin.
    """
    review = ", ".join(f"p_review * {w}D >= p_rejected and p_review * {w}D >= p_verified" for w in MULTIPLIERS)
    below = ", ".join(f"p_verified < {t}D" for t in THRESHOLDS)
    close = ", ".join(f"p_verified - greatest(p_review, p_rejected) < {m}D" for m in MARGINS)
    cells = rows.selectExpr("candidate", "target", "native_label", f"array({review}) review", "p_rejected >= p_verified rejected", f"array({below}) below", f"array({close}) close")
    return cells.groupBy("candidate", "target", "native_label", "review", "rejected", "below", "close").agg(F.count(F.lit(1)).alias("n"))


def _policy_confusion(rows):
    """Confusion counts of every candidate under every policy; rows are counted once, and only cells meet the grid."""
    policies = ", ".join(
        f"struct('{p}' as policy, {w}D as review_multiplier, {t}D as verified_threshold, {m}D as verified_margin, "
        f"{MULTIPLIERS.index(w) + 1} as w, {THRESHOLDS.index(t) + 1} as t, {MARGINS.index(m) + 1} as m)" for p, w, t, m in policy_rows())
    crossed = _decision_cells(rows).selectExpr("*", f"inline(array({policies}))")
    label = "case when element_at(review, w) then 'Manual Review' when rejected then 'Rejected' when element_at(below, t) or element_at(close, m) then 'Manual Review' else 'Verified' end"
    decided = crossed.selectExpr(*POLICY_KEYS, "target", "n", f"case when policy = 'native' then native_label else {label} end as predicted")
    cells = [F.expr(f"sum(case when target = '{CLASSES[i]}' and predicted = '{CLASSES[j]}' then n else 0 end) as n_{i}{j}") for i, j in CELLS]
    return decided.groupBy(*POLICY_KEYS).agg(*cells)


def sweep_policies(rows, baseline="raw_native_sigmoid"):
    """Every candidate under every policy with eligibility against the baseline, best first.

    ``rows``: candidate, target, p_verified, p_review, p_rejected, native_label.
    """
    table = summary(_policy_confusion(rows), POLICY_KEYS)
    losses = calibration_scores(rows, ["candidate"]).select("candidate", "log_loss")
    table = table.join(losses, "candidate")
    plain = (F.col("policy") == "probability") & (F.col("review_multiplier") == 1) & (F.col("verified_threshold") == 0) & (F.col("verified_margin") == 0)
    names = ["macro_f1", "rejected_to_verified", "review_to_verified", "review_recall"]
    reference = table.where((F.col("candidate") == baseline) & plain).select(*[F.col(c).alias(f"_{c}") for c in names])
    eligible = (
        (F.col("macro_f1") >= F.col("_macro_f1") - 1e-12) & (F.col("rejected_to_verified") <= F.col("_rejected_to_verified"))
        & (F.col("review_to_verified") <= F.col("_review_to_verified")) & (F.col("review_recall") >= F.col("_review_recall") - 1e-12)
    )
    judged = table.crossJoin(F.broadcast(reference)).withColumn("eligible", eligible).drop(*[f"_{c}" for c in names])  # one-row side
    return judged.orderBy(
        F.desc("eligible"), F.desc("accuracy"), F.desc("macro_f1"), "log_loss", "candidate", F.desc("policy"), "review_multiplier",
        "verified_threshold", "verified_margin",
    )


def temperature_losses(rows, temperatures, keys=()):
    """Log loss of softmax(log p / T) per candidate temperature (and ``keys``): one pass over a fixed grid."""
    names = ("p_verified", "p_review", "p_rejected")
    listed = ", ".join(f"{float(x)!r}D" for x in temperatures)
    powered = rows.selectExpr(*keys, "target", *names, f"explode(array({listed})) as temperature").selectExpr(
        *keys, "target", "temperature", *[f"pow({p}, 1 / temperature) as {p}" for p in names])
    softened = powered.selectExpr(*keys, "target", "temperature", *[f"{p} / ({' + '.join(names)}) as {p}" for p in names])
    return calibration_scores(softened, [*keys, "temperature"])


def audit_before_split(labelled):
    """Duplicate and conflict counts as one row."""
    from veriframe.operators.dashboards import duplicate_vectors

    return duplicate_vectors(labelled)


def require_clean(audit):
    """Stop when the audit row reports duplicates or label conflicts."""
    row = audit.first()
    if row["duplicates"] or row["conflicts"]:
        raise ValueError(f"exact duplicates must be resolved before splitting: {row.asDict()}")
