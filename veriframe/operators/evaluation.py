"""Model evaluation: confusion cells, metrics, calibration, bootstrap, permutation importance.

Everything starts from one aggregation of the prediction table into a handful of cells; the cells,
not the rows, feed the rest.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from veriframe.functions.scores import face_band
from veriframe.operators.keyed import hash_rank
from veriframe.schemas import CLASS_KEYS, CLASSES, FEATURES

P_COLUMNS = [f"p_{k}" for k in CLASS_KEYS]
_SMALLEST = float(np.finfo(np.float64).eps)
CELLS = [(i, j) for i in range(3) for j in range(3)]


def _cell(i, j):
    return f"n_{i}{j}"


def confusion_cells(rows, keys=(), actual="target", predicted="predicted", classes=CLASSES):
    """Nine counts per group: n_<actual><predicted>. Combined map-side, so no prediction row is shuffled."""
    aggregates = [
        F.count_if((F.col(actual) == classes[i]) & (F.col(predicted) == classes[j])).alias(_cell(i, j)) for i, j in CELLS
    ]
    return rows.groupBy(*keys).agg(*aggregates) if keys else rows.agg(*aggregates)


def _sums():
    n = lambda i, j: F.col(_cell(i, j)).cast("double")
    actual = [n(i, 0) + n(i, 1) + n(i, 2) for i in range(3)]
    predicted = [n(0, j) + n(1, j) + n(2, j) for j in range(3)]
    return n, actual, predicted


def _ratio(top, bottom):
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def f1_columns():
    n, actual, predicted = _sums()
    return [_ratio(2 * n(i, i), actual[i] + predicted[i]) for i in range(3)]


def accuracy_column():
    n, actual, _ = _sums()
    return _ratio(n(0, 0) + n(1, 1) + n(2, 2), actual[0] + actual[1] + actual[2])


def macro_f1_column():
    f1 = f1_columns()
    return (f1[0] + f1[1] + f1[2]) / 3


def summary(cells, keys=()):
    """Accuracy, macro and weighted F1, both false-verify counts and review recall per group."""
    n, actual, _ = _sums()
    f1 = f1_columns()
    total = actual[0] + actual[1] + actual[2]
    weighted = _ratio(f1[0] * actual[0] + f1[1] * actual[1] + f1[2] * actual[2], total)
    return cells.select(
        *keys, total.cast("bigint").alias("n"), accuracy_column().alias("accuracy"), macro_f1_column().alias("macro_f1"), weighted.alias("weighted_f1"),
        F.col(_cell(2, 0)).alias("rejected_to_verified"), F.col(_cell(1, 0)).alias("review_to_verified"), _ratio(n(1, 1), actual[1]).alias("review_recall"),
    )


def per_class(cells, keys=(), classes=CLASSES):
    """Precision, recall, F1 and support per class."""
    n, actual, predicted = _sums()
    f1 = f1_columns()
    rows = F.array(*[
        F.struct(F.lit(classes[i]).alias("class"), _ratio(n(i, i), predicted[i]).alias("precision"), _ratio(n(i, i), actual[i]).alias("recall"),
                 f1[i].alias("f1"), actual[i].cast("bigint").alias("support")) for i in range(3)
    ])
    return cells.select(*keys, F.inline(rows))


def confusion_matrix(cells, keys=(), classes=CLASSES):
    """All nine (actual, predicted, n) rows; off-diagonal ones are the error counts."""
    rows = F.array(*[F.struct(F.lit(classes[i]).alias("actual"), F.lit(classes[j]).alias("predicted"), F.col(_cell(i, j)).alias("n")) for i, j in CELLS])
    return cells.select(*keys, F.inline(rows))


def true_probability(classes=CLASSES):
    return F.coalesce(*[F.when(F.col("target") == c, F.col(p)) for c, p in zip(classes, P_COLUMNS)])


def log_loss_column():
    return -F.log(F.greatest(F.lit(_SMALLEST), F.least(F.lit(1 - _SMALLEST), true_probability())))


def calibration_scores(rows, keys=()):
    """Mean log loss and multiclass Brier sum."""
    brier = sum((F.col(p) - (F.col("target") == c).cast("double")) ** 2 for c, p in zip(CLASSES, P_COLUMNS))
    aggregates = [F.avg(log_loss_column()).alias("log_loss"), F.avg(brier).alias("brier")]
    return rows.groupBy(*keys).agg(*aggregates) if keys else rows.agg(*aggregates)


BIN_EDGES = [float(e) for e in np.linspace(0, 1, 11)]


def reliability_bins(rows, keys=()):
    """Ten probability bins per class (the last one closed): size, mean probability, observed share."""
    each = F.inline(F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(p).alias("p"), (F.col("target") == c).cast("double").alias("hit")) for c, p in zip(CLASSES, P_COLUMNS)
    ]))
    edges = F.array(*[F.lit(e) for e in BIN_EDGES])
    number = F.least(F.lit(9), F.size(F.filter(edges, lambda e: e <= F.col("p"))) - 1)
    binned = rows.select(*keys, each).withColumn("bin", number)
    return binned.groupBy(*keys, "class", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_probability"), F.avg("hit").alias("observed_fraction")
    )


def calibration_error(bins, keys=()):
    """Expected calibration error per class from the reliability bins (at most ten rows per class)."""
    gap = F.sum(F.col("n") * F.abs(F.col("mean_probability") - F.col("observed_fraction")))
    return bins.groupBy(*keys, "class").agg((gap / F.sum("n")).alias("ece"))


SMALL_CELL = 20  # draws below this size come from the distribution itself, larger ones from its normal expansion


def poisson_steps():
    """(n, k, c): for n < SMALL_CELL, the chance that a Poisson number of mean n is at most k, as far as it is below 1."""
    rows = []
    for n in range(1, SMALL_CELL):
        term = total = float(np.exp(-n))
        for k in range(8 * SMALL_CELL):
            if total >= 1 - 1e-12:
                break
            rows.append((n, k, total))
            term *= n / (k + 1)
            total += term
    return rows


def bootstrap_draw_sql(u, v, n, digest_number):
    """SQL text of a Poisson number of mean ``n`` from the digests ``u`` and ``v``; ``small`` holds the steps for small means.

    Large means take the normal quantile z and its first correction: n + z * sqrt(n) + (z * z - 1) / 6, rounded.
    """
    first, second = (f"(({digest_number(x)}) + 0.5e0) / 4503599627370496e0" for x in (u, v))
    z = f"(sqrt(-2 * ln({first})) * cos(2 * pi() * ({second})))"
    return first, f"greatest(0, floor({n} + {z} * sqrt({n}) + ({z} * {z} - 1) / 6 + 0.5))"


def paired_bootstrap(rows, actual, first, second, keys=(), repeats=1000, seed=42, classes=CLASSES):
    """95 % intervals of the accuracy and macro-F1 difference between two predictors, per group of ``keys``.

    In a bootstrap sample every row is drawn a Poisson number of times, so each of the 27 (actual, first, second) cells is drawn
    a Poisson number of times its size: the table is counted once, and a repeat draws 27 numbers from digests of
    (seed, repeat, cell, counter), which any engine can repeat. Rows with a null or another class are left out.
    """
    keys = list(keys)
    code = lambda c: "case " + c + " " + " ".join(f"when '{name}' then {i}" for i, name in enumerate(classes)) + " end"
    cells = rows.selectExpr(*keys, f"9 * {code(actual)} + 3 * {code(first)} + {code(second)} cell").where("cell is not null").groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n"))
    digest = lambda counter: f"md5(concat_ws(':', {seed}, repeat, cell, {counter}))"
    uniform, large = bootstrap_draw_sql("d1", "d2", "n", lambda d: f"conv(substr({d}, 1, 13), 16, 10)::bigint")
    steps = rows.sparkSession.createDataFrame(poisson_steps(), "small int, k int, c double").groupBy("small").agg(F.sort_array(F.collect_list("c")).alias("steps"))
    drawn = cells.selectExpr("*", f"explode(sequence(0, {repeats - 1})) repeat").selectExpr("*", f"{digest(1)} d1", f"{digest(2)} d2")
    drawn = drawn.join(F.broadcast(steps), F.col("n") == F.col("small"), "left")  # a fixed table of SMALL_CELL - 1 rows
    drawn = drawn.selectExpr(*keys, "repeat", "cell div 9 a", "(cell div 3) % 3 f", "cell % 3 s", f"case when n < {SMALL_CELL} then size(filter(steps, c -> c <= {uniform})) else {large} end::double m")
    f1 = lambda p, c: f"coalesce(2 * {_sum(f'a = {c} and {p} = {c}')} / nullif({_sum(f'a = {c}')} + {_sum(f'{p} = {c}')}, 0), 0D)"
    macro = lambda p: "(" + " + ".join(f1(p, c) for c in range(len(classes))) + f") / {len(classes)}"
    each = drawn.groupBy(*keys, "repeat").agg(
        F.expr(f"coalesce(({_sum('a = f')} - {_sum('a = s')}) / nullif(sum(m), 0), 0D) accuracy_difference"), F.expr(f"{macro('f')} - {macro('s')} macro_f1_difference"))
    # bounded by the number of repeats
    return each.groupBy(*keys).agg(
        *[F.percentile(c, F.lit(p)).alias(f"{c}_{side}") for c in ("accuracy_difference", "macro_f1_difference") for p, side in ((0.025, "low"), (0.975, "high"))],
        F.count(F.lit(1)).alias("repeats"),
    )


def _sum(condition):
    return f"sum(case when {condition} then m else 0 end)"


ROUNDS = 3  # of the permutation of row numbers by keys


def _is_prime(n):
    if n % 2 == 0:
        return n == 2
    return all(n % d for d in range(3, int(n**0.5) + 1, 2))


def shuffle_keys(repeat, seed=42):
    """Keys of one permutation: a prime above 2^31, a shift and a cut (in thousandths) for each round."""
    rng = np.random.default_rng([seed, repeat])
    keys = []
    for _ in range(ROUNDS):
        p = int(rng.integers(1 << 31, (1 << 32) - 1000)) | 1
        while not _is_prime(p):
            p += 2
        keys.append((p, int(rng.integers(0, 1 << 31)), int(rng.integers(200, 800))))
    return keys


def moved_sql(k, n, prime, shift):
    """First half of a round, as SQL text: times a prime (without a factor in common with a smaller n), shifted, modulo n."""
    return f"({k} * ({prime} % {n}) + {shift}) % {n}"


def turned_sql(k, n, edge):
    """Second half: the part above an edge turned round. Both halves map 0..n-1 onto itself, whatever n is."""
    return f"case when {k} < {edge} then {k} else {n} - 1 - ({k} - {edge}) end"


PASS_ROWS = 48_000_000  # of permutation importance: rows shuffled at a time; a larger table shuffles each row once


def permutation_importance(rows, key, predict, repeats=20, features=FEATURES, classes=CLASSES, pass_rows=PASS_ROWS):
    """Mean and deviation of the macro-F1 drop when one feature is shuffled.

    A shuffle pairs the row at position k in one hash order with the row at position k in another, drawn anew for every repeat.
    Positions come from digest-prefix counts, not from one global sort in a single task. A pairing serves all features: its rows
    are counted by their class and the six predicted classes at once, and only these few counts are dealt to the features.
    The merge hint keeps a side of the pairing from being sent to every task: an exploded table is larger than its estimate.
    A large table takes its repeats in several passes; each leaves only its counts, and its shuffled rows go before the next.
    """
    from veriframe.session import cut_lineage, delete_intermediates, intermediates, release_shuffles

    spark = rows.sparkSession
    with intermediates() as written:
        base = cut_lineage(rows.select(key, "target", *features), "permuted-rows")
    in_pass = max(1, pass_rows // max(1, base.count()))
    in_pass = math.ceil(repeats / math.ceil(repeats / in_pass))  # passes of one size
    home = hash_rank(base, [], F.md5(F.concat(F.lit("home:"), F.col(key).cast("string"))), key, "_k")
    if in_pass < repeats:  # every pass reads the home order, which holds all that the rows do
        release_shuffles(spark)
        base = home = cut_lineage(home, "numbered-rows")
        delete_intermediates(spark, written)

    def shuffled(feature):
        return predict([F.col(f"_{f}") if f == feature else F.col(f) for f in features])

    codes = [f"_p{i}" for i in range(len(features))]

    def counts(first, last):
        """Rows of the repeats ``first`` to ``last`` by class and predicted classes."""
        away = base.select(key, *[F.col(f).alias(f"_{f}") for f in features], F.explode(F.sequence(F.lit(first), F.lit(last))).alias("repeat"))
        away = hash_rank(away, ["repeat"], F.md5(F.concat_ws(":", F.col("repeat").cast("string"), F.col(key).cast("string"))), key, "_k").drop(key)
        paired = home.drop(key).join(away.hint("merge"), "_k")
        return paired.select("repeat", "target", *[shuffled(f).alias(p) for f, p in zip(features, codes)]).groupBy("repeat", "target", *codes).agg(F.count(F.lit(1)).alias("_n"))

    if in_pass < repeats:
        parts = []
        for first in range(0, repeats, in_pass):
            release_shuffles(spark)
            parts.append(cut_lineage(counts(first, min(first + in_pass, repeats) - 1), "permuted-counts"))
        counted = functools.reduce(lambda a, b: a.unionByName(b), parts)
    else:
        counted = counts(0, repeats - 1)
    each = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(p).alias("predicted")) for f, p in zip(features, codes)]))
    hit = lambda i, j: F.when((F.col("target") == classes[i]) & (F.col("predicted") == classes[j]), F.col("_n")).otherwise(0)
    cells = counted.select("repeat", "target", "_n", each).groupBy("feature", "repeat").agg(*[F.sum(hit(i, j)).alias(_cell(i, j)) for i, j in CELLS])
    plain = confusion_cells(base.withColumn("predicted", predict([F.col(f) for f in features]))).select(macro_f1_column().alias("_base"))
    drops = cells.select("feature", macro_f1_column().alias("_f1")).crossJoin(F.broadcast(plain))  # one-row side
    drop = F.col("_base") - F.col("_f1")
    return drops.groupBy("feature").agg(F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("std"))


def release_gate(candidate, incumbent):
    """One row: accuracy strictly up, macro F1 not down, neither false-verify count up.

    Both inputs are one-row summaries.
    """
    names = ["accuracy", "macro_f1", "rejected_to_verified", "review_to_verified"]
    pair = candidate.select(*[F.col(c).alias(f"new_{c}") for c in names]).crossJoin(incumbent.select(*[F.col(c).alias(f"old_{c}") for c in names]))
    passed = (
        (F.col("new_accuracy") > F.col("old_accuracy")) & (F.col("new_macro_f1") >= F.col("old_macro_f1"))
        & (F.col("new_rejected_to_verified") <= F.col("old_rejected_to_verified")) & (F.col("new_review_to_verified") <= F.col("old_review_to_verified"))
    )
    return pair.withColumn("promoted", passed)


def band_counts(rows, slices, label="predicted", classes=CLASSES):
    """Predicted classes per face band for each named slice of the rows."""
    tags = F.array(*[F.when(condition, F.lit(name)) for name, condition in slices.items()])
    tagged = rows.withColumn("slice", F.explode(F.filter(tags, lambda x: x.isNotNull()))).withColumn("band", face_band(F.col("face_match_score")))
    return tagged.groupBy("slice", "band").agg(*[F.count_if(F.col(label) == c).alias(k) for c, k in zip(classes, CLASS_KEYS)])


def strong_evidence():
    return (F.col("liveness_score") >= 0.9) & (F.col("ocr_confidence_score") >= 0.9)


def conflicting_evidence():
    return (F.col("face_match_score") > 50) & ((F.col("liveness_score") < 0.25) | (F.col("ocr_confidence_score") < 0.25))


# Blur, brightness, contrast of the probe profiles.
PROBE_QUALITY = [(35, 110, 30), (80, 150, 45), (200, 185, 55)]
UNSEEN_QUALITY = [(50, 135, 36), (120, 170, 50), (170, 155, 65)]


def probe_grid(spark):
    """Score rows with perfect liveness and text over face 0-100 and the quality profiles."""
    def part(name, faces, profiles):
        quality = F.explode(F.array(*[F.struct(*[F.lit(float(v)).alias(c) for v, c in zip(p, FEATURES[3:])]) for p in profiles]))
        return faces.select(F.lit(name).alias("grid"), "face_match_score", F.lit(1.0).alias("liveness_score"), F.lit(1.0).alias("ocr_confidence_score"), quality.alias("_q")).select(
            "grid", *FEATURES[:3], "_q.*")

    whole = spark.range(101).select(F.col("id").cast("double").alias("face_match_score"))
    half = spark.range(100).select((F.col("id") + 0.5).alias("face_match_score"))
    return part("perfect_evidence", whole, PROBE_QUALITY).unionByName(part("new_profiles", half, UNSEEN_QUALITY))


def model_report(cells, keys=("model", "population")):
    """Report rows per model and population: cases, correct predictions and headline metrics."""
    n, _, _ = _sums()
    correct = cells.select(*keys, (n(0, 0) + n(1, 1) + n(2, 2)).cast("bigint").alias("correct_predictions"))
    return summary(cells, keys).join(correct, list(keys)).withColumnRenamed("n", "cases")
