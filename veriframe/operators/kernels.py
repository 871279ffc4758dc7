"""Scoring with a frozen kernel model, and its one-vs-one to class probability step.

The model is a small fixed table; its size is checked before it is sent to the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from veriframe.operators.keyed import exact_quantiles
from veriframe.schemas import CLASSES, FEATURES

MAX_SUPPORT_VECTORS = 100_000
PAIRS = [(0, 1), (0, 2), (1, 2)]
_CLIP = 1e-7
_BLOCK = 2048


@dataclass
class KernelModel:
    """Radial-basis model with three classes: one weight per support vector and class pair."""

    vectors: np.ndarray  # (n, features)
    pair_weights: np.ndarray  # (n, 3): weight in the decision value of each class pair, 0 if not involved
    rho: np.ndarray  # (3,)
    prob_a: np.ndarray  # (3,)
    prob_b: np.ndarray  # (3,)
    gamma: float
    classes: list = field(default_factory=lambda: list(CLASSES))

    def __post_init__(self):
        if len(self.vectors) > MAX_SUPPORT_VECTORS:
            raise ValueError(f"model with {len(self.vectors)} support vectors is too large to send to every task")


def read_kernel_model(spark, path, features=len(FEATURES), max_lines=MAX_SUPPORT_VECTORS + 20):
    """Read a saved model in the common text layout (header, then one support vector per line)."""
    lines = [row.value for row in spark.read.text(path, wholetext=False).limit(max_lines + 1).collect()]
    if len(lines) > max_lines:
        raise ValueError("model file is too large to send to every task")
    split = lines.index("SV")
    header = {line.split()[0]: line.split()[1:] for line in lines[:split]}
    sizes = [int(x) for x in header["nr_sv"]]
    labels = [int(x) for x in header["label"]]
    weights = np.zeros((len(lines) - split - 1, 2))
    vectors = np.zeros((len(weights), features))
    for k, line in enumerate(lines[split + 1:]):
        parts = line.split()
        weights[k] = [float(x) for x in parts[:2]]
        for item in parts[2:]:
            index, value = item.split(":")
            vectors[k, int(index) - 1] = float(value)
    owner = np.repeat(np.arange(3), sizes)
    pair_weights = np.zeros((len(weights), 3))
    for p, (i, j) in enumerate(PAIRS):
        # weights hold one column per other class, in class order
        pair_weights[owner == i, p] = weights[owner == i, j - 1]
        pair_weights[owner == j, p] = weights[owner == j, i]
    numbers = lambda name: np.array([float(x) for x in header[name]])
    return KernelModel(
        vectors, pair_weights, numbers("rho"), numbers("probA"), numbers("probB"), float(header["gamma"][0]), [CLASSES[k] for k in labels]
    )


def couple_pairwise(r01, r02, r12):
    """Class probabilities from three pairwise ones: minimises the summed squared disagreement.

    With Q = [[r10²+r20², -r10 r01, -r20 r02], ...] the optimum is proportional to the row sums of
    the adjugate of Q, which stays defined when Q is singular.
    """
    r10, r20, r21 = 1 - r01, 1 - r02, 1 - r12
    a, b, c = r10 * r10 + r20 * r20, r01 * r01 + r21 * r21, r02 * r02 + r12 * r12
    d, e, f = -r10 * r01, -r20 * r02, -r21 * r12
    raw = [
        (b * c - f * f) + (e * f - d * c) + (d * f - b * e),
        (e * f - d * c) + (a * c - e * e) + (d * e - a * f),
        (d * f - b * e) + (d * e - a * f) + (a * b - d * d),
    ]
    total = raw[0] + raw[1] + raw[2]
    return [x / total for x in raw]


def decision_values(model, x):
    """Decision value per class pair for a block of rows."""
    squared = (x * x).sum(axis=1)[:, None] + (model.vectors * model.vectors).sum(axis=1)[None, :] - 2 * x @ model.vectors.T
    return np.exp(-model.gamma * np.maximum(squared, 0)) @ model.pair_weights - model.rho


def predict_block(model, x):
    out = np.empty((len(x), 3))
    for start in range(0, len(x), _BLOCK):
        values = decision_values(model, x[start:start + _BLOCK])
        r = 1 / (1 + np.exp(np.clip(model.prob_a * values + model.prob_b, -700, 700)))
        r = np.clip(r, _CLIP, 1 - _CLIP)
        out[start:start + _BLOCK] = np.stack(couple_pairwise(r[:, 0], r[:, 1], r[:, 2]), axis=1)
    return out


def kernel_probabilities(spark, model, features=FEATURES):
    """Struct column (p_verified, p_review, p_rejected, predicted) scored in Arrow batches."""
    shared = spark.sparkContext.broadcast(model)  # size checked in the model
    order = [model.classes.index(c) for c in CLASSES]

    @F.pandas_udf("p_verified double, p_review double, p_rejected double, predicted string")
    def score(batch: pd.DataFrame) -> pd.DataFrame:
        p = predict_block(shared.value, batch.to_numpy(dtype=float))[:, order]
        labels = np.array(CLASSES, dtype=object)[p.argmax(axis=1)]
        return pd.DataFrame({"p_verified": p[:, 0], "p_review": p[:, 1], "p_rejected": p[:, 2], "predicted": labels})

    return score(F.struct(*features))


def score_with_kernel(rows, model, features=FEATURES):
    """Rows (already scaled to the model's range) with class probabilities and label."""
    scored = rows.withColumn("_s", kernel_probabilities(rows.sparkSession, model, features))
    return scored.select(*rows.columns, "_s.*")


def score_with_kernel_sql(rows, model, key, features=FEATURES):
    """The same scores as a join with the support-vector table, for checking the batch version."""
    spark = rows.sparkSession
    table = spark.createDataFrame(
        [tuple(map(float, v)) + tuple(map(float, w)) for v, w in zip(model.vectors, model.pair_weights)],
        ", ".join(f"s_{f} double" for f in features) + ", w0 double, w1 double, w2 double",
    )
    crossed = rows.crossJoin(F.broadcast(table))  # model size is checked
    distance = sum((F.col(f) - F.col(f"s_{f}")) ** 2 for f in features)
    kernel = F.exp(-model.gamma * distance)
    sums = crossed.groupBy(key).agg(*[F.sum(F.col(f"w{p}") * kernel).alias(f"d{p}") for p in range(3)])
    pairwise = lambda p: F.greatest(F.lit(_CLIP), F.least(F.lit(1 - _CLIP), 1 / (1 + F.exp(
        float(model.prob_a[p]) * (F.col(f"d{p}") - float(model.rho[p])) + float(model.prob_b[p])))))
    r = sums.select(key, *[pairwise(p).alias(f"r{p}") for p in range(3)])
    p = couple_pairwise(F.col("r0"), F.col("r1"), F.col("r2"))
    names = {c: n for c, n in zip(CLASSES, ("p_verified", "p_review", "p_rejected"))}
    return r.select(key, *[x.alias(names[c]) for x, c in zip(p, model.classes)])


def prototype_model(train, levels=tuple(i / 10 for i in range(1, 10)), gamma=1.0, features=FEATURES):
    """A small kernel model from class quantiles of (scaled) training rows.

    Each class contributes one support vector per level, made of that level's quantile of every
    feature, with weight +1 against the classes after it and -1 against those before.
    """
    long = train.unpivot(["target"], list(features), "feature", "value")
    table = exact_quantiles(long, ["target", "feature"], "value", list(levels)).collect()  # classes x features x levels rows
    value = {(row["target"], row["feature"], round(row["probability"], 6)): row["quantile"] for row in table}
    vectors = np.array([[value[c, f, round(p, 6)] for f in features] for c in CLASSES for p in levels])
    owner = np.repeat(np.arange(3), len(levels))
    weights = np.stack([np.where(owner == i, 1.0, np.where(owner == j, -1.0, 0.0)) for i, j in PAIRS], axis=1)
    return KernelModel(vectors, weights, np.zeros(3), -np.ones(3), np.zeros(3), gamma)
