"""Margin models on random features: every grid point, fold and class fitted together, one pass over the rows an iteration.

A model is one weight vector per class (one against the rest) on random cosine features, whose inner products approximate the
radial-basis kernel of a width. The vectors of all costs, widths, folds and classes form one array that is sent to the tasks; a
pass gives every vector's loss and gradient, as sums of the tasks' partial sums. Rows of a fold are left out of its own models
by a mask; each fold has its own scaling, class weights and named widths, taken from the moments of the other folds. Scaled
rows meet the random directions once a scaling, and a width's features once a scaling and width, whatever the number of costs and
of the folds that share them. Vectors that have converged take no part in later passes.

The driver holds the weights and the last few steps of each of them (limited-memory quasi-Newton with a step length per
vector): it grows with the grid, not with the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from veriframe.operators.selection import folds
from veriframe.schemas import CLASSES, FEATURES
from veriframe.session import cut_lineage

COSTS = (0.1, 1.0, 10.0, 100.0)
GAMMAS = (0.001, 0.01, 0.1, 1.0, "scale", "auto")
SLOTS = 16  # partial sums meet in so many groups before the driver adds them up
BLOCK = 2048  # rows whose random features are held at a time
SMOOTHING = 0.25  # the hinge is quadratic over this stretch below the margin
_KINDS = ("verified", "review", "rejected")


@dataclass(frozen=True)
class Directions:
    """Random directions and shifts, scaled by a width when used."""

    weights: np.ndarray
    shift: np.ndarray

    @classmethod
    def drawn(cls, features, size, seed):
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 1, (features, size)).astype(np.float32), rng.uniform(0, 2 * np.pi, size).astype(np.float32))

    def lift(self, projected, gamma, out=None):
        """Random features of rows already multiplied by the directions, with a constant in the last column."""
        size = len(self.shift)
        lifted = np.empty((len(projected), size + 1), np.float32) if out is None else out
        waves = lifted[:, :size]
        np.multiply(projected, np.float32(np.sqrt(2 * gamma)), out=waves)
        waves += self.shift
        np.cos(waves, out=waves)
        waves *= np.float32(np.sqrt(2 / size))
        lifted[:, size] = 1
        return lifted


@dataclass(frozen=True)
class Scaling:
    low: np.ndarray
    high: np.ndarray

    def apply(self, values):
        width = np.where(self.high > self.low, self.high - self.low, 1.0)
        return np.clip((values - self.low) / width, 0, 1).astype(np.float32)


@dataclass(frozen=True)
class Part:
    """What the models of one fold are fitted with: all rows but the fold's (all rows, if ``fold`` is -1)."""

    fold: int
    rows: int
    scaling: Scaling
    class_weights: np.ndarray
    gammas: tuple


@dataclass(frozen=True)
class MarginModel:
    weights: np.ndarray  # (size + 1, classes)
    gamma: float
    directions: Directions
    scaling: Scaling
    features: tuple = tuple(FEATURES)

    def margins(self, values):
        return self.directions.lift(self.scaling.apply(values) @ self.directions.weights, self.gamma) @ self.weights


def _moments(rows, features):
    """Per fold: size, class counts, and count, mean, variance and range of every feature."""
    aggregates = [f(c).alias(f"{n}_{i}") for i, c in enumerate(features) for f, n in ((F.avg, "mean"), (F.var_pop, "var"), (F.min, "low"), (F.max, "high"))]
    counts = [F.count_if(F.col("code") == i).alias(f"class_{i}") for i in range(len(CLASSES))]
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *counts, *aggregates).collect()  # a row per fold


def _part(fold, moments, gammas, features):
    """Scaling, class weights and named widths of the rows outside ``fold``."""
    used = [m for m in moments if m["fold"] != fold] or moments
    n = np.array([m["n"] for m in used], float)
    column = lambda name: np.array([[m[f"{name}_{i}"] for i in range(len(features))] for m in used])
    scaling = Scaling(column("low").min(axis=0), column("high").max(axis=0))
    width = np.where(scaling.high > scaling.low, scaling.high - scaling.low, 1.0)
    mean = (column("mean") - scaling.low) / width
    square = column("var") / width**2 + mean**2
    share = (n / n.sum())[:, None]
    variance = float((square * share).sum(axis=0).mean() - (mean * share).sum(axis=0).mean() ** 2)
    named = {"auto": 1 / len(features), "scale": 1 / (len(features) * variance) if variance > 1e-12 else 1.0}
    classes = np.array([[m[f"class_{i}"] for i in range(len(CLASSES))] for m in used], float).sum(axis=0)
    weights = np.where(classes > 0, n.sum() / (max(1, (classes > 0).sum()) * np.maximum(classes, 1)), 0.0)
    return Part(fold, int(n.sum()), scaling, weights, tuple(float(named.get(g, g)) for g in gammas))


def _columns(batch, features):
    values = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features], axis=1)
    return values, batch.column("code").to_numpy(zero_copy_only=False).astype(int), batch.column("fold").to_numpy(zero_copy_only=False)


def _gradients(batches, parts, directions, weights, asked, features):
    """Loss and gradient of the ``asked`` weight vectors (zeros for others): arrays (parts, gammas, costs * classes) and (parts, gammas, size + 1, costs * classes).

    Parts of one scaling and width have the same random features, so their vectors meet the rows together; the rows of a part's own
    fold weigh nothing in it.
    """
    k = len(CLASSES)
    losses, slopes = np.zeros(asked.shape), np.zeros(weights.shape)
    lifts = {}
    for p, part in enumerate(parts):
        for g, gamma in enumerate(part.gammas):
            columns = np.flatnonzero(asked[p, g])
            if len(columns):
                scaling = (part.scaling.low.tobytes(), part.scaling.high.tobytes())
                lifts.setdefault(scaling, (part.scaling, {}))[1].setdefault(gamma, []).append((p, g, columns))
    shared = []
    for scaling, widths in lifts.values():
        for gamma, members in widths.items():
            matrix = np.concatenate([weights[p, g][:, columns] for p, g, columns in members], axis=1).astype(np.float32)
            owner = np.concatenate([p * k + columns % k for p, _, columns in members])
            shared.append((scaling, gamma, members, matrix, owner, np.zeros(len(owner)), np.zeros(matrix.shape)))
    folds_out = np.array([p.fold for p in parts])
    buffer = np.empty((BLOCK, len(directions.shift) + 1), np.float32)
    class_weights = np.stack([p.class_weights for p in parts], axis=1).astype(np.float32)
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            values, codes, fold = _columns(batch.slice(at, BLOCK), features)
            share = class_weights[codes] * (fold[:, None] != folds_out)  # rows x parts
            sign = np.where(codes[:, None] == np.arange(k), 1, -1).astype(np.float32)
            signed = np.tile(sign, len(parts))  # rows x (parts * classes)
            projected, last, dealt = None, None, {}
            for scaling, gamma, members, matrix, owner, loss_sum, slope_sum in shared:
                if scaling is not last:
                    projected, last = scaling.apply(values) @ directions.weights, scaling
                if (names := owner.tobytes()) not in dealt:
                    dealt[names] = np.take(signed, owner, axis=1), np.take(share, owner // k, axis=1)
                side, weight = dealt[names]
                lifted = directions.lift(projected, gamma, buffer[:len(values)])
                gap = lifted @ matrix
                gap *= side
                np.subtract(1, gap, out=gap)
                inside = np.clip(gap, 0, np.float32(SMOOTHING))
                inside *= weight
                loss_sum += np.einsum("rc,rc->c", inside, gap)
                np.clip(gap, 0, np.float32(SMOOTHING), out=gap)
                loss_sum -= np.einsum("rc,rc->c", inside, gap) / 2
                inside *= side
                slope_sum -= lifted.T @ inside
    for _, _, members, _, _, loss_sum, slope_sum in shared:
        start = 0
        for p, g, columns in members:
            own = slice(start, start + len(columns))
            losses[p, g, columns], slopes[p, g][:, columns] = loss_sum[own] / SMOOTHING, slope_sum[:, own] / SMOOTHING
            start += len(columns)
    return losses, slopes


def _confusion(batches, parts, directions, weights, _, features):
    """Counts (parts, gammas, costs, actual, predicted) over each part's own fold."""
    many, k = weights.shape[3] // len(CLASSES), len(CLASSES)
    counts = np.zeros((*weights.shape[:2], many, k, k))
    matrix = weights.astype(np.float32)
    for batch in batches:
        values, codes, fold = _columns(batch, features)
        for p, part in enumerate(parts):
            mine = fold == part.fold
            projected = part.scaling.apply(values[mine]) @ directions.weights
            for g, gamma in enumerate(part.gammas):
                margins = (directions.lift(projected, gamma) @ matrix[p, g]).reshape(-1, many, k)
                cell = codes[mine][:, None] * k + margins.argmax(axis=2)
                for c in range(many):
                    counts[p, g, c] += np.bincount(cell[:, c], minlength=k * k).reshape(k, k)
    return (counts,)


def _summed(rows, kernel, shared, features):
    """Sum of the arrays that ``kernel`` gives for each task's rows."""

    def partial(batches):
        arrays = kernel(batches, *shared.value, features)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId() % SLOTS]), pa.array([np.concatenate([a.ravel() for a in arrays]).tobytes()], pa.binary())], ["slot", "sums"])

    def add(table):
        total = sum(np.frombuffer(own.as_buffer(), float) for own in table.column("sums"))
        return pa.table([table.column("slot").slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["slot", "sums"])

    groups = rows.mapInArrow(partial, "slot bigint, sums binary").groupBy("slot").applyInArrow(add, "slot bigint, sums binary")
    return sum(np.frombuffer(r["sums"], float) for r in groups.collect())  # SLOTS rows of the grid's size


def minimise(evaluate, start, passes, memory=8, tolerance=1e-3):
    """Minimise independent functions, one per row of ``start``, which are evaluated together.

    ``evaluate`` gives a value and a gradient per row. A row whose step does not lower its value enough tries a shorter one at the
    next evaluation, while the other rows go on. A row has converged when its gradient falls below ``tolerance`` times the first.
    """
    w = start.copy()
    value, slope = evaluate(w)
    norm = lambda x: np.sqrt((x * x).sum(axis=1))
    goal = tolerance * np.maximum(norm(slope), 1e-12)
    steps, turns, curves = (np.zeros((memory, *w.shape)), np.zeros((memory, *w.shape)), np.zeros((memory, len(w))))
    direction, length = -slope / np.maximum(norm(slope), 1.0)[:, None], np.ones(len(w))
    for _ in range(passes):
        active = (norm(slope) > goal) & (length > 1e-8)
        if not active.any():
            break
        trial = w + np.where(active, length, 0.0)[:, None] * direction
        new_value, new_slope = evaluate(trial)
        good = active & (new_value <= value + 1e-4 * length * (slope * direction).sum(axis=1))
        moved, turned = (trial - w)[good], (new_slope - slope)[good]
        curve = (moved * turned).sum(axis=1)
        for kept, new in ((steps, moved), (turns, turned), (curves, np.where(curve > 1e-12, curve, 0.0))):
            kept[:-1, good] = kept[1:, good]
            kept[-1, good] = new
        w[good], value[good], slope[good] = trial[good], new_value[good], new_slope[good]
        length = np.where(good, 1.0, np.where(active, length * 0.3, length))
        direction[good] = -_two_loops(slope[good], steps[:, good], turns[:, good], curves[:, good])
    return w, value


def _two_loops(slope, steps, turns, curves):
    """Inverse curvature times slope, from the last steps and slope changes; entries without curvature are skipped."""
    inverse = np.where(curves > 0, 1 / np.where(curves > 0, curves, 1.0), 0.0)
    q, alphas = slope.copy(), []
    for i in reversed(range(len(steps))):
        alpha = inverse[i] * (steps[i] * q).sum(axis=1)
        q -= alpha[:, None] * turns[i]
        alphas.append(alpha)
    square = (turns[-1] ** 2).sum(axis=1)
    q *= np.where(curves[-1] > 0, curves[-1] / np.where(square > 0, square, 1.0), 1.0)[:, None]
    for i, alpha in zip(range(len(steps)), reversed(alphas)):
        beta = inverse[i] * (turns[i] * q).sum(axis=1)
        q += steps[i] * (alpha - beta)[:, None]
    return q


def _fit(rows, parts, costs, directions, features, passes):
    """Weights (parts, gammas, size + 1, costs * classes)."""
    size, k = len(directions.shift) + 1, len(CLASSES)
    shape = (len(parts), len(parts[0].gammas), size, len(costs) * k)
    spark = rows.sparkSession
    strength = 1 / np.repeat(np.array(costs, float), k)  # of the penalty, by cost and class; divided by the rows below
    n = np.array([max(p.rows, 1) for p in parts], float)[:, None, None]

    def to_array(w):
        return np.moveaxis(w.reshape(shape[0], shape[1], shape[3], size), 3, 2)

    before = []  # the last vectors and what they gave: a vector that rests is not worked out again

    def evaluate(flat):
        weights = to_array(flat)
        asked = (flat != before[0]).any(axis=1) if before else np.ones(len(flat), bool)
        shared = spark.sparkContext.broadcast((parts, directions, weights, asked.reshape(shape[0], shape[1], shape[3])))  # the size of the grid
        sums = _summed(rows, _gradients, shared, features)
        shared.unpersist()
        split = shape[0] * shape[1] * shape[3]
        loss, slope = sums[:split].reshape(shape[0], shape[1], shape[3]) / n, sums[split:].reshape(shape) / n[..., None]
        penalised = weights.copy()
        penalised[:, :, -1] = 0  # the constant is free
        loss = loss + (penalised**2).sum(axis=2) * strength / (2 * n)
        slope = slope + penalised * strength / n[..., None]
        loss, slope = loss.ravel(), np.moveaxis(slope, 2, 3).reshape(-1, size)
        if before:
            loss, slope = np.where(asked, loss, before[1]), np.where(asked[:, None], slope, before[2])
        before[:] = flat.copy(), loss.copy(), slope.copy()
        return loss, slope

    w, _ = minimise(evaluate, np.zeros((shape[0] * shape[1] * shape[3], size)), passes)
    return to_array(w)


def _coded(rows, features):
    code = F.coalesce(*[F.when(F.col("target") == c, F.lit(i)) for i, c in enumerate(CLASSES)])
    return rows.select(*[F.col(c).cast("double").alias(c) for c in features], code.alias("code"), F.col("fold").cast("int").alias("fold")).dropna()


def tune_margin_model(train, key, costs=COSTS, gammas=GAMMAS, k=5, features=FEATURES, size=96, seed=42, passes=60):
    """Cost and width grid by cross-validated macro F1 as a table (cost, gamma, width, macro_f1), best first.

    All ``len(costs) * len(gammas) * k`` models are fitted in the same passes. ``gamma`` of the table is the width for all of
    ``train``; 'scale' and 'auto' are worked out on the rows of each fit. Rows with a null feature or class are left out.
    """
    rows = cut_lineage(_coded(folds(train, key, k), features), "margin-rows")
    moments = _moments(rows, features)
    if not moments:
        raise ValueError("no labelled rows to fit on")
    parts = tuple(_part(fold, moments, gammas, features) for fold in range(k))
    directions = Directions.drawn(len(features), size, seed)
    weights = _fit(rows, parts, costs, directions, features, passes)
    shared = rows.sparkSession.sparkContext.broadcast((parts, directions, weights, None))
    cells = _summed(rows, _confusion, shared, features).reshape(k, len(gammas), len(costs), len(CLASSES), len(CLASSES))
    top = 2 * np.diagonal(cells, axis1=3, axis2=4)
    bottom = cells.sum(axis=3) + cells.sum(axis=4)
    f1 = np.where(bottom > 0, top / np.maximum(bottom, 1), 0.0).mean(axis=3).mean(axis=0)
    whole = _part(-1, moments, gammas, features)
    table = [(float(c), whole.gammas[g], str(gammas[g]), float(f1[g, i])) for i, c in enumerate(costs) for g in range(len(gammas))]
    return train.sparkSession.createDataFrame(sorted(table, key=lambda r: (-r[3], r[0], r[1])), "cost double, gamma double, width string, macro_f1 double")


def fit_margin_model(train, cost=1.0, gamma=1.0, features=FEATURES, size=96, seed=42, passes=100):
    """One model on all rows: scaling, widths and class weights are taken from them."""
    rows = cut_lineage(_coded(train.withColumn("fold", F.lit(0)), features), "margin-rows")
    part = _part(-1, _moments(rows, features), (gamma,), features)
    directions = Directions.drawn(len(features), size, seed)
    weights = _fit(rows, (part,), (cost,), directions, features, passes)
    return MarginModel(weights[0, 0], part.gammas[0], directions, part.scaling, tuple(features))


def predict_margins(model, rows):
    """``rows`` with the predicted class and the three one-against-the-rest margins."""

    @F.pandas_udf("array<double>")
    def margins(batch: pd.DataFrame) -> pd.Series:
        return pd.Series(list(model.margins(batch.to_numpy(dtype=float)).astype(float)))

    scored = rows.withColumn("_m", margins(F.struct(*model.features)))
    best = F.array_position("_m", F.array_max("_m")).cast("int")
    name = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), best)
    return scored.select(*rows.columns, name.alias("predicted"), *[F.col("_m")[i].alias(f"m_{k}") for i, k in enumerate(_KINDS)])
