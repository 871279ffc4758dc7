"""The joint margin solver against a plain one-model solver, and its whole registered grid."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veriframe.operators import margins
from veriframe.operators.selection import folds
from veriframe.schemas import CLASSES, FEATURES


def labelled(spark, n=300, seed=5):
    rng = np.random.default_rng(seed)
    code = rng.integers(0, 3, n)
    values = rng.uniform(0, 1, (n, len(FEATURES))) * [100, 1, 1, 300, 255, 128]
    values[:, 0] = np.clip(80 - 30 * code + rng.normal(0, 15, n), 0, 100)
    rows = [(i, CLASSES[c], *map(float, v)) for i, (c, v) in enumerate(zip(code, values))]
    return spark.createDataFrame(rows, "request_id bigint, target string, " + ", ".join(f"{f} double" for f in FEATURES)).repartition(4)


def plain_fit(values, codes, cost, gamma, directions, rounds=4000):
    """One model by accelerated steps in double precision; (weights, objective per class)."""
    low, high = values.min(axis=0), values.max(axis=0)
    scaled = (values - low) / (high - low)
    size = len(directions.shift)
    lifted = np.c_[np.sqrt(2 / size) * np.cos(scaled @ directions.weights.astype(float) * np.sqrt(2 * gamma) + directions.shift), np.ones(len(values))]
    n, counts = len(codes), np.bincount(codes, minlength=3)
    share = (n / (3 * counts))[codes][:, None]
    sign = np.where(codes[:, None] == np.arange(3), 1.0, -1.0)
    free = np.r_[np.ones(size), 0][:, None]

    def value(w):
        gap = np.clip(1 - sign * (lifted @ w), 0, None)
        loss = np.where(gap < margins.SMOOTHING, gap**2 / (2 * margins.SMOOTHING), gap - margins.SMOOTHING / 2)
        slope = np.clip(gap / margins.SMOOTHING, 0, 1)
        return (loss * share).mean(axis=0) + (free * w**2).sum(axis=0) / (2 * cost * n), -(lifted.T @ (slope * sign * share)) / n + free * w / (cost * n)

    step = 1 / (np.linalg.norm(lifted * np.sqrt(share), 2) ** 2 / n / margins.SMOOTHING + 1 / (cost * n))
    w = ahead = np.zeros((size + 1, 3))
    t = 1.0
    for _ in range(rounds):
        new = ahead - step * value(ahead)[1]
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (before - 1) / t * (new - w), new
    return w, value(w)[0], value


@pytest.mark.parametrize("cost,gamma", [(1.0, 1.0), (100.0, 0.1)])
def test_one_model_reaches_the_plain_optimum(spark, cost, gamma):
    rows = labelled(spark)
    model = margins.fit_margin_model(rows, cost, gamma, size=32)
    local = rows.orderBy("request_id").toPandas()
    values, codes = local[FEATURES].to_numpy(float), local.target.map(CLASSES.index).to_numpy()
    _, best, value = plain_fit(values, codes, cost, gamma, model.directions)
    assert (value(model.weights.astype(float))[0] <= best * 1.01 + 1e-3).all()
    scored = {r.request_id: r for r in margins.predict_margins(model, rows).collect()}
    own = model.margins(values)
    assert all(scored[i].predicted == CLASSES[own[i].argmax()] for i in range(len(own)))


def test_grid_equals_models_fitted_one_by_one(spark):
    rows = labelled(spark)
    table = margins.tune_margin_model(rows, "request_id", costs=(0.1, 10.0), gammas=(0.1, "scale"), k=3, size=24, passes=150)
    local = folds(rows, "request_id", 3).orderBy("request_id").toPandas()
    values, codes, fold = local[FEATURES].to_numpy(float), local.target.map(CLASSES.index).to_numpy(), local.fold.to_numpy()
    directions = margins.Directions.drawn(len(FEATURES), 24, 42)
    assert table.count() == 4
    for r in table.collect():
        scores = []
        for f in range(3):
            train = values[fold != f]
            scaled = (train - train.min(axis=0)) / (train.max(axis=0) - train.min(axis=0))
            gamma = 0.1 if r.width == "0.1" else 1 / (6 * scaled.var())
            w, _, _ = plain_fit(train, codes[fold != f], r.cost, gamma, directions, 2000)
            model = margins.MarginModel(w, gamma, directions, margins.Scaling(train.min(axis=0), train.max(axis=0)))
            guess, own = model.margins(values[fold == f]).argmax(axis=1), codes[fold == f]
            f1 = [2 * ((guess == c) & (own == c)).sum() / ((guess == c).sum() + (own == c).sum()) for c in range(3)]
            scores.append(np.mean(f1))
        assert r.macro_f1 == pytest.approx(np.mean(scores), abs=0.03)


def test_minimise_handles_rows_on_their_own():
    centres = np.array([[0.0, 0.0], [3.0, -4.0], [1e3, 1e-3]])
    bends = np.array([[1.0, 1.0], [100.0, 0.1], [1e-2, 10.0]])
    calls = []

    def evaluate(w):
        calls.append(1)
        return (bends * (w - centres) ** 2).sum(axis=1), 2 * bends * (w - centres)

    found, value = margins.minimise(evaluate, np.zeros((3, 2)), 200, tolerance=1e-8)
    assert np.abs(found - centres).max() < 1e-3 and (value < 1e-4).all() and len(calls) < 120


def test_folds_share_features_and_resting_vectors_cost_nothing(monkeypatch):
    """Five folds of one scaling and width lift the rows once; a fold of its own scaling lifts them again, a vector not asked for never."""
    rng = np.random.default_rng(2)
    n, k, size = 500, len(CLASSES), 16
    rows = {f: rng.uniform(0, 1, n) for f in FEATURES} | {"code": rng.integers(0, k, n), "fold": rng.integers(0, 5, n)}
    batch = pa.RecordBatch.from_pydict(rows)
    directions = margins.Directions.drawn(len(FEATURES), size, 1)
    low, high = np.zeros(len(FEATURES)), np.ones(len(FEATURES))
    parts = tuple(margins.Part(f, n, margins.Scaling(low, high * (2 if f == 4 else 1)), np.array([1.0, 2.0, 0.5]), (0.5,)) for f in range(5))
    weights = rng.normal(0, 1, (5, 1, size + 1, k))
    asked = np.ones((5, 1, k), bool)
    asked[1], asked[2, 0, 0] = False, False
    lifts, lift = [], margins.Directions.lift
    monkeypatch.setattr(margins.Directions, "lift", lambda *a: lifts.append(1) or lift(*a))
    losses, slopes = margins._gradients([batch], parts, directions, weights, asked, FEATURES)
    assert len(lifts) == 2 and not losses[~asked].any() and not slopes[1].any()
    values = np.stack([rows[f] for f in FEATURES], axis=1)
    for p, part in enumerate(parts):
        mine = rows["fold"] != part.fold
        lifted = lift(directions, part.scaling.apply(values[mine]) @ directions.weights, 0.5).astype(float)
        sign = np.where(rows["code"][mine][:, None] == np.arange(k), 1.0, -1.0)
        gap = np.clip(1 - sign * (lifted @ weights[p, 0]), 0, None)
        share = part.class_weights[rows["code"][mine]][:, None]
        loss = np.where(gap < margins.SMOOTHING, gap**2 / (2 * margins.SMOOTHING), gap - margins.SMOOTHING / 2)
        slope = -lifted.T @ (np.clip(gap / margins.SMOOTHING, 0, 1) * sign * share)
        assert losses[p, 0][asked[p, 0]] == pytest.approx((loss * share).sum(axis=0)[asked[p, 0]], rel=1e-4)
        assert slopes[p, 0][:, asked[p, 0]] == pytest.approx(slope[:, asked[p, 0]], rel=1e-3, abs=1e-2)


def test_registered_grid_is_whole(spark, monkeypatch):
    seen = {}
    tune = margins.tune_margin_model
    monkeypatch.setattr(margins, "tune_margin_model", lambda *a, **k: seen.setdefault("table", tune(*a, **k)))
    (row,) = entry.queries()["m8_margin_model"](spark, "/root/testdata/sf0.001").collect()
    grid = {(r.cost, r.width) for r in seen["table"].collect()}
    assert grid == {(c, w) for c in (0.1, 1.0, 10.0, 100.0) for w in ("0.001", "0.01", "0.1", "1.0", "scale", "auto")}
    assert row.n > 0 and (row.cost, row.gamma) == tuple(seen["table"].first())[:2]


def test_nulls_constant_features_and_missing_classes(spark):
    rows = labelled(spark).where(F.col("target") != CLASSES[1]).withColumn(FEATURES[1], F.lit(0.5))
    rows = rows.withColumn(FEATURES[0], F.when(F.col("request_id") % 7 > 0, F.col(FEATURES[0])))
    model = margins.fit_margin_model(rows, size=16, passes=30)
    assert np.isfinite(model.weights).all()
    guesses = {r.predicted for r in margins.predict_margins(model, rows.dropna()).collect()}
    assert CLASSES[1] not in guesses and len(guesses) == 2
