"""Near-duplicate pairs by split trees against all pairs."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriframe.operators import neighbours
from veriframe.schemas import FEATURES

TOLERANCE = np.array([0.1, 0.001, 0.001, 1, 0.1, 0.1])


def frame(spark, rows):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{f} double" for f in FEATURES))


def scores_at(z):
    """Scores whose scaled vectors are about ``z``."""
    rows = z * TOLERANCE
    rows[:, 3] = np.expm1(z[:, 3] * 0.01)
    return rows


def close_pairs(rows, other=None):
    z = lambda x: np.c_[x[:, :3] / TOLERANCE[:3], np.log1p(x[:, 3]) / 0.01, x[:, 4:] / TOLERANCE[4:]]
    a, total = z(rows), 0
    b = a if other is None else z(other)
    for i in range(len(a)):
        total += int((np.abs(b[(i + 1 if other is None else 0):] - a[i]).max(axis=1) <= 1).sum()) if len(b) else 0
    return total


@pytest.mark.parametrize("tile_rows", [60, 100_000])
@pytest.mark.parametrize("spread", [0.3, 1.5, 3.0])
def test_pairs_of_one_cloud(spark, tile_rows, spread):
    rng = np.random.default_rng(int(spread * 10))
    rows = scores_at(200 + rng.normal(0, spread, (700, 6)) * rng.choice([0.2, 1.0], (700, 1)))
    rows = np.concatenate([rows, np.repeat(rows[:2], 40, axis=0), scores_at(rng.uniform(0, 400, (100, 6)))])
    kinds = {r.kind: r.pairs for r in neighbours.near_duplicate_pairs(frame(spark, rows), tile_rows=tile_rows).collect()}
    assert set(kinds) == {"identical", "whole_tiles", "whole_nodes", "compared"}
    assert sum(kinds.values()) == close_pairs(rows) and kinds["identical"] == 2 * (41 * 40 // 2)


def test_a_crowded_neighbourhood_is_counted_without_comparing(spark):
    n = 50_000
    z = F.rand(7)
    columns = [(F.lit(200 * t) + F.rand(i) * (0.9 * t)).alias(f) for i, (f, t) in enumerate(zip(FEATURES, TOLERANCE)) if f != FEATURES[3]]
    rows = spark.range(n).select(*columns, F.expm1(2 + z * 0.009).alias(FEATURES[3]))
    kinds = {r.kind: r.pairs for r in neighbours.near_duplicate_pairs(rows, tile_rows=4000).collect()}
    assert sum(kinds.values()) == n * (n - 1) // 2
    assert kinds["compared"] == 0 and kinds["whole_tiles"] > kinds["whole_nodes"] > 0


def test_leaves_are_reached_by_few_pairs():
    """Points on a long line: the walk stays near the diagonal."""
    rng = np.random.default_rng(1)
    x = np.zeros((20_000, 6))
    x[:, 0] = rng.uniform(0, 20_000, 20_000)
    whole, compared = neighbours.count_close(neighbours._Nodes(x, np.ones(len(x), np.int64)))
    ordered = np.sort(x[:, 0])
    assert whole + compared == (np.searchsorted(ordered, ordered + 1, side="right") - np.arange(1, len(x) + 1)).sum()


def test_pairs_between_tables(spark):
    rng = np.random.default_rng(6)
    first, second = (scores_at(200 + rng.normal(0, 1.2, (n, 6))) for n in (150, 120))
    second = np.concatenate([second, first[:5]])
    row = neighbours.near_duplicate_pairs_between(frame(spark, first), frame(spark, second)).first()
    assert row.near_pairs_between == close_pairs(first, second)
    assert row.near_pairs == close_pairs(np.concatenate([first, second])) and row.exact_duplicates == 5


def test_empty_and_nulls(spark):
    none = frame(spark, [[1.0] * 6]).where("false")
    assert {r.pairs for r in neighbours.near_duplicate_pairs(none).collect()} == {0}
    some = frame(spark, [[1.0] * 6] * 3).unionByName(frame(spark, [[1.0] * 6] * 2).withColumn(FEATURES[2], F.lit(None).cast("double")))
    assert sum(r.pairs for r in neighbours.near_duplicate_pairs(some).collect()) == 3


@pytest.mark.parametrize("tile_rows", [40, 100_000])
def test_nearest_distances_across_tiles(spark, tile_rows):
    """Dense and thin parts, lone vectors far away, copies; null and infinite components have no distance."""
    rng = np.random.default_rng(11)
    crowd, thin = 200 + rng.normal(0, 0.2, (900, 6)), rng.uniform(0, 400, (80, 6))
    rows = scores_at(np.concatenate([crowd, thin, [[3000.0] * 3 + [600.0] + [3000.0] * 2]]))
    odd = np.array([rows[0], rows[1]])
    odd[:, 1] = [np.inf, np.nan]
    frames = frame(spark, np.concatenate([rows, rows[:1]])).unionByName(frame(spark, odd[:1]))
    frames = frames.unionByName(frame(spark, odd[1:]).withColumn(FEATURES[1], F.lit(None).cast("double")))
    got = neighbours.nearest_distances(frames, tile_rows=tile_rows).toPandas()
    z = np.c_[rows[:, :3] / TOLERANCE[:3], np.log1p(rows[:, 3]) / 0.01, rows[:, 4:] / TOLERANCE[4:]]
    far = np.array([np.sort(np.abs(z - v).max(axis=1))[1] for v in z])
    far[0] = 0.0
    assert got.distance.isna().sum() == 2 and got.w.sum() == len(rows) + 3
    assert np.sort(got.distance.dropna()) == pytest.approx(np.sort(far))


def test_nearest_search_opens_few_leaves(monkeypatch):
    """A crowd in one unit of space: only a small share of all pairs is compared."""
    rng = np.random.default_rng(12)
    x = rng.uniform(0, 1, (20_000, 6))
    compared, inner = [0], neighbours._gaps
    monkeypatch.setattr(neighbours, "_gaps", lambda nodes, numbers, points: compared.__setitem__(0, compared[0] + len(numbers)) or inner(nodes, numbers, points))
    far = neighbours.nearest_within(neighbours._Nodes(x, np.ones(len(x), np.int64)), x, np.full(len(x), np.inf))
    assert compared[0] < len(x) * 1000
    for i in range(0, len(x), 997):
        assert far[i] == np.sort(np.abs(x - x[i]).max(axis=1))[1]


def test_leaves_are_compared_by_bit_sets():
    """Half a billion candidate pairs on a lattice, many exactly at distance 1, within seconds: vector by vector they take much longer."""
    rng = np.random.default_rng(9)
    rows = np.round(rng.uniform(0, 3, (1500, 6)), 1)
    weights = rng.integers(1, 6, len(rows))
    near = np.ones((len(rows), len(rows)), bool)
    for axis in range(6):
        near &= np.abs(rows[:, axis][:, None] - rows[:, axis][None, :]) <= 1
    pairs = weights[:, None] * weights[None, :] * near
    for leaf in (5, 64, 700, neighbours.BITS):
        whole, compared = neighbours.count_close(neighbours._Nodes(rows, weights, leaf))
        assert whole + compared == (pairs.sum() - (weights**2).sum()) // 2
        one, two = (neighbours._Nodes(rows[own], weights[own], leaf) for own in (slice(0, 600), slice(600, None)))
        assert sum(neighbours.count_close(one, two)) == pairs[:600, 600:].sum()
    crowd = rng.uniform(0, 3, (30_000, 6))
    nodes, begun = neighbours._Nodes(crowd, np.ones(len(crowd), np.int64), neighbours.BITS), time.time()
    assert neighbours.count_close(nodes)[1] > 0 and time.time() - begun < 8
