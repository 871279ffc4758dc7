"""Trees, calibration, bootstrap and permutations against plain versions."""

import hashlib
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_margin_grid import labelled
from veriframe import session
from veriframe.operators import calibration, evaluation, trees
from veriframe.schemas import CLASSES, FEATURES


def plain_tree(bins, codes, weights, leaf, depth, node=1, level=0):
    """{node: (counts, feature, bin)} by trying every split of every node."""
    counts = np.bincount(codes, minlength=3)
    purity = lambda c: ((weights * c) ** 2).sum() / (weights * c).sum()
    best = None
    if level < depth:
        for f in range(bins.shape[1]):
            for b in np.unique(bins[:, f]):
                left = np.bincount(codes[bins[:, f] <= b], minlength=3)
                right = counts - left
                if min(left.sum(), right.sum()) >= max(leaf, 1):
                    score = purity(left) + purity(right)
                    if best is None or score > best[0]:
                        best = (score, f, b)
    if best is None or best[0] <= purity(counts) * (1 + 1e-9):
        return {node: (counts.tolist(), None, None)}
    _, f, b = best
    side = bins[:, f] <= b
    return {node: (counts.tolist(), f, int(b))} | plain_tree(bins[side], codes[side], weights, leaf, depth, 2 * node, level + 1) | plain_tree(
        bins[~side], codes[~side], weights, leaf, depth, 2 * node + 1, level + 1)


def test_tree_equals_exhaustive_growth(spark):
    rows = labelled(spark, 200).withColumn(FEATURES[4], F.lit(3.0)).withColumn("fold", F.lit(0))
    data = trees.binned(rows)
    local = data.toPandas()
    bins, codes = np.array(local.bins.tolist()), local.code.to_numpy()
    counts = np.bincount(codes, minlength=3)
    want = plain_tree(bins, codes, counts.sum() / (3 * counts), 7, 4)
    got = {r.node: ([r.n0, r.n1, r.n2], r.feature, r.bin) for r in trees.grow(data, [trees.TreeSpec(-1, 7)], 4)[0].collect()}
    assert got == want and any(f is not None for _, f, _ in want.values())
    shares = {r.feature: r.importance for r in trees.tree_importances(trees.fit_tree(rows.drop("fold"), 4, 7)).collect()}
    assert sum(shares.values()) == pytest.approx(1) and shares[FEATURES[4]] == 0


def test_trees_without_splits(spark):
    rows = labelled(spark, 30).withColumns({f: F.lit(1.0) for f in FEATURES}).withColumn("fold", F.lit(0))
    nodes = trees.fit_tree(rows.drop("fold"), 5, 1)
    assert [(r.node, r.feature) for r in nodes.collect()] == [(1, None)]
    assert {r.importance for r in trees.tree_importances(nodes).collect()} == {0.0}
    one = trees.fit_tree(rows.where(F.col("target") == CLASSES[2]), 5, 1).collect()
    assert [(r.node, r.label) for r in one] == [(1, 2)]


def max_min(hits, n):
    return [max(min(sum(hits[a: b + 1]) / sum(n[a: b + 1]) for b in range(i, len(n))) for a in range(i + 1)) for i in range(len(n))]


def test_pooling_equals_max_min_formula_in_any_parts():
    rng = np.random.default_rng(2)
    for size in (1, 2, 7, 40):
        n = rng.integers(1, 5, size).tolist()
        hits = [int(rng.integers(0, x + 1)) for x in n]
        blocks = calibration.pooled(range(size), range(size), hits, n)
        for cut in range(size + 1):
            parts = calibration.pooled(range(cut), range(cut), hits[:cut], n[:cut]) + calibration.pooled(range(cut, size), range(cut, size), hits[cut:], n[cut:])
            assert calibration.pooled(*zip(*parts)) == blocks
        fitted = [h / w for low, high, h, w in blocks for _ in range(low, high + 1)]
        assert fitted == pytest.approx(max_min(hits, n))


def margin_rows(spark, n=400):
    rng = np.random.default_rng(8)
    rows = []
    for candidate in ("x", "y"):
        code = rng.integers(0, 3, n)
        margins = rng.normal(0, 1, (n, 3)) + 1.5 * (code[:, None] == np.arange(3))
        rows += [(candidate, CLASSES[c], *map(float, np.round(m, 1))) for c, m in zip(code, margins)]
    return spark.createDataFrame(rows + [("x", None, 0.0, 0.0, 0.0)], "candidate string, target string, m_verified double, m_review double, m_rejected double")


def test_calibration_reaches_the_optimum_of_each_candidate(spark):
    held = margin_rows(spark)
    local = held.toPandas().dropna()
    pts = calibration.points(held, ["candidate"])
    for r in calibration.fit_sigmoid(pts, ["candidate"]).collect():
        own = local[local.candidate == r.candidate]
        m, hit = own[f"m_{r.kind}"].to_numpy(), (own.target == dict(zip(("verified", "review", "rejected"), CLASSES))[r.kind]).to_numpy()
        t = np.where(hit, (hit.sum() + 1) / (hit.sum() + 2), 1 / ((~hit).sum() + 2))
        p = 1 / (1 + np.exp(r.slope * m + r.offset))
        assert abs((t - p).sum()) < 1e-5 and abs((m * (t - p)).sum()) < 1e-5
    for r in calibration.fit_temperature(held, ["candidate"]).collect():
        own = local[local.candidate == r.candidate]
        m = own[["m_verified", "m_review", "m_rejected"]].to_numpy()
        mine = m[np.arange(len(m)), own.target.map(CLASSES.index)]
        loss = lambda beta: (np.log(np.exp(beta * m).sum(axis=1)) - beta * mine).mean()
        assert loss(r.beta) <= min(loss(b) for b in np.linspace(0.2, 4, 400)) + 1e-9


@pytest.mark.parametrize("part_points", [5, 50_000])
def test_isotonic_curves_by_parts(spark, part_points, monkeypatch):
    monkeypatch.setattr(calibration, "PART_POINTS", part_points)
    held = margin_rows(spark)
    pts = calibration.points(held, ["candidate"])
    blocks = calibration.fit_isotonic(pts, ["candidate"], part_points)
    wanted = spark.createDataFrame([(c, k, float(x)) for c in "xy" for k in ("verified", "review", "rejected") for x in np.arange(-5, 5, 0.07)], "candidate string, kind string, margin double")
    got = {(r.candidate, r.kind, r.margin): r.value for r in calibration._interpolated(blocks, wanted, ["candidate"], part_points).collect()}
    assert len(got) == wanted.count()
    for (candidate, kind), own in pts.toPandas().sort_values("margin").groupby(["candidate", "kind"]):
        fitted = max_min(own.hits.tolist(), own.n.tolist())
        mine = sorted((x, v) for (c, k, x), v in got.items() if (c, k) == (candidate, kind))
        assert [v for _, v in mine] == pytest.approx(np.interp([x for x, _ in mine], own.margin, fitted), abs=1e-9)


def test_bootstrap_intervals(spark):
    """Agrees with multinomial draws, and groups do not mix."""
    rng = np.random.default_rng(4)
    cells = {(a, f, s): int(rng.integers(0, 60)) for a in range(3) for f in range(3) for s in range(3)}
    rows = [(key, CLASSES[a], CLASSES[f], CLASSES[s]) for key, many in (("few", 1), ("more", 4)) for (a, f, s), n in cells.items() for _ in range(n * many)]
    frame = spark.createDataFrame(rows, "candidate string, target string, one string, two string")
    got = {r.candidate: r for r in evaluation.paired_bootstrap(frame, "target", "one", "two", ["candidate"]).collect()}
    names, n = list(cells), np.array(list(cells.values()))
    gain = np.array([(a == f) - (a == s) for a, f, s in names])
    for key, many in (("few", 1), ("more", 4)):
        drawn = rng.multinomial(n.sum() * many, n / n.sum(), 20000) @ gain / (n.sum() * many)
        width = np.quantile(drawn, 0.975) - np.quantile(drawn, 0.025)
        assert got[key].repeats == 1000
        assert got[key].accuracy_difference_low == pytest.approx(np.quantile(drawn, 0.025), abs=0.12 * width)
        assert got[key].accuracy_difference_high == pytest.approx(np.quantile(drawn, 0.975), abs=0.12 * width)


def test_small_draws_follow_the_distribution(spark):
    steps = evaluation.poisson_steps()
    assert all(abs(sum(1 - c for n, _, c in steps if n == mean) - mean) < 1e-6 for mean in range(1, evaluation.SMALL_CELL))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_row_numbers_are_permuted(spark, n):
    seen = Counter()
    for repeat in range(6):
        frame = spark.range(n).selectExpr("id as k")
        for prime, shift, cut in evaluation.shuffle_keys(repeat):
            frame = frame.selectExpr(f"{evaluation.moved_sql('k', f'{n}L', f'{prime}L', f'{shift}L')} as k")
            frame = frame.selectExpr(f"{evaluation.turned_sql('k', f'{n}L', f'({n}L * {cut}L div 1000)')} as k")
        numbers = [r.k for r in frame.collect()]
        assert sorted(numbers) == list(range(n))
        seen[tuple(numbers)] += 1
    assert n < 10 or len(seen) == 6


def test_importance_pairs_every_repeat_by_its_own_hash_order_without_broadcast(spark):
    features, n = ["a", "b"], 300
    rng = np.random.default_rng(8)
    rows = [(i, CLASSES[int(rng.integers(0, 3))], float(rng.random()), float(rng.random())) for i in range(n)]
    label = lambda a, b: CLASSES[0] if a + b / 4 > 0.7 else CLASSES[1] if a > 0.3 else CLASSES[2]
    as_column = lambda c: F.when(c[0] + c[1] / 4 > 0.7, CLASSES[0]).when(c[0] > 0.3, CLASSES[1]).otherwise(CLASSES[2])
    result = evaluation.permutation_importance(spark.createDataFrame(rows, "id bigint, target string, a double, b double"), "id", as_column, repeats=4, features=features)
    got = {r.feature: (r.importance, r.std) for r in result.collect()}
    digest = lambda text: hashlib.md5(text.encode()).hexdigest()
    home = sorted(rows, key=lambda r: (digest(f"home:{r[0]}"), r[0]))

    def macro_f1(pairs):
        f1 = []
        for c in CLASSES:
            hits, both = sum(t == p == c for t, p in pairs), sum(t == c for t, _ in pairs) + sum(p == c for _, p in pairs)
            f1.append(2 * hits / both if both else 0.0)
        return sum(f1) / 3

    base = macro_f1([(r[1], label(r[2], r[3])) for r in rows])
    for i, feature in enumerate(features):
        drops = []
        for repeat in range(4):
            away = sorted(rows, key=lambda r: (digest(f"{repeat}:{r[0]}"), r[0]))
            moved = [(h[1], label(a[2], h[3]) if i == 0 else label(h[2], a[3])) for h, a in zip(home, away)]
            drops.append(base - macro_f1(moved))
        assert got[feature] == pytest.approx((np.mean(drops), np.std(drops)))
    # the exploded side is never sent whole to every task
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan


@pytest.mark.parametrize("local_rows", [0, 150, 100_000])
def test_small_and_large_nodes_grow_the_same_tree(spark, local_rows):
    """Subtrees grown in one group, and nodes counted over all tasks, against exhaustive growth; held-out rows at every level."""
    rng = np.random.default_rng(8)
    bins, codes, fold = rng.integers(0, 12, (1200, 6)), rng.integers(0, 3, 1200), rng.integers(0, 3, 1200)
    codes = np.where(bins[:, 2] > 6, codes, np.minimum(codes, bins[:, 4] // 5))
    data = spark.createDataFrame([(int(f), int(c), b.tolist()) for f, c, b in zip(fold, codes, bins)], "fold int, code int, bins array<int>")
    learn = fold != 1
    counts = np.bincount(codes[learn], minlength=3)
    want = plain_tree(bins[learn], codes[learn], counts.sum() / (3 * counts), 4, 7)
    nodes, held = trees.grow(data, [trees.TreeSpec(1, 4), trees.TreeSpec(1, 4, 2)], 7, local_rows=local_rows)
    nodes = nodes.where("tree = 0").collect()
    assert {r.node: ([r.n0, r.n1, r.n2], r.feature, r.bin) for r in nodes} == want
    label, level = {r.node: r.label for r in nodes}, {}
    for b, c in zip(bins[~learn], codes[~learn]):
        node = 1
        while True:
            at = (node.bit_length() - 1, want[node][1] is None, int(c), label[node])
            level[at] = level.get(at, 0) + 1
            if want[node][1] is None:
                break
            node = 2 * node + int(b[want[node][1]] > want[node][2])
    got = held.where("tree = 0").groupBy("level", "leaf", "code", "label").agg(F.sum("n").alias("n")).collect()
    assert {(r.level, r.leaf, r.code, r.label): r.n for r in got} == level


def test_equal_values_meet_the_powers_once(spark, monkeypatch):
    from veriframe.operators import selection

    rows = spark.range(2000).select((F.col("id") % 40 * 7.5 + 1).alias("blur_score"))
    seen, inner = [], selection.power_likelihoods
    monkeypatch.setattr(selection, "power_likelihoods", lambda long, powers: seen.append((long, powers)) or inner(long, powers))
    chosen = selection.fit_power(rows, ("blur_score",))
    assert seen[0][0].count() == 40 and -2 < chosen["blur_score"] < 4
    plain = inner(rows.unpivot([], ["blur_score"], "feature", "value"), seen[0][1]).toPandas().sort_values("power")
    merged = inner(*seen[0]).toPandas().sort_values("power")
    assert merged.log_likelihood.to_numpy() == pytest.approx(plain.log_likelihood.to_numpy(), rel=1e-9)


def test_importance_takes_its_repeats_in_passes_that_leave_only_counts(spark, monkeypatch):
    exploded, ranked, released = [], evaluation.hash_rank, []
    monkeypatch.setattr(evaluation, "hash_rank", lambda df, *rest, **kw: exploded.append(df.count()) or ranked(df, *rest, **kw))
    monkeypatch.setattr(session, "release_shuffles", lambda _: released.append(1))
    rng = np.random.default_rng(9)
    rows = [(i, CLASSES[int(rng.integers(0, 3))], float(rng.random()), float(rng.random())) for i in range(300)]
    as_column = lambda c: F.when(c[0] + c[1] / 4 > 0.7, CLASSES[0]).when(c[0] > 0.3, CLASSES[1]).otherwise(CLASSES[2])
    table = spark.createDataFrame(rows, "id bigint, target string, a double, b double")
    importance = lambda **kw: sorted((r.feature, round(r.importance, 12), round(r.std, 12)) for r in evaluation.permutation_importance(table, "id", as_column, repeats=5, features=["a", "b"], **kw).collect())
    whole = importance()
    assert exploded == [300, 1500] and not released
    for pass_rows, sizes in ((700, [600, 600, 300]), (10, [300] * 5)):  # 10: less than a repeat
        exploded.clear(), released.clear()
        with session.intermediates() as written:
            assert importance(pass_rows=pass_rows) == whole
        assert exploded == [300, *sizes]
        assert len(released) >= len(sizes)
        assert not os.path.exists(next(p for p in written if "permuted-rows" in p).removeprefix("file:"))
