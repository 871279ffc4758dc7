"""Calibration of margins on a held-out part: sigmoid, isotonic and temperature, for every candidate at once.

``rows``: key columns (a candidate), target and the margins m_verified, m_review, m_rejected. A fit reads points, the counts of
each distinct margin of a class; all candidates and classes are fitted in the same passes.

* Sigmoid: Newton steps on sums over the points, with targets drawn in by one row of each kind.
* Isotonic: adjacent blocks whose means fall are pooled. Pooling works part by part of the margin's range, since merged stacks of
  blocks of two neighbouring parts pool to the same result; a curve of n rows has some n^(2/3) blocks at most, as the means
  of blocks of whole counts are fractions that all differ. Between blocks the curve is a straight line, beyond them it is level.
* Temperature: Newton steps on the mean and variance of the margins under the scaled distribution.

Calibrated values of the three classes are normalised (a third each if all are 0). Null margins and targets are left out of fits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from veriframe.schemas import CLASS_KEYS, CLASSES
from veriframe.session import cut_lineage

PART_POINTS = 50_000  # a part of a margin's range holds about so many distinct margins
_M = [f"m_{k}" for k in CLASS_KEYS]


def _long(rows, keys, columns, names):
    """A row per class: keys, kind and ``names`` from the column groups ``columns``."""
    parts = ", ".join(f"'{k}', " + ", ".join(c.format(k=k, c=CLASSES[i]) for c in columns) for i, k in enumerate(CLASS_KEYS))
    return rows.selectExpr(*keys, f"stack({len(CLASS_KEYS)}, {parts}) as (kind, {', '.join(names)})")


def points(held, keys):
    """(keys, kind, margin, hits, n): counts of each distinct margin of a class."""
    long = _long(held.where("target is not null"), keys, ("m_{k}", "int(target = '{c}')"), ("margin", "hit")).where("margin is not null")
    return long.groupBy(*keys, "kind", "margin").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"))


def _curves(spark, keys, kinds, params, names):
    """Parameters of every fitted curve as a table: a row per candidate and class."""
    schema = ", ".join(f"`{k}` string" for k in (*keys, *kinds)) + ", " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame([(*map(str, group), *map(float, own)) for group, own in params.items()], schema)


def _newton(spark, keys, kinds, start, sums, names, passes=60):
    """Minimise one function per group together: ``sums`` turns a table of parameters into loss, gradient and curvature rows."""
    current, state, ahead = dict(start), {}, {g: np.zeros(len(names)) for g in start}
    for _ in range(passes):
        trial = {g: current[g] + ahead[g] for g in current}
        for r in sums(_curves(spark, keys, kinds, trial, names)).collect():  # a row per candidate and class
            group = tuple(str(r[k]) for k in (*keys, *kinds))
            slope, bend = np.array(r["slope"], float), np.array(r["bend"], float).reshape(len(names), len(names))
            if group not in state or r["loss"] <= state[group] + 1e-12 * abs(state[group]):
                state[group], current[group] = r["loss"], trial[group]
                ahead[group] = -np.linalg.solve(bend + 1e-12 * np.eye(len(names)) * max(1.0, np.trace(bend)), slope)
            else:
                ahead[group] = ahead[group] / 2
        if all(np.abs(step).max() < 1e-9 * (1 + np.abs(current[g]).max()) for g, step in ahead.items()):
            break
    return _curves(spark, keys, kinds, current, names)


def fit_sigmoid(pts, keys):
    """(keys, kind, slope, offset): p = 1 / (1 + exp(slope * margin + offset))."""
    spark = pts.sparkSession
    totals = cut_lineage(pts.groupBy(*keys, "kind").agg(F.sum("hits").cast("double").alias("yes"), F.sum(F.col("n") - F.col("hits")).cast("double").alias("no")), "class-totals")
    start = {tuple(str(r[k]) for k in (*keys, "kind")): np.array([0.0, np.log((r["no"] + 1) / (r["yes"] + 1))]) for r in totals.collect()}  # a row per candidate and class
    soft = pts.join(F.broadcast(totals), [*keys, "kind"]).selectExpr(
        *keys, "kind", "margin", "n", "hits * ((yes + 1) / (yes + 2)) + (n - hits) / (no + 2) as soft")

    def sums(curves):
        scored = soft.join(F.broadcast(curves), [*keys, "kind"]).selectExpr(*keys, "kind", "margin", "n", "soft", "slope * margin + offset as f")
        scored = scored.selectExpr("*", "1 / (1 + exp(f)) as p", "greatest(f, 0D) + log1p(exp(-abs(f))) as partition")
        return scored.groupBy(*keys, "kind").agg(
            F.expr("sum(n * partition - (n - soft) * f) loss"), F.expr("array(sum(margin * (soft - n * p)), sum(soft - n * p)) slope"),
            F.expr("array(sum(n * p * (1 - p) * margin * margin), sum(n * p * (1 - p) * margin), sum(n * p * (1 - p) * margin), sum(n * p * (1 - p))) bend"))

    return _newton(spark, keys, ["kind"], start, sums, ("slope", "offset"))


def fit_temperature(held, keys):
    """(keys, beta): margins are multiplied by beta (one over the temperature) before the exponentials."""
    rows = held.selectExpr(*keys, *_M, "case target " + " ".join(f"when '{c}' then m_{k}" for c, k in zip(CLASSES, CLASS_KEYS)) + " end own").dropna()
    rows = cut_lineage(rows, "temperature-rows")
    start = {tuple(str(r[k]) for k in keys): np.array([1.0]) for r in rows.select(*keys).distinct().collect()}  # a row per candidate

    def sums(curves):
        top = f"greatest({', '.join(f'beta * {m}' for m in _M)})"
        lifted = rows.join(F.broadcast(curves), list(keys)).selectExpr("*", f"{top} as top").selectExpr("*", *[f"exp(beta * {m} - top) as e{i}" for i, m in enumerate(_M)])
        lifted = lifted.selectExpr("*", "e0 + e1 + e2 as z").selectExpr("*", "(" + " + ".join(f"e{i} * {m}" for i, m in enumerate(_M)) + ") / z as mean",
                                                                         "(" + " + ".join(f"e{i} * {m} * {m}" for i, m in enumerate(_M)) + ") / z as square")
        return lifted.groupBy(*keys).agg(F.expr("sum(top + ln(z) - beta * own) loss"), F.expr("array(sum(mean - own)) slope"), F.expr("array(sum(square - mean * mean)) bend"))

    return _newton(held.sparkSession, keys, [], start, sums, ("beta",))


def pooled(low, high, hits, n):
    """Adjacent blocks (in order) pooled until their means rise; arrays low, high, hits, n."""
    stack = []
    for own in zip(low, high, hits, n):
        while stack and stack[-1][2] * own[3] >= own[2] * stack[-1][3]:  # mean not below the next one's
            before = stack.pop()
            own = (before[0], own[1], before[2] + own[2], before[3] + own[3])
        stack.append(own)
    return stack


_BLOCK = "low double, high double, hits bigint, n bigint"


def _pool(rows, groups):
    """Blocks of each group, pooled in the order of their margins."""
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in rows.select(*groups).dtypes)

    def run(key, frame):
        frame = frame.sort_values("low")
        out = pd.DataFrame(pooled(*(frame[c].tolist() for c in ("low", "high", "hits", "n"))), columns=["low", "high", "hits", "n"])
        for i, name in enumerate(groups):
            out.insert(i, name, key[i])
        return out

    return rows.groupBy(*groups).applyInPandas(run, f"{kinds}, {_BLOCK}")


def _parts(pts, keys, part_points):
    """Cut points of each curve's range: (keys, kind, edges)."""
    count = max(1, min(4096, pts.count() // part_points))
    grid = [i / (count + 1) for i in range(1, count + 1)]
    return cut_lineage(pts.groupBy(*keys, "kind").agg(F.percentile_approx("margin", grid, 10_000).alias("edges")), "curve-parts")


def _placed(rows, edges, keys, column):
    """``rows`` with the number of their part."""
    return rows.join(F.broadcast(edges), [*keys, "kind"]).withColumn("part", F.expr(f"size(filter(edges, e -> e < {column}))")).drop("edges")  # a row per curve


def fit_isotonic(pts, keys, part_points=PART_POINTS):
    """(keys, kind, low, high, hits, n): the blocks of rising means of each curve."""
    edges = _parts(pts, keys, part_points)
    rows = _placed(pts, edges, keys, "margin").selectExpr(*keys, "kind", "part", "margin as low", "margin as high", "hits", "n")
    return cut_lineage(_pool(_pool(rows, [*keys, "kind", "part"]).drop("part"), [*keys, "kind"]), "isotonic-blocks")


def _interpolated(blocks, wanted, keys, part_points=PART_POINTS):
    """(keys, kind, margin, value): the curves at the wanted distinct margins, part by part with the knots around it."""
    from pyspark.sql import Window

    edges = _parts(wanted, keys, part_points)
    groups = [*keys, "kind"]
    knots = blocks.selectExpr(*groups, "explode(array(struct(low as x, hits / n as y), struct(high as x, hits / n as y))) as knot").distinct()
    knots = _placed(knots.selectExpr(*groups, "knot.x as x", "knot"), edges, keys, "x").drop("x")
    numbers = edges.selectExpr(*groups, "explode(sequence(0, size(edges))) as part")
    ends = numbers.join(knots.groupBy(*groups, "part").agg(F.min("knot").alias("first"), F.max("knot").alias("last")), [*groups, "part"], "left")
    order = Window.partitionBy(*groups).orderBy("part")  # a row per part of a curve
    around = ends.select(*groups, "part", F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
                         F.first("first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    knots = knots.unionByName(around.selectExpr(*groups, "part", "explode(array(before, after)) as knot").where("knot is not null"))
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in wanted.select(*groups).dtypes)

    def run(key, own, asked):
        own = own.assign(x=[k["x"] for k in own["knot"]], y=[k["y"] for k in own["knot"]]).sort_values(["x", "y"])
        out = pd.DataFrame({"margin": asked["margin"], "value": np.interp(asked["margin"], own["x"], own["y"]) if len(own) else np.nan})
        for i, name in enumerate(groups):
            out.insert(i, name, key[i])
        return out

    placed = _placed(wanted.select(*groups, "margin"), edges, keys, "margin")
    by = [*groups, "part"]
    return knots.groupBy(*by).cogroup(placed.groupBy(*by)).applyInPandas(run, f"{kinds}, margin double, value double")


def _normalised(rows, keep, values):
    total = " + ".join(values)
    return rows.selectExpr(*keep, *[f"case when {total} > 0 then {v} / ({total}) else 1D / 3 end as p_{k}" for v, k in zip(values, CLASS_KEYS)])


def apply_sigmoid(curves, rows, keys):
    keep = [c for c in rows.columns if not c.startswith("p_")]
    wide = curves.groupBy(*keys).pivot("kind", CLASS_KEYS).agg(F.first("slope").alias("slope"), F.first("offset").alias("offset"))  # a row per candidate
    joined = rows.join(F.broadcast(wide), list(keys)).selectExpr(*keep, *[f"1 / (1 + exp({k}_slope * m_{k} + {k}_offset)) as _{k}" for k in CLASS_KEYS])
    return _normalised(joined, keep, [f"_{k}" for k in CLASS_KEYS])


def apply_isotonic(blocks, rows, keys):
    keep = [c for c in rows.columns if not c.startswith("p_")]
    wanted = cut_lineage(_long(rows, keys, ("m_{k}",), ("margin",)).where("margin is not null").distinct(), "wanted-margins")
    values = cut_lineage(_interpolated(blocks, wanted, keys), "isotonic-values")
    out = rows.select(*keep)
    for k in CLASS_KEYS:
        own = values.where(F.col("kind") == k).select(*keys, F.col("margin").alias(f"m_{k}"), F.col("value").alias(f"_{k}"))
        out = out.join(own, [*keys, f"m_{k}"], "left")
    return _normalised(out, keep, [f"_{k}" for k in CLASS_KEYS])


def apply_temperature(curves, rows, keys):
    keep = [c for c in rows.columns if not c.startswith("p_")]
    top = f"greatest({', '.join(f'beta * {m}' for m in _M)})"
    joined = rows.join(F.broadcast(curves), list(keys)).selectExpr(*keep, *[f"exp(beta * {m} - {top}) as _{k}" for m, k in zip(_M, CLASS_KEYS)])  # a row per candidate
    return _normalised(joined, keep, [f"_{k}" for k in CLASS_KEYS])


def calibrate(held, rows, keys=("candidate",)):
    """{method: ``rows`` with calibrated p_verified, p_review, p_rejected}, each fitted on ``held``."""
    keys = list(keys)
    pts = cut_lineage(points(held, keys), "calibration-points")
    return {
        "sigmoid": apply_sigmoid(fit_sigmoid(pts, keys), rows, keys),
        "isotonic": apply_isotonic(fit_isotonic(pts, keys), rows, keys),
        "temperature": apply_temperature(fit_temperature(held, keys), rows, keys),
    }
