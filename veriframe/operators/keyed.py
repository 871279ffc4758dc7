"""Skew-safe building blocks: latest row, two-level running values, distributed ranks, exact quantiles.

None of them gathers one key's rows in one task: groups are cut into buckets first, and only the
per-bucket totals (bounded by the number of buckets) are put in order per key.
"""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from veriframe.session import cut_lineage

MOST_BROADCAST_KEYS = 10_000  # edges of so many keys are sent to every task


def latest_by(df, keys, order):
    """One row per key with the greatest ``order`` columns; combined map-side, so hot keys are cheap."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return packed.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in df.columns if c not in keys])


def running(df, keys, order, bucket, value, kind, out, include_current=True):
    """Running ``sum`` or ``max`` of ``value`` per key in ``order``, cut by ``bucket``.

    ``bucket`` must never decrease along ``order``. Rows are ordered only within (key, bucket);
    what came before each bucket is taken from the bucket totals.
    """
    combine = {"sum": F.sum, "max": F.max}[kind]
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    totals = rows.groupBy(*keys, "_bucket").agg(combine("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_before", combine("_total").over(earlier)).drop("_total")
    last = 0 if include_current else -1
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    rows = rows.withColumn("_inside", combine("_value").over(inside))
    joined = rows.join(offsets, [*keys, "_bucket"], "left")
    if kind == "sum":
        result = F.coalesce("_before", F.lit(0)) + F.coalesce("_inside", F.lit(0))
    else:
        result = F.greatest("_before", "_inside")
    return joined.withColumn(out, result).drop("_bucket", "_value", "_before", "_inside")


def hash_rank(df, keys, digest, tie, out, part_rows=50_000):
    """1-based rank by a hex digest per key (or overall), equal to one global ``row_number``.

    Digest prefixes, as long as the row count asks for, cut every group into even parts; only part sizes are accumulated.
    """
    buckets = max(1, math.ceil(math.log(max(df.count() / part_rows, 1), 16)))
    rows = df.withColumn("_digest", digest).withColumn("_part", F.substring("_digest", 1, buckets))
    rows = rows.withColumn("_digest", F.unhex("_digest"))  # the same order in half the bytes
    sizes = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    # at most 16**buckets rows per key: one per ``part_rows`` rows
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_part").orderBy("_digest", tie)
    ranked = rows.withColumn("_inner", F.row_number().over(inside))
    joined = ranked.join(offsets, [*keys, "_part"])
    return joined.withColumn(out, F.col("_before") + F.col("_inner")).drop(
        "_digest", "_part", "_before", "_inner"
    )


def exact_quantiles(df, keys, value, probabilities, cuts=64, weight=None):
    """Exact linearly interpolated quantiles per key: rows (keys, probability, quantile).

    Equal values are merged first. Approximate cut points split each group into value ranges, range
    sizes are accumulated, and only ranges that hold a wanted rank are put in order. ``weight`` names
    a column with the number of copies a row stands for.
    """
    keys = list(keys)
    copies = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    data = df.select(*keys, F.col(value).cast("double").alias("_v"), copies.alias("_c")).where(F.col("_v").isNotNull())
    weights = data.groupBy(*keys, "_v").agg(F.sum("_c").alias("_w"))
    grid = [i / cuts for i in range(1, cuts)]
    edges = cut_lineage(data.groupBy(*keys).agg(F.percentile_approx("_v", grid, 10000).alias("_edges"), F.sum("_c").alias("_n")), "quantile-edges")
    few = not keys or edges.count() <= MOST_BROADCAST_KEYS
    # one row per (key, probability): the two ranks to interpolate between
    wanted = edges.select(*keys, "_n", F.explode(F.array(*[F.lit(p) for p in probabilities])).alias("probability"))
    position = F.col("probability") * (F.col("_n") - 1)
    wanted = wanted.withColumn("_low", F.floor(position)).withColumn("_fraction", position - F.floor(position))

    def attach(left, right):
        return left.join(F.broadcast(right) if few else right, keys) if keys else left.crossJoin(F.broadcast(right))

    ranged = attach(weights, edges.select(*keys, "_edges"))
    ranged = cut_lineage(ranged.select(*keys, "_v", "_w", F.size(F.filter("_edges", lambda e: e < F.col("_v"))).alias("_range")), "quantile-ranges")
    sizes = ranged.groupBy(*keys, "_range").agg(F.sum("_w").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    hit = attach(starts, wanted).where(
        (F.col("_low") < F.col("_start") + F.col("_size")) & (F.col("_low") + 1 >= F.col("_start"))
    )
    needed = hit.select(*keys, "_range", "_start").distinct()
    inside = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(needed, [*keys, "_range"]).withColumn("_end", F.col("_start") + F.sum("_w").over(inside))
    placed = placed.select(*keys, "_v", (F.col("_end") - F.col("_w")).alias("_from"), "_end")
    covers = lambda rank: (rank >= F.col("_from")) & (rank < F.col("_end"))
    found = (
        attach(placed, wanted)
        .where(covers(F.col("_low")) | covers(F.col("_low") + 1))
        .groupBy(*keys, "probability")
        .agg(
            F.max(F.when(covers(F.col("_low")), F.col("_v"))).alias("_a"),
            F.max(F.when(covers(F.col("_low") + 1), F.col("_v"))).alias("_b"),
            F.first("_fraction").alias("_fraction"),
        )
    )
    quantile = F.when(F.col("_fraction") == 0, F.col("_a")).otherwise(
        F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_fraction")
    )
    return found.select(*keys, "probability", quantile.alias("quantile"))


def quantile_columns(df, keys, value, named, weight=None):
    """Exact quantiles pivoted to columns, ``named`` = {column: probability}."""
    long = exact_quantiles(df, keys, value, sorted(set(named.values())), weight=weight)
    wide = [
        F.max(F.when(F.abs(F.col("probability") - p) < 1e-9, F.col("quantile"))).alias(name)
        for name, p in named.items()
    ]
    return long.groupBy(*keys).agg(*wide)
