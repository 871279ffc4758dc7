"""Integrity reports over the relational model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from veriframe.functions.scores import all_of
from veriframe.schemas import BOUNDS, FOREIGN_KEYS, UNIQUE_KEYS


def orphan_report(tables, keys=FOREIGN_KEYS):
    """Rows per foreign key whose parent is missing. ``tables`` gives DataFrames by name."""
    parts = []
    for child, column, parent, parent_column in keys:
        parents = getattr(tables, parent).select(F.col(parent_column).alias(column))
        rows = getattr(tables, child).where(F.col(column).isNotNull()).select(column)
        lost = rows.join(parents, column, "left_anti")
        parts.append(
            lost.agg(F.count(F.lit(1)).alias("orphans")).select(
                F.lit(child).alias("child"), F.lit(column).alias("column_name"), F.lit(parent).alias("parent"), "orphans"
            )
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


def duplicate_report(tables, keys=UNIQUE_KEYS):
    """Values per unique column that occur more than once, with their count."""
    parts = []
    for table, column in keys:
        rows = getattr(tables, table).where(F.col(column).isNotNull())
        counts = rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(counts.where("n > 1").select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "value", "n"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def domain_report(checks):
    """Rows violating a domain: ``checks`` = [(table name, column name, DataFrame, allowed values or condition)]."""
    parts = []
    for table, column, rows, allowed in checks:
        bad = ~F.col(column).isin(allowed) if isinstance(allowed, list) else ~allowed
        parts.append(
            rows.where(bad).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "value", "n")
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


def split_crossings(rows, split_column, feature_columns):
    """Feature vectors shared between splits, counted per pair of splits.

    Each vector is reduced to the set of splits it occurs in, so copies never pair up.
    """
    names = ["train", "validation", "test"]
    flags = [F.bool_or(F.col(split_column) == n).alias(n) for n in names]
    per_vector = rows.groupBy(*feature_columns).agg(*flags)
    pairs = [("train", "test"), ("train", "validation"), ("validation", "test")]
    return per_vector.agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}") for a, b in pairs])


def range_assertion(scores):
    """One row: does every score lie within its bounds."""
    checks = []
    for name, (low, high) in BOUNDS.items():
        value = F.col(name)
        fine = [value.isNotNull(), ~F.isnan(value), F.abs(value) != float("inf"), value >= low]
        if high is not None:
            fine.append(value <= high)
        checks.append(F.bool_and(F.coalesce(all_of(fine), F.lit(False))).alias(f"{name}_ok"))
    return scores.agg(*checks, F.count(F.lit(1)).alias("n"))
