"""Registry of named queries over the bound tables."""

from __future__ import annotations

from veriframe.bindings import BoundTables, with_bindings

QUERIES = {}
ORACLES = {}


def query(name, oracle=None):
    """Register ``fn(tables)``; ``oracle`` is SQL over the same bound tables."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(BoundTables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = with_bindings(oracle)
        return fn

    return add
