"""Every registered query runs, and matches its checking SQL, on the smallest data."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from veriframe.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    mine = QUERIES[name](spark, FOLDER).toPandas()
    assert compare(mine, con.execute(ORACLES[name]).df()) is None


# the margin model runs in test_margin_grid.py
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"m8_margin_model"}))
def test_rows_only(spark, name):
    assert len(QUERIES[name](spark, FOLDER).toPandas()) > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["latest_status"] for r in rows} == {"pending", "verified", "review", "rejected"}
    assert all(r["requests"] == r["verified"] + r["review"] + r["rejected"] for r in rows)
