import numpy as np
import pytest
from pyspark.sql import functions as F

from veriframe.llm import hash_forest
from veriframe.llm.queries import QUERIES


def brute(rows, k):
    out = {}
    clean = sorted({(i, tuple(v)) for i, v in rows})
    ids = np.array([i for i, _ in clean])
    data = np.array([v for _, v in clean], float)
    for i, v in clean:
        if i % 20:
            continue
        scores = data @ np.array(v)
        order = np.lexsort((ids, -np.round(scores, 12)))
        seen = []
        for j in order:
            if ids[j] != i and ids[j] not in seen:
                seen.append(ids[j])
        out.setdefault(i, [int(j) for j in seen[:k]])
    return out


def collect(found):
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert len(got[r.query_id]) == r.rank
    return got


@pytest.mark.parametrize("block_rows", [50, 20_000])
def test_complete_when_all_are_candidates(spark, block_rows):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(8) * rng.uniform(0.1, 3)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [rows[5], (20, rows[20][1])]
    odd = [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] * 8), (2004, [1.0] * 3), (2005, [float("inf")] * 8), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").withColumn("entry", F.lit(1))
    got = collect(hash_forest.nearest(table, F.col("vec_id") % 20 == 0, k=20, candidates=10**9, block_rows=block_rows))
    assert got == brute(rows, 20)


def test_few_rows_and_empty_table(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.5, 0.5])], "vec_id bigint, embedding array<float>")
    assert collect(hash_forest.nearest(table, F.col("vec_id") % 20 == 0)) == {0: [1, 2]}
    assert hash_forest.nearest(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_query_recall(spark, con):
    data = con.execute("select vec_id, embedding from '/root/testdata/sf0.1/embeddings.parquet'").fetchall()
    want = brute(data, 20)
    got = collect(QUERIES["op5_hash_prefix_forest"](spark, "/root/testdata/sf0.1"))
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & set(want[q])) / len(want[q]) for q in want]) >= 0.9
