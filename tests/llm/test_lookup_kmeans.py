import hashlib
import math
import random

import pytest

from veriframe.llm import lookup_kmeans
from veriframe.llm.queries import ORACLES, QUERIES


def brute(rows, k, dims, scale, rounds, seed):
    kept = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(own) for x in zip(*own)] if own else c for own, c in zip(members, centroids)]
    labels = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {c: sum(d for _, own, d in labels if own == c) for c in range(len(centroids))}
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in labels), key=str)


def got(rows):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in rows), key=str)


@pytest.mark.parametrize("block_rows", [1, 7, 4096])
def test_against_brute_force(spark, block_rows):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    rows += [(300 + i, [0.25, -0.5, 1.0, 2.0]) for i in range(150)]  # a third are one vector
    rows += [(5, [9.0] * 4), (None, [1.0, 2.0, 3.0, 4.0]), (500, None), (501, []), (502, [1.0] * 5), (503, [1.0, None, 1.0, 1.0]), (504, [float("nan")] * 4), (505, [float("inf")] + [0.0] * 3)]
    rows += [(600, [1.5] * 4)] * 3
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as cluster", "2 as codes")
    result = lookup_kmeans.cluster_vectors(frame, k=9, dims=4, scale=8, rounds=4, seed=2, block_rows=block_rows)
    assert got(result.collect()) == brute(rows, 9, 4, 8, 4, 2)


def test_few_none_and_far(spark):
    frame = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [3.0, -1.0])], "vec_id string, embedding array<float>")
    assert got(lookup_kmeans.cluster_vectors(frame, k=5, dims=2).collect()) == brute([("x", [1, 2]), ("y", [3, -1])], 5, 2, 64, 3, 1)
    assert lookup_kmeans.cluster_vectors(frame.where("false"), k=5, dims=2).count() == 0
    far = spark.createDataFrame([(1, [1e30, 0.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [r.vec_id for r in lookup_kmeans.cluster_vectors(far, k=2, dims=2).collect()] == [2]


def test_query(spark, con):
    vectors = con.execute("select vec_id, embedding from embeddings").fetchall()
    rows = QUERIES["op12_lookup_kmeans"](spark, "/root/testdata/sf0.001")
    want = brute(vectors, 16, 64, 64, 3, 1)
    assert got(rows.collect()) == want
    cursor = con.execute(ORACLES["op12_lookup_kmeans"])
    names = [d[0] for d in cursor.description]
    order = [names.index(c) for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")]
    assert sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=str) == want
