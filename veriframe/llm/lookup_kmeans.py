"""Centroid clustering of integer vectors with scalar lookup tables.

Vectors become integers ``floor(scale * x)``. They are written once as blocks; a block holds, for every dimension, the integer
values that occur in it and each vector's number among them. In a round a task tabulates the squared difference of every
occurring value to every centroid, by dimension; a vector's distances are sums of gathers from these tables. Only counts and
sums by cluster and dimension leave a task (at most ``k * (dims + 1)`` numbers a round after they are combined), all integers,
so results do not depend on how rows are dealt.

Initial centroids are the ``k`` vectors with the smallest SHA-256 of ``<seed>:<id>``; equal hashes (repeated ids) go by the
vector, a null id comes last. Ties of distance go to the smaller number; an empty cluster keeps its centroid.

Vectors that are null, of another length, or hold null or non-finite components take no part, nor do those with a component
beyond 2^27 after scaling, whose squared distances would not fit 64 bits. Fewer vectors than ``k`` give fewer centroids; an empty
table gives no rows. Repeated rows count each time. Only the id and the vector column are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veriframe.session import cut_lineage

REACH = 1 << 27


def integer_vectors(vectors, id_col="vec_id", vector_col="embedding", dims=64, scale=64):
    """(id, v): the vectors that take part, as integers."""
    scaled = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    whole = F.coalesce(F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < REACH)), F.lit(False))
    return vectors.where((F.size(vector_col) == dims) & whole).select(F.col(id_col).alias("id"), scaled.alias("v"))


def _encoded(batches, dims, rows):
    """Blocks of vectors: ids, each dimension's occurring values laid end to end with their number, and the vectors' codes."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            part = batch.slice(start, rows)
            vectors = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            values, codes = zip(*(np.unique(vectors[:, d], return_inverse=True) for d in range(dims)))
            codes = np.stack(codes).astype(np.uint8 if max(map(len, values)) <= 256 else np.uint16)
            ids = part.column("id")
            offsets = pa.array([0, len(ids)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(offsets, ids), pa.array([[len(v) for v in values]], pa.list_(pa.int32())),
                 pa.array([np.concatenate(values)], pa.list_(pa.int64())), pa.array([codes.tobytes()], pa.binary())], ["ids", "sizes", "values", "codes"])


def _assigned(row, centroids):
    """Cluster and squared distance of each vector of a block, and its codes and values by dimension."""
    sizes, values, raw = row["sizes"], np.array(row["values"], np.int64), row["codes"]
    dims, n = len(sizes), len(row["ids"])
    codes = np.frombuffer(raw, np.uint8 if len(raw) == dims * n else np.uint16).reshape(dims, n)
    values = np.split(values, np.cumsum(sizes)[:-1])
    distances = np.zeros((n, len(centroids)), np.int64)
    for d in range(dims):
        table = (values[d][:, None] - centroids[None, :, d]) ** 2
        distances += table[codes[d]]
    cluster = distances.argmin(axis=1)
    return cluster, distances[np.arange(n), cluster], codes, values


def _sums(batches, centroids):
    """(cluster, dim, total) of a task; dimension -1 holds the number of vectors."""
    k, dims = centroids.shape
    counts, totals = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            cluster, _, codes, values = _assigned(row, centroids)
            counts += np.bincount(cluster, minlength=k)
            for d in range(dims):
                # occurrences of each (cluster, value), times the value
                width = len(values[d])
                held = np.bincount(cluster * width + codes[d], minlength=k * width).reshape(k, width)
                totals[:, d] += held @ values[d]
    full = np.concatenate([counts[:, None], totals], axis=1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.arange(k), dims + 1)), pa.array(np.tile(np.arange(-1, dims), k)), pa.array(full.ravel())], ["cluster", "dim", "total"])


def _labels(batches, centroids):
    for batch in batches:
        for row, ids in zip(batch.to_pylist(), batch.column("ids")):
            cluster, distance, _, _ = _assigned(row, centroids)
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])


def _sha256(centroid):
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_vectors(vectors, id_col="vec_id", vector_col="embedding", k=16, dims=64, scale=64, rounds=3, seed=1, block_rows=4096):
    """One row per vector that takes part: ``id_col``, cluster, distance, cluster_inertia, inertia, centroid (array), centroid_sha256."""
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, id_col, vector_col, dims, scale)
    id_type = kept.schema["id"].dataType.simpleString()
    blocks = cut_lineage(kept.mapInArrow(
        lambda batches: _encoded(batches, dims, block_rows), f"ids array<{id_type}>, sizes array<int>, values array<bigint>, codes binary"
    ), "vector-blocks")
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    chosen = kept.orderBy(first.asc_nulls_last(), "v").limit(k).collect()  # k vectors
    centroids = np.array([r["v"] for r in chosen], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        fixed = centroids
        sums = blocks.mapInArrow(lambda batches: _sums(batches, fixed), "cluster bigint, dim bigint, total bigint").groupBy("cluster", "dim").agg(F.sum("total").alias("total"))
        totals = np.zeros((len(centroids), dims + 1), np.int64)
        for r in sums.collect():  # k * (dims + 1) numbers
            totals[r["cluster"], r["dim"] + 1] = r["total"]
        held = totals[:, :1]
        centroids = np.where(held > 0, totals[:, 1:] // np.maximum(held, 1), centroids)
    final = centroids
    labelled = blocks.mapInArrow(lambda batches: _labels(batches, final), f"id {id_type}, cluster int, distance bigint")
    labelled = cut_lineage(labelled, "vector-clusters")
    inertia = {r["cluster"]: r["inertia"] for r in labelled.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows
    table = spark.createDataFrame(
        [(c, inertia.get(c, 0), sum(inertia.values()), final[c].tolist(), _sha256(final[c].tolist())) for c in range(len(final))],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>, centroid_sha256 string",
    )
    return labelled.join(F.broadcast(table), "cluster").select(  # k rows
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"
    )
