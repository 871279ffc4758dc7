"""Approximate nearest neighbours by a forest of hash-prefix trees (largest inner product).

A tree is the sorted array of long hash strings of all vectors: signs against ``bits`` orthogonal random directions, after
the usual lift that turns largest inner products into smallest angles. A query descends every tree to the longest prefix
that matches and then ascends all trees in step, one bit at a time, until the prefixes hold ``candidates`` entries in all; a
histogram of prefixes up to ``depth`` bits (of bounded size) tells every query its level beforehand. At level 0 the prefix is
empty and every vector is a candidate, so no query is left with too few.

Arrays are cut into cells of equal prefix, and cells into blocks of bounded size; queries meet the blocks of the cells under
their prefix, and a block keeps each query's best. Equal vectors are one entry: only the ``k + 1`` smallest ids of a class
can be among anyone's nearest, so a very common vector is compared once.

Nulls: vectors that are null, zero, or hold null or non-finite components, and those whose length is not the most common one,
take no part, nor do null ids. Rows equal in id and vector count once; an id never finds itself. Ties go to the smaller id.
Fewer candidates than ``k`` give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from veriframe.llm.tables import pack, row_key, unpack
from veriframe.session import cut_lineage


def vector_classes(table, is_query, id_col, vector_col, k):
    """(members, classes): (_id, _class, is_query) and (_class, vector, asked, ids: the k + 1 smallest)."""
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = table.select(F.col(id_col).cast("bigint").alias("_id"), vector.alias("_vector"), is_query.alias("_asks")).where("_id is not null and _vector is not null")
    finite = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_vector", lambda x: x != 0)
    rows = rows.where(finite).withColumn("_size", F.size("_vector"))
    common = rows.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_size").first()
    if common is None:
        return None, None, 0
    plain = F.transform("_vector", lambda x: F.when(x == 0, 0.0).otherwise(x))  # -0.0 equals 0.0
    rows = rows.where(F.col("_size") == common["_size"]).select("_id", "_asks", plain.alias("_vector"), row_key(F.to_json(F.struct(plain))).alias("_class"))
    rows = cut_lineage(rows.dropDuplicates(["_id", "_class"]), "vectors")
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_class").orderBy("_id"))).where(F.col("_n") <= k + 1)
    classes = first.groupBy("_class").agg(F.min_by("_vector", "_id").alias("vector"), F.sort_array(F.collect_list("_id")).alias("ids"))
    asked = rows.where("_asks").select("_class").distinct().withColumn("asked", F.lit(True))
    classes = classes.join(asked, "_class", "left").select("_class", "vector", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))
    return rows.where("_asks").select("_id", "_class"), cut_lineage(classes.withColumn("entry", F.monotonically_increasing_id()), "vector-classes"), common["_size"]


def directions(dimensions, trees, bits, seed):
    """Per tree, ``bits`` random directions, orthogonal in groups of ``dimensions``."""
    rng = np.random.default_rng(seed)
    made = []
    for _ in range(trees):
        groups = [np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0] for _ in range(-(-bits // dimensions))]
        made.append(np.concatenate(groups, axis=1)[:, :bits])
    return np.stack(made)


def _codes(vectors, lift, planes):
    """(trees, rows) hash strings as numbers, first bit highest."""
    lifted = np.column_stack([vectors, lift])
    bits = planes.shape[2]
    weights = np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64)
    return np.stack([((lifted @ plane) >= 0) @ weights for plane in planes])


def _vectors(column):
    return np.array(column.values.to_numpy(zero_copy_only=False), np.float64)[column.offsets[0].as_py():].reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _lift(vectors, largest):
    return np.sqrt(np.maximum(largest - (vectors**2).sum(axis=1), 0))


def _histogram(classes, planes, largest, depth):
    """Counts per (tree, prefix of ``depth`` bits): an array of bounded size."""
    trees, _, bits = planes.value.shape

    def count(batches):
        total = np.zeros((trees, 1 << depth), np.int64)
        for batch in batches:
            vectors = _vectors(batch.column(0))
            for tree, codes in enumerate(_codes(vectors, _lift(vectors, largest), planes.value)):
                total[tree] += np.bincount(codes >> (bits - depth), minlength=1 << depth)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel()[place])], ["place", "n"])

    rows = classes.select("vector").mapInArrow(count, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(trees << depth, np.int64)
    total[[r["place"] for r in rows]] = [r["n"] for r in rows]
    return total.reshape(trees, -1)


def _levels(codes, levels, bits, candidates):
    """Per query, the deepest level at which all trees together hold enough entries."""
    chosen = np.zeros(codes.shape[1], np.int64)
    for level in range(1, len(levels)):
        held = sum(levels[level][tree][codes[tree] >> (bits - level)] for tree in range(len(codes)))
        chosen[held >= candidates] = level
    return chosen


def _deal(batches, planes, largest, levels, candidates, cell_bits, shards):
    """(tree, cell, shard, query, payload): entries to one block of their cell, queries to every block under their prefix."""
    trees, _, bits = planes.value.shape
    held = levels.value

    def row(kind, tree, cell, shard, *arrays):
        return tree, cell, shard, kind, pack(arrays)

    for batch in batches:
        entry, asked = batch.column("entry").to_numpy(), np.array(batch.column("asked").to_pylist(), bool)
        vectors = _vectors(batch.column("vector"))
        codes = _codes(vectors, _lift(vectors, largest), planes.value)
        wanted = np.flatnonzero(asked)
        own = _codes(vectors[wanted], np.zeros(len(wanted)), planes.value)
        level = _levels(own, held, bits, candidates)
        rows = []
        for tree in range(trees):
            cells = codes[tree] >> (bits - cell_bits)
            shard = entry % shards.value[tree][cells]
            for cell, s in np.unique(np.column_stack([cells, shard]), axis=0):
                mine = np.flatnonzero((cells == cell) & (shard == s))
                rows.append(row(False, tree, cell, s, entry[mine], codes[tree][mine], vectors[mine]))
            if not len(wanted):
                continue
            low = (own[tree] >> (bits - level)) << np.maximum(cell_bits - level, 0)
            low = np.where(level > cell_bits, own[tree] >> (bits - cell_bits), low)
            span = np.int64(1) << np.maximum(cell_bits - level, 0)
            query = np.repeat(np.arange(len(wanted)), span)
            cell_of = np.repeat(low, span) + np.arange(len(query)) - np.repeat(np.cumsum(span) - span, span)
            for cell in np.unique(cell_of):
                mine = query[cell_of == cell]
                for s in range(shards.value[tree][cell]):
                    rows.append(row(True, tree, cell, s, entry[wanted[mine]], own[tree][mine], vectors[wanted[mine]], level[mine]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["tree", "cell", "shard", "query", "payload"])


def _search(rows, bits, k):
    """Each query's best entries of one block, within the range of its prefix in the block's sorted array."""
    parts = {False: [], True: []}
    for query, payload in zip(rows.column("query").to_pylist(), rows.column("payload").to_pylist()):
        parts[query].append(unpack(payload))
    found = []
    if parts[False] and parts[True]:
        entry, codes, vectors = (np.concatenate(c) for c in zip(*parts[False]))
        order = np.argsort(codes, kind="stable")
        entry, codes, vectors = entry[order], codes[order], vectors[order]
        for asking, own, asked, level in parts[True]:
            prefix = (own >> (bits - level)) << (bits - level)
            groups = np.unique(np.column_stack([level, prefix]), axis=0)
            for at, low in groups:
                mine = np.flatnonzero((level == at) & (prefix == low))
                a, b = np.searchsorted(codes, [low, low + (np.int64(1) << (bits - at))])
                for start in range(0, len(mine) if b > a else 0, 256):
                    some = mine[start: start + 256]
                    scores = asked[some] @ vectors[a:b].T
                    keep = min(k, b - a)
                    best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                    # equal scores at the border all stay, so that ties are decided by id at the end
                    edge = np.take_along_axis(scores, best, axis=1).min(axis=1)
                    query, place = np.nonzero(scores >= edge[:, None] - 1e-12)
                    found.append((asking[some[query]], entry[a + place], scores[query, place]))
    if not found:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["asking", "entry", "score"])
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], ["asking", "entry", "score"])


def nearest(table, is_query, k=20, trees=16, bits=32, depth=12, candidates=None, share=1.0, block_rows=20_000, seed=7, id_col="vec_id", vector_col="embedding"):
    """query_id, rank (from 1), vec_id and score of each query's ``k`` nearest found.

    ``candidates`` entries, repeats in several trees counted, end a query's ascent; by default ``share`` times the number of
    distinct vectors, which finds over nine tenths of the true neighbours even among evenly spread directions.
    """
    spark = table.sparkSession
    members, classes, dimensions = vector_classes(table, is_query, id_col, vector_col, k)
    if members is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    total, largest = classes.agg(F.count(F.lit(1)), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()
    wanted = candidates or max(50 * k, int(share * total))
    planes = spark.sparkContext.broadcast(directions(dimensions + 1, trees, bits, seed))
    counts = _histogram(classes, planes, largest, depth)
    levels = [counts.reshape(trees, 1 << level, -1).sum(axis=2) for level in range(depth + 1)]
    cell_bits = min(depth, max(0, int(total // block_rows).bit_length() + 1))
    shards = spark.sparkContext.broadcast(np.maximum(1, -(-levels[cell_bits] // block_rows)))
    shared = spark.sparkContext.broadcast(levels)
    dealt = classes.select("entry", "asked", "vector").mapInArrow(
        lambda batches: _deal(batches, planes, largest, shared, wanted, cell_bits, shards), "tree bigint, cell bigint, shard bigint, query boolean, payload binary"
    )
    found = dealt.groupBy("tree", "cell", "shard").applyInArrow(lambda rows: _search(rows, bits, k + 1), "asking bigint, entry bigint, score double")
    found = found.groupBy("asking", "entry").agg(F.max("score").alias("score"))
    ids = classes.select("entry", "ids")
    smallest = found.join(ids, "entry").withColumn("_first", F.element_at("ids", 1))
    best = Window.partitionBy("asking").orderBy(F.desc("score"), "_first")
    kept = smallest.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    asking = members.join(classes.select("_class", F.col("entry").alias("asking")), "_class").select(F.col("_id").alias("query_id"), "asking")
    pairs = asking.join(kept, "asking").select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
    nearest_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
