"""Jaccard self-join on word shingles by PartEnum signatures, with connected components of the links.

Sets are put in size bands that are so wide that a similar set lies in the same or the next band; each set signs for both.
Within a band, similar sets differ in at most ``k`` elements. The feature domain is cut by hash into ``k // 2 + 1``
partitions, so some partition holds at most one difference, and that partition into three, of which two are then alike: every
pair of the three sub-partitions is one signature. Similar sets thus always share a signature, and no candidate is lost.

Rows with equal sets are one class, represented by the smallest id, and groups of equal members are one group. Groups are not
expanded into rows of pairs: the group's smallest member is verified against the others, and the links are merged into
components. Groups whose members are still in different components are cut into chunks; a block holds two chunks, finds the
links across components by matrix products, and only links leave it. Every link between different components of a group is
therefore tested exactly, with bounded memory.

Sets travel late: every set has a sketch, the parity of its elements' hashes in about four to eight bits per element. Two
sketches differ in at most as many bits as their sets differ in elements, so a pair whose sketches differ in more than
similar sets may is ruled out. Pairs with a group's smallest member and blocks meet as sketches first (a sixteenth of the sets
and less); whole sets are made again for those documents alone that a sketch leaves with a partner.

Nulls: a null text or one without words has an empty set and links with nothing. A row with a null id links with nothing and
has a null component. Rows with the same id are one document: they share its component. Ties do not occur (all links count).
An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from veriframe.llm.tables import binary_column, give_back, partitions, slices, text_buffer
from veriframe.session import cut_lineage

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x):
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    LIMIT = 200_000

    def __missing__(self, word):
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_sets(texts, width, memo):
    """Sorted distinct shingle hashes of all rows, laid end to end, with row bounds.

    Words are runs of bytes other than ASCII white space, lower-cased in A-Z only. Fewer words than ``width`` make one shingle.
    """
    sets = []
    for text in texts:
        words = text.encode().lower().split() if text else []
        hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        span = min(width, len(words))
        if not span:
            sets.append(hashes)
            continue
        shingles = np.full(len(words) - span + 1, span, np.uint64)
        for i in range(span):
            shingles = mix(shingles * MIX[0] + hashes[i: len(hashes) - span + 1 + i])
        sets.append(np.unique(shingles))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), bounds


def size_bands(percent, largest):
    """(upper sizes of the bands, differences allowed in each) up to the band that holds ``largest`` and the next."""
    upper, low = [], 1
    while len(upper) < 2 or upper[-2] < largest:
        upper.append(low * 100 // percent)
        low = upper[-1] + 1
    upper = np.array(upper, np.int64)
    return upper, 2 * upper * (100 - percent) // (100 + percent)


def signatures(flat, bounds, percent):
    """(signature, row) of all sets; bands that allow no difference need none, since equal sets are one class."""
    sizes = np.diff(bounds)
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    upper, differences = size_bands(percent, int(sizes.max()))
    found = []
    for ahead in (0, 1):
        band = np.searchsorted(upper, sizes) + ahead
        parts = np.where((sizes > 0) & (differences[band] > 0), differences[band] // 2 + 1, 0)
        rows = np.flatnonzero(parts)
        if not len(rows):
            continue
        base = np.cumsum(3 * parts) - 3 * parts
        row = np.repeat(np.arange(len(sizes)), sizes)
        used = parts[row] > 0
        row, value = row[used], mix(flat[used] ^ MIX[2])
        slot = base[row] + 3 * ((value >> np.uint64(32)) % parts[row].astype(np.uint64)).astype(np.int64) + ((value & np.uint64(0xFFFFFFFF)) % np.uint64(3)).astype(np.int64)
        sums = np.zeros(int(3 * parts.sum()), np.uint64)
        np.add.at(sums, slot, mix(value + MIX[0]))
        sums = sums.reshape(-1, 3)
        owner = np.repeat(rows, parts[rows])
        part = np.arange(len(owner)) - np.repeat((base // 3)[rows], parts[rows])
        place = mix(band[owner].astype(np.uint64) << np.uint64(34) | part.astype(np.uint64) << np.uint64(2))
        for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
            found.append((mix(mix(sums[:, a] + place + np.uint64(pair)) + sums[:, b]), owner))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # 48 bits name a signature; a chance agreement only adds a candidate
    return np.concatenate([s >> np.uint64(16) for s, _ in found]), np.concatenate([r for _, r in found])


def _set_keys(flat, bounds):
    """Two independent 64-bit sums per set; equal sets have equal keys."""
    keys = []
    for salt in MIX[:2]:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat + salt), dtype=np.uint64)])
        keys.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return keys


def parity_sketches(flat, bounds):
    """Each set's sketch (bytes, row offsets): bit b is the parity of the elements whose hash ends in b; 64 bits at least, a power of two."""
    sizes = np.diff(bounds)
    bits = np.where(sizes > 0, 1 << np.ceil(np.log2(4 * np.maximum(sizes, 16))).astype(np.int64), 0)
    base = np.concatenate([[0], np.cumsum(bits)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    slot = base[row] + (mix(flat + MIX[1]) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=int(base[-1])) & 1).astype(np.uint8), bitorder="little"), base // 8


def folded(words, width):
    """A sketch (or rows of sketches) of 64-bit words brought to a smaller width: the sketch that this width would have had."""
    return np.bitwise_xor.reduce(words.reshape(*words.shape[:-1], -1, width), axis=-2)


def sketches_allow(left, right, left_size, right_size, percent):
    """Whether sets may be similar, by their sketches; ``right`` may be rows of sketches."""
    width = min(left.shape[-1], right.shape[-1])
    apart = np.bitwise_count(folded(left, width) ^ folded(right, width)).sum(axis=-1, dtype=np.int64)
    fit = 100 * np.minimum(left_size, right_size) >= percent * np.maximum(left_size, right_size)
    return fit & ((100 + percent) * apart <= (100 - percent) * (left_size + right_size))


def _in_slices(batch, width, memo, text_index=1):
    for start, stop in slices(np.diff(text_buffer(batch.column(text_index))[1]), 2 << 20):
        part = batch.slice(start, stop - start)
        yield (part, *shingle_sets(part.column(text_index).to_pylist(), width, memo))
    give_back()


def set_classes(docs, width, id_col, text_col):
    """(id, n_shingles, _hi, _lo, _sketch) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        memo = _WordHashes()
        for batch in batches:
            for part, flat, bounds in _in_slices(batch, width, memo):
                hi, lo = _set_keys(flat, bounds)
                sketches = binary_column(*parity_sketches(flat, bounds))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), pa.array(hi), pa.array(lo), sketches], ["_id", "n_shingles", "_hi", "_lo", "_sketch"])

    return docs.select(id_col, text_col).mapInArrow(run, f"_id {id_type}, n_shingles bigint, _hi bigint, _lo bigint, _sketch binary")


def _signature_rows(docs, width, percent, id_col, text_col):
    """(_sig, _id): the signatures of the sets of each batch, once per distinct set."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        memo, seen = _WordHashes(), set()
        for batch in batches:
            for part, flat, bounds in _in_slices(batch, width, memo):
                sizes = np.diff(bounds)
                fresh = np.zeros(len(sizes), bool)
                for i, key in enumerate(zip(*(k.tolist() for k in _set_keys(flat, bounds)))):
                    if sizes[i] and key not in seen:
                        seen.add(key)
                        fresh[i] = True
                if len(seen) > 200_000:
                    seen.clear()
                kept = np.repeat(fresh, sizes)
                rows = np.flatnonzero(fresh)
                found, row = signatures(flat[kept], np.concatenate([[0], np.cumsum(sizes[rows])]), percent)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), part.column(0).take(pa.array(rows[row]))], ["_sig", "_id"])

    return docs.where(F.col(id_col).isNotNull()).select(id_col, text_col).mapInArrow(run, f"_sig bigint, _id {id_type}")


def _candidate_sets(docs, wanted, width, id_col, text_col):
    """(_id, _set): the sets of the wanted ids, as sorted 64-bit numbers in binary."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        memo = _WordHashes()
        for batch in batches:
            for part, flat, bounds in _in_slices(batch, width, memo):
                yield pa.RecordBatch.from_arrays([part.column(0), binary_column(flat.view(np.uint8), 8 * bounds)], ["_id", "_set"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(wanted, "_id", "left_semi")
    return rows.mapInArrow(run, f"_id {id_type}, _set binary")


def _similar(left, right, percent):
    both = len(np.intersect1d(left, right, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(left) + len(right) - both)


def _pairs_where(pairs, sets, columns, test):
    """The pairs (_a, _b) whose sets pass ``test(left, right, sizes)``."""
    id_type = pairs.schema["_a"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data = [text_buffer(batch.column(f"{columns[0]}_{side}")) for side in "ab"]
            sizes = list(zip(*(batch.column(f"_size_{s}").to_pylist() for s in "ab"))) if "_size" in columns else [None] * len(batch)
            kept = pa.array([test(*(d[o[i]: o[i + 1]].view(np.uint64) for d, o in data), sizes[i]) for i in range(len(batch))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(kept) for c in ("_a", "_b")], ["_a", "_b"])

    joined = pairs
    for side in "ab":
        joined = joined.join(sets.select(F.col("_id").alias(f"_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in columns]), f"_{side}")
    return joined.mapInArrow(run, f"_a {id_type}, _b {id_type}")


def _possible(pairs, sketches, percent):
    """The pairs (_a, _b) that their sketches do not rule out."""
    return _pairs_where(pairs, sketches, ["_sketch", "_size"], lambda a, b, sizes: bool(len(a) and len(b) and sketches_allow(a, b, *sizes, percent)))


def links_across(sets, comps, percent, columns=2048, rows=256):
    """Pairs (i, j), i < j, of similar sets in different components, by products of membership matrices.

    Only the counts of shared elements are held for all pairs of a block; they are tested ``rows`` rows at a time.
    """
    sizes = np.array([len(s) for s in sets])
    flat, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    element, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    used = shared[column]
    column, member = number[column[used]], member[used]
    order = np.argsort(column, kind="stable")
    column, member = column[order], member[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(column, [start, start + columns])
        held = np.zeros((len(sets), min(columns, int(shared.sum()) - start)), np.float32)
        held[member[a:b], column[a:b] - start] = 1
        both += held @ held.T
    left, right = [], []
    for first in range(0, len(sets), rows):
        shared_now = np.rint(both[first: first + rows]).astype(np.int64)
        similar = (100 * shared_now >= percent * (sizes[first: first + rows, None] + sizes[None] - shared_now)) & (shared_now > 0)
        i, j = np.nonzero(similar & (comps[first: first + rows, None] != comps[None]))
        i += first
        left.append(i[i < j])
        right.append(j[i < j])
    return np.concatenate(left), np.concatenate(right)


def partners_by_sketch(sketches, sizes, comps, percent, slab=1 << 18):
    """Which members of a block have one in another component that their sketches do not rule out.

    Members are ordered by size, so that one meets those of fitting size alone, and each pair once. Sketches folded to a quarter
    rule out most pairs, and whole ones are laid beside each other for the rest. ``slab`` pairs are held at a time.
    """
    widths, kept = np.array([len(k) for k in sketches]), np.zeros(len(sketches), bool)
    by_size = np.argsort(sizes, kind="stable")
    for narrow in np.unique(widths[widths > 0]):
        left = by_size[widths[by_size] == narrow]
        own, coarse = np.stack([sketches[i] for i in left]), max(1, int(narrow) // 4)
        own_coarse = np.ascontiguousarray(folded(own, coarse).T)
        for wide in np.unique(widths[widths >= narrow]):
            right = by_size[widths[by_size] == wide]
            rows = own if wide == narrow else folded(np.stack([sketches[j] for j in right]), narrow)
            rows_coarse = own_coarse if wide == narrow else np.ascontiguousarray(folded(rows, coarse).T)
            step = max(1, slab // len(right))
            for a in range(0, len(left), step):
                mine = left[a: a + step]
                p, q = np.searchsorted(100 * sizes[right], percent * sizes[mine[0]]), np.searchsorted(percent * sizes[right], 100 * sizes[mine[-1]], side="right")
                p = max(p, a) if wide == narrow else p
                others = right[p:q]
                apart = np.zeros((len(mine), len(others)), np.int32)
                for mine_word, other_word in zip(own_coarse[:, a: a + step], rows_coarse[:, p:q]):
                    apart += np.bitwise_count(mine_word[:, None] ^ other_word)
                near = (100 + percent) * apart <= (100 - percent) * (sizes[mine][:, None] + sizes[others])
                i, j = np.nonzero(near & (comps[mine][:, None] != comps[others]))
                for first in range(0, len(i), max(1, slab // int(narrow))):
                    x, y = (c[first: first + max(1, slab // int(narrow))] for c in (i, j))
                    new = ~(kept[mine[x]] & kept[others[y]])
                    if not new.any():
                        continue
                    x, y = x[new], y[new]
                    found = sketches_allow(own[a + x], rows[p + y], sizes[mine[x]], sizes[others[y]], percent)
                    kept[mine[x[found]]] = True
                    kept[others[y[found]]] = True
    return kept


def _blocks_of(table):
    """Row numbers of each block of a bucket, and component numbers of all rows."""
    blocks = table.column("_block").to_numpy()
    order = np.argsort(blocks, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(blocks[order]) != 0]))
    comps = np.unique(np.array(table.column("_comp").to_pylist(), object).astype(str), return_inverse=True)[1]
    return np.split(order, starts[1:]), comps


def _in_buckets(rows, size, bucket_bytes=8 << 20):
    """``rows`` grouped by buckets of whole blocks, as many as the bytes of column ``size`` ask for."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    buckets = max(partitions(rows.sparkSession), total // bucket_bytes)
    return rows.withColumn("_bucket", F.pmod("_block", F.lit(buckets))).groupBy("_bucket")


def _open_blocks(members, sketches, percent, block_members):
    """(_block, _id, _comp): members (_group, _id, _comp, _n) of one group that may have a link into another component.

    A group is cut into chunks of about ``block_members``; every pair of chunks is one block.
    """
    id_type = members.schema["_id"].dataType.simpleString()
    chunks = F.ceil(F.col("_n") / block_members).cast("int")
    rows = members.withColumn("_chunk", F.pmod(F.xxhash64("_id"), chunks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    block = F.struct("_group", F.least("_chunk", "_other").alias("i"), F.greatest("_chunk", "_other").alias("j"))
    rows = cut_lineage(rows.select(F.xxhash64(block).alias("_block"), "_id", "_comp").join(sketches, "_id"), "block-sketches")

    def run(table):
        data, offsets = text_buffer(table.column("_sketch"))
        sizes, kept = table.column("_size").to_numpy(), []
        groups, comps = _blocks_of(table)
        for own in groups:
            near = partners_by_sketch([data[offsets[r]: offsets[r + 1]].view(np.uint64) for r in own], sizes[own], comps[own], percent)
            kept.append(own[near])
        return give_back(table.select(["_block", "_id", "_comp"]).take(pa.array(np.concatenate(kept).astype(np.int64))))

    return _in_buckets(rows, F.octet_length("_sketch")).applyInArrow(run, f"_block bigint, _id {id_type}, _comp {id_type}").distinct()


def _links_in_blocks(blocks, sets, percent):
    """Links (_a, _b) between members (_block, _id, _comp) of one block in different components; only links leave a block."""
    id_type = blocks.schema["_id"].dataType.simpleString()

    def run(table):
        data, offsets = text_buffer(table.column("_set"))
        left, right = [], []
        groups, comps = _blocks_of(table)
        for own in groups:
            i, j = links_across([data[offsets[r]: offsets[r + 1]].view(np.uint64) for r in own], comps[own], percent)
            left.append(own[i])
            right.append(own[j])
        ids = table.column("_id").combine_chunks()
        return give_back(pa.table([ids.take(pa.array(np.concatenate(side).astype(np.int64))) for side in (left, right)], ["_a", "_b"]))

    rows = blocks.join(sets, "_id")
    return _in_buckets(rows, F.octet_length("_set")).applyInArrow(run, f"_a {id_type}, _b {id_type}").distinct()


def components(links, name="components"):
    """(_id, _comp): the smallest id reachable from each id that has a link."""
    edges = cut_lineage(links.select("_a", "_b").union(links.select("_b", "_a")).toDF("_a", "_b").where("_a <> _b").distinct(), f"{name}-edges")
    labels = edges.select(F.col("_a").alias("_id"), F.col("_a").alias("_comp")).distinct()
    while not edges.isEmpty():
        parents = edges.groupBy("_a").agg(F.min("_b").alias("_b")).select("_a", F.least("_a", "_b").alias("_p"))
        parents = cut_lineage(parents, f"{name}-parents")
        for _ in range(2):  # shorten chains of parents
            step = parents.select(F.col("_a").alias("_p"), F.col("_p").alias("_pp"))
            parents = parents.join(step, "_p", "left").select("_a", F.coalesce("_pp", "_p").alias("_p"))
        parents = cut_lineage(parents, f"{name}-jumped")
        labels = labels.join(parents.withColumnRenamed("_a", "_comp"), "_comp", "left").select("_id", F.coalesce("_p", "_comp").alias("_comp"))
        labels = cut_lineage(labels, f"{name}-labels")
        moved = edges.join(parents, "_a").select(F.col("_p").alias("_a"), "_b").join(parents.select(F.col("_a").alias("_b"), F.col("_p").alias("_q")), "_b")
        edges = cut_lineage(moved.select("_a", F.col("_q").alias("_b")).where("_a <> _b").distinct(), f"{name}-edges")
    return labels


def _links(groups, sketches, make_sets, percent, block_members=1000):
    """Components (_id, _comp) of the members of signature groups (_sig, _id): every link is found or already implied.

    ``sketches``: _id, _sketch, _size. ``make_sets`` gives the sets of a table of ids.
    """
    # groups of the same members are one group
    alike = groups.groupBy("_sig").agg(F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("_id")).alias("_x"), F.bit_xor(F.xxhash64("_id", F.lit(1))).alias("_y"), F.min("_id").alias("_pivot"))
    alike = alike.where("_n > 1").groupBy("_n", "_x", "_y", "_pivot").agg(F.min("_sig").alias("_sig")).select("_sig", "_n", "_pivot")
    groups = cut_lineage(groups.join(alike, "_sig"), "group-members")
    stars = groups.where("_id <> _pivot").select(F.col("_pivot").alias("_a"), F.col("_id").alias("_b")).distinct()
    possible = cut_lineage(_possible(stars, sketches, percent), "possible-pairs")
    both = possible.select(F.col("_a").alias("_id")).union(possible.select(F.col("_b").alias("_id"))).distinct()
    sets = make_sets(both)
    found = cut_lineage(_pairs_where(possible, sets, ["_set"], lambda a, b, sizes: _similar(a, b, percent)), "star-links")
    comps = components(found)
    # pairs with the pivot are settled; groups around one pivot mostly share their members and are compared as one
    others = groups.where("_id <> _pivot").join(comps, "_id", "left").select("_sig", F.col("_pivot").alias("_group"), "_id", F.coalesce("_comp", "_id").alias("_comp"))
    unsettled = others.groupBy("_sig").agg(F.min("_comp").alias("_low"), F.max("_comp").alias("_high")).where("_low <> _high").select("_sig")
    rest = cut_lineage(others.join(unsettled, "_sig").select("_group", "_id", "_comp").distinct(), "open-members")
    rest = rest.join(rest.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")), "_group")
    blocks = cut_lineage(_open_blocks(rest, sketches, percent, block_members), "open-blocks")
    if blocks.isEmpty():
        return comps
    more = cut_lineage(_links_in_blocks(blocks, make_sets(blocks.select("_id").distinct()), percent), "block-links")
    return components(found.unionByName(more))


def near_duplicates(docs, width=5, percent=80, id_col="doc_id", text_col="text"):
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links, its own included)."""
    classes = cut_lineage(set_classes(docs, width, id_col, text_col), "set-classes")
    keys = ["n_shingles", "_hi", "_lo"]
    filled = classes.where("n_shingles > 0 and _id is not null")
    reps = filled.groupBy(*keys).agg(F.min("_id").alias("_rep"))
    rep_of = cut_lineage(filled.join(reps, keys).select("_id", "_rep").distinct(), "set-representatives")
    signed = _signature_rows(docs, width, percent, id_col, text_col)
    same = Window.partitionBy("_sig")
    shared = signed.withColumn("_low", F.min("_id").over(same)).withColumn("_high", F.max("_id").over(same)).where("_low <> _high").select("_sig", "_id")
    # equal sets count once
    groups = cut_lineage(shared.join(rep_of, "_id").select("_sig", F.col("_rep").alias("_id")).distinct(), "signature-groups")
    sketches = filled.select("_id", "_sketch", F.col("n_shingles").alias("_size"), "_hi", "_lo").join(groups.select("_id").distinct(), "_id", "left_semi")
    sketches = cut_lineage(sketches.dropDuplicates(["_id", "_hi", "_lo"]).select("_id", "_sketch", "_size"), "group-sketches")
    comps = _links(groups, sketches, lambda wanted: cut_lineage(_candidate_sets(docs, wanted, width, id_col, text_col), "candidate-sets"), percent)
    # rows with one id but several sets join their classes
    merged = rep_of.select(F.col("_id").alias("_a"), F.col("_rep").alias("_b"))
    repeated_ids = rep_of.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if not repeated_ids.isEmpty():
        extra = merged.join(repeated_ids.select(F.col("_id").alias("_a")), "_a", "left_semi")
        comps = components(extra.unionByName(comps.select(F.col("_id").alias("_a"), F.col("_comp").alias("_b"))))
    best = rep_of.join(comps.withColumnRenamed("_id", "_rep"), "_rep", "left").withColumn("_rep", F.coalesce("_comp", "_rep"))
    best = best.groupBy("_id").agg(F.min("_rep").alias("_rep"))
    return classes.join(best, "_id", "left").select(F.col("_id").alias(id_col), "n_shingles", F.coalesce("_rep", "_id").alias("component_id"))
