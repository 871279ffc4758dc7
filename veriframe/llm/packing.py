"""Best-fit packing by minimum bin slack over the histogram of lengths.

Only the counts per length, at most ``capacity`` rows, reach the driver. A bin is opened with the longest length left; a
bitset subset-sum over the lengths still available finds the fullest combination that fits beside it, and that combination
is removed as often as the counts allow. The result is a list of patterns (lengths, bins filled that way) whose size depends
on the number of distinct lengths, not of documents. Pieces are numbered within their length in parallel parts, and the
number decides pattern, bin and place.

Nulls: a null text is an empty document of one closing id. Repeated rows are packed as often as they occur. An empty table
gives no rows. Lengths must be in 1..capacity.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from veriframe.llm.tables import binary_column, slices, text_buffer
from veriframe.llm.word_bpe import encode
from veriframe.session import cut_lineage


def cut_pieces(encoded, capacity, closing_id, id_col="doc_id"):
    """One row per piece: ``piece`` (from 0), ``start`` and ``ids``; each document ends with ``closing_id``."""

    def run(batches):
        end = np.array([closing_id], "<u4").view(np.uint8)
        for batch in batches:
            raw, offsets = text_buffer(batch.column("ids"))
            for first, last in slices(np.diff(offsets), 16 << 20):
                part = batch.slice(first, last - first)
                own = offsets[first: last + 1] - offsets[first]
                data = np.insert(raw[offsets[first]: offsets[last]].reshape(-1, 4), own[1:] // 4, end, axis=0).reshape(-1)
                sizes = np.diff(own) // 4 + 1
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                bounds = np.concatenate([[0], np.cumsum(length)]) * 4
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), binary_column(data, bounds)],
                    [id_col, "piece", "start", "length", "ids"],
                )

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"{id_col} {kind}, piece int, start bigint, length bigint, ids binary")


def _fullest(counts, room):
    """The multiset of available lengths with the largest sum up to ``room``: {length: copies}."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:  # copies in powers of two reach every number of them
            take = min(copies, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left, copies = left - take, copies * 2
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not (before >> total) & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def bin_patterns(histogram, capacity):
    """Patterns [(bins, {length: copies per bin})] that use up ``histogram`` = {length: pieces}."""
    counts, patterns = {n: c for n, c in histogram.items() if c}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        pattern = _fullest({n: c for n, c in counts.items() if c}, capacity - longest)
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        bins = min(counts[n] // copies for n, copies in pattern.items())
        for n, copies in pattern.items():
            counts[n] -= bins * copies
            if not counts[n]:
                del counts[n]
        patterns.append((bins, pattern))
    return patterns


def _places(patterns):
    """Per length, arrays over the patterns that use it: first rank, first bin, copies per bin, offset in the bin."""
    places, used, first_bin = {}, {}, 0
    for bins, pattern in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            copies = pattern[length]
            places.setdefault(length, []).append((used.get(length, 0), first_bin, copies, offset))
            used[length] = used.get(length, 0) + bins * copies
            offset += length * copies
        first_bin += bins
    return {length: np.array(rows, np.int64) for length, rows in places.items()}


def pack_lengths(pieces, capacity, order, part_rows=100_000):
    """``pieces`` (with ``length``) plus ``sequence_id`` and ``offset``; ``order`` lists columns that number equal lengths."""
    spark = pieces.sparkSession
    pieces = cut_lineage(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    places = spark.sparkContext.broadcast(_places(bin_patterns(histogram, capacity)))
    parts = {n: -(-c // part_rows) for n, c in histogram.items() if c > part_rows}
    width = F.lit(1)
    if parts:  # common lengths are numbered in several parts
        width = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in parts.items() for v in pair]), F.col("length")), F.lit(1))
    rows = pieces.withColumn("_part", F.pmod(F.xxhash64(*order), width))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")).select("length", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_inside", F.row_number().over(Window.partitionBy("length", "_part").orderBy(*order)))
    rows = rows.join(before, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_inside") - 1)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for n in np.unique(lengths):
            mine, found = lengths == n, places.value[n]
            slot = np.searchsorted(found[:, 0], ranks[mine], side="right") - 1
            first, first_bin, copies, start = found[slot].T
            inside = ranks[mine] - first
            sequence[mine], offset[mine] = first_bin + inside // copies, start + inside % copies * n
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return rows.withColumn("_place", place("length", "_rank")).select(*pieces.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs, vocabulary, capacity=4096, closing_id=1, id_col="doc_id", text_col="text"):
    """Tokenise, cut and pack: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset."""
    encoded = encode(docs, vocabulary, id_col, text_col, rescan=False)
    pieces = cut_pieces(encoded, capacity, closing_id, id_col)
    pieces = pieces.select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack_lengths(pieces, capacity, [id_col, "piece", "ids_crc32"])
