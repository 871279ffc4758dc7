"""Suffix-array dedup: removes bytes covered by a string of ``size`` bytes that also starts in a document with a smaller id.

Anchors. Of the grams in a string of ``size`` bytes the one with the least hash is its anchor, so equal strings have equal
anchors at equal places. An anchor's context, the bytes of all strings that could have it, is at most 84 bytes for strings of
50. Blocks of documents send each distinct (anchor, context) once to the anchor's bucket. A context met in a smaller document
is removed as a whole; an anchor met with one context only is settled by that.

Run-length index. Where an anchor has several contexts, one copy of each (from its smallest document) goes to the bucket.
There the bucket's contexts are indexed by a run-length compressed Burrows-Wheeler transform: run heads with their steps, and
samples at the ends of the intervals of suffixes that share ``size`` bytes, each holding the smallest document of the
interval. The contexts are streamed against the index, all in step, from their last byte to their first: each step follows
one run to the row of the next longer suffix, and where the match reaches ``size`` bytes and its interval begins in a smaller
document, the string is marked. Marks return to the block that sent the context.

Common anchors. An anchor that has many contexts within a block, and a noticeable share overall, is replaced by the strings
themselves (each its own key), so no bucket has to hold the contexts of a very common phrase. The list of such anchors is
bounded by the share; strings keep being compared exactly.

Keys are hashes of 48 bits and contexts are told apart by another 48 bits under the same key; a removed context thus rests on
96 bits, a marked string on its bytes.

Nulls: a null text is empty. A null id orders behind all ids and is never smaller than another. Rows with the same id are
compared with other ids only. Texts shorter than ``size`` lose nothing. Empty tables give no rows. Only the id and text columns
are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from veriframe.llm.partenum import MIX, mix
from veriframe.llm.tables import binary_column, from_planes, give_back, pack, partitions, planes, ragged, slices, text_buffer, unpack
from veriframe.session import cut_lineage

GRAM = 16
NO_ID = np.iinfo(np.int64).max
INDEX_TEXTS = 10_000  # contexts of whole keys that one index holds, to bound memory; a larger key is an index of its own
COMMON_BLOCKS = 8  # every eighth block tells which anchors are common; that decides where strings meet, not what is removed
LOW48 = np.uint64((1 << 48) - 1)


def _sliding(values, width, pick):
    """``pick`` (minimum or maximum) over every window of ``width`` values."""
    span = 1
    while span * 2 <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[:span - width], values[width - span:]) if width > span else values


def anchors(data, offsets, size):
    """Places of the anchors of all strings of ``size`` bytes inside rows, with their hash and row.

    A gram is an anchor if it has the least hash of some string that holds it, so equal grams of one string are all anchors.
    """
    count = len(data) - size + 1
    rows = np.flatnonzero(np.diff(offsets) >= size)
    if count < 1 or not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = np.ndarray((len(data) - 7,), np.uint64, data.tobytes(), strides=(1,))
    hashes = mix(words[:-8] * MIX[0] + (words[8:] ^ MIX[2]) * MIX[1]) | np.uint64(1)
    width = size - GRAM + 1
    least = _sliding(hashes, width, np.minimum)
    inside = np.zeros(count + 1, np.int8)  # strings that do not cross a row's end
    inside[offsets[rows]] += 1
    inside[offsets[rows + 1] - size + 1] -= 1
    least *= np.cumsum(inside[:-1], dtype=np.int8).astype(np.uint64)
    # no string's least hash is above that of a gram in it, so a gram is some string's least where the largest one equals it
    padding = np.zeros(width - 1, np.uint64)
    place = np.flatnonzero(_sliding(np.concatenate([padding, least, padding]), width, np.maximum) == hashes)
    return place, hashes[place], np.searchsorted(offsets, place, side="right") - 1


def _matrix(padded, left, start, stop, width):
    """Bytes of [start, stop) as rows of ``width``, aligned at ``left``; each byte plus one, 0 outside (0xFF is no UTF-8)."""
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[left + width].copy()
    rows += 1
    clipped = np.flatnonzero((left < start) | (left + width > stop))
    place = left[clipped, None] + np.arange(width)
    rows[clipped] *= (place >= start[clipped, None]) & (place < stop[clipped, None])
    return rows


def _row_hashes(rows, salt):
    words = np.ascontiguousarray(rows).view(np.uint64)
    total = np.full(len(words), salt, np.uint64)
    for column in range(words.shape[1]):
        total = mix(total * MIX[0] + words[:, column])
    return total


def _padded(data, width):
    return np.concatenate([np.zeros(width, np.uint8), data, np.zeros(2 * width, np.uint8)])


class Items:
    """What a block compares: (key, context hash, start, stop, document) per anchor, or per string at common anchors."""

    def __init__(self, data, offsets, ids, size, common=np.zeros(0, np.uint64)):
        self.width = -(-(2 * size - GRAM) // 8) * 8
        found = []
        for a, b in slices(np.diff(offsets), 1 << 20):  # documents are cut into anchors a few at a time, which bounds memory
            place, hashes, row = anchors(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], size)
            found.append((place + offsets[a], hashes, row + a))
        place, hashes, row = (np.concatenate(c) for c in zip(*found))
        keys = hashes >> np.uint64(16)
        padded = _padded(data, self.width)
        usual = ~np.isin(keys, common)
        lead = size - GRAM
        start, stop = np.maximum(place - lead, offsets[row]), np.minimum(place + size, offsets[row + 1])
        parts = [(keys[usual], place[usual] - lead, start[usual], stop[usual], row[usual], place[usual] - start[usual])]
        if not usual.all():
            first, last, own = start[~usual], stop[~usual] - size, row[~usual]
            counts = last - first + 1
            string = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            string, at = np.unique(string, return_index=True)
            own = np.repeat(own, counts)[at]
            parts.append((None, string, string, string + size, own, np.zeros(len(string), np.int64)))
        out = []
        for key, left, start, stop, row, ahead in parts:
            contexts = np.zeros(len(left), np.uint64)
            made = np.zeros(len(left), np.uint64) if key is None else key
            for a in range(0, len(left), 1 << 16):
                rows = _matrix(padded, left[a: a + (1 << 16)], start[a: a + (1 << 16)], stop[a: a + (1 << 16)], self.width)
                contexts[a: a + len(rows)] = _row_hashes(rows, MIX[1]) & LOW48
                if key is None:
                    made[a: a + len(rows)] = _row_hashes(rows, MIX[2]) >> np.uint64(16)
            out.append((made, contexts, start, stop, np.asarray(ids)[row], ahead))
        self.key, self.context, self.start, self.stop, self.doc, self.lead = (np.concatenate(c) for c in zip(*out))
        order = np.lexsort((self.doc, self.context, self.key))
        self.key, self.context, self.start, self.stop, self.doc, self.lead = (c[order] for c in (self.key, self.context, self.start, self.stop, self.doc, self.lead))
        # entries: distinct (key, context), with the smallest document first
        new = np.ones(len(order), bool)
        new[1:] = (self.key[1:] != self.key[:-1]) | (self.context[1:] != self.context[:-1])
        self.first = np.flatnonzero(new)
        self.entry = np.cumsum(new) - 1

    def several(self):
        """Entries that hold more than one document."""
        last = np.concatenate([self.first[1:], [len(self.doc)]]) - 1
        return self.doc[last] != self.doc[self.first] if len(self.first) else np.zeros(0, bool)

    def least_times(self):
        """How often each entry occurs in its smallest document."""
        return np.add.reduceat((self.doc == self.doc[self.first][self.entry]).astype(np.int64), self.first) if len(self.first) else self.first

    def buckets(self, count):
        """[(bucket, entries)]; entries stay in order."""
        bucket = (self.key[self.first] % np.uint64(count)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(count + 1))
        return [(b, order[bounds[b]: bounds[b + 1]]) for b in np.flatnonzero(np.diff(bounds)).tolist()]


def _blocks(docs, id_col, text_col, size, block_bytes, common_at):
    """(block, payload, anchors, common, counts): texts of a block, and its anchors with many contexts."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for start, stop in slices(np.diff(offsets), block_bytes):
                part = batch.slice(start, stop - start)
                own, bounds = data[offsets[start]: offsets[stop]], offsets[start: stop + 1] - offsets[start]
                ids = np.array([NO_ID if v is None else v for v in part.column(0).to_pylist()], np.int64)
                keys, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
                if (number + (number >> 32)) % COMMON_BLOCKS == 0:
                    items = Items(own, bounds, ids, size)
                    total = len(items.key)
                    keys, counts = np.unique(items.key[items.first], return_counts=True)
                often = counts >= common_at
                payload = pack((ids, bounds, own.tobytes()), 3)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([payload], pa.binary()), pa.array([total]), pa.array([keys[often].astype(np.int64).tolist()], pa.list_(pa.int64())), pa.array([counts[often].tolist()], pa.list_(pa.int64()))],
                    ["block", "payload", "anchors", "common", "counts"],
                )
                number += 1
            give_back()

    return docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(run, "block bigint, payload binary, anchors bigint, common array<bigint>, counts array<bigint>")


def _open(payload):
    ids, offsets, data = unpack(payload)
    return ids, offsets, np.frombuffer(data, np.uint8)


def _ask(batches, size, buckets, common):
    """(bucket, block, payload): a block's entries by bucket."""
    for batch in batches:
        for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids, offsets, data = _open(payload)
            items = Items(data, offsets, ids, size, common.value)
            several = items.several()
            rows = []
            for bucket, entries in items.buckets(buckets):
                first = items.first[entries]
                docs = items.doc[first]
                # numbers that compress: steps between sorted keys, documents above the least one
                rows.append((bucket, block, pack((planes(np.diff(items.key[first].astype(np.int64), prepend=0)), planes(items.context[first].astype(np.int64)), int(docs.min()), planes(docs - docs.min()), np.packbits(several[entries])))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["bucket", "block", "payload"])
            del data, items, several, rows
            give_back()


COVERED, SENDER = 1, 2


def _answer(rows):
    """Per block: entries whose key occurs in several documents, with the smallest document of their context and its role."""
    parts = [(block, *unpack(payload)) for block, payload in zip(rows.column("block").to_pylist(), rows.column("payload").to_pylist())]
    sizes = [len(p[1][0]) for p in parts]
    key = np.concatenate([np.cumsum(from_planes(p[1])) for p in parts])
    context = np.concatenate([from_planes(p[2]) for p in parts])
    doc = np.concatenate([p[3] + from_planes(p[4]) for p in parts])
    several = np.concatenate([np.unpackbits(p[5], count=n).astype(bool) for p, n in zip(parts, sizes)])
    order = np.lexsort((doc, context, key))
    key, context, doc, several = key[order], context[order], doc[order], several[order]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new = new_key | np.concatenate([[True], context[1:] != context[:-1]])
    key_first, first = np.flatnonzero(new_key), np.flatnonzero(new)
    group, key_group = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    least = doc[first][group]
    contexts = np.add.reduceat(new.astype(np.int64), key_first)[key_group]
    many = np.add.reduceat((several | (doc != doc[key_first][key_group])).astype(np.int64), key_first)[key_group] > 0
    # an id may have rows in several blocks: each of them gets the marks
    role = np.where((doc == least) & (contexts > 1), SENDER, COVERED)
    # a context met in one block and one document only, alone under its key, is left out
    back = np.argsort(order)
    least, role, many = least[back], role[back], many[back]
    out, at = [], 0
    for (block, *_), n in zip(parts, sizes):
        told = np.flatnonzero(many[at: at + n])
        if len(told):
            low = least[at + told]
            out.append((block, rows.column("bucket")[0].as_py(), pack((planes(np.diff(told, prepend=0)), int(low.min()), planes(low - low.min()), role[at + told].astype(np.uint8)))))
        at += n
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["block", "bucket", "payload"])


def _settle(blocks, answers, size, buckets, common):
    """Spans that whole contexts remove (passed on), and the contexts that the index must compare."""
    if not blocks.num_rows:
        return pa.table([pa.array([], pa.int64())] * 2 + [pa.array([], pa.bool_()), pa.array([], pa.binary())], ["bucket", "block", "spans", "payload"])
    block = blocks.column("block")[0].as_py()
    ids, offsets, data = _open(blocks.column("payload")[0].as_py())
    items = Items(data, offsets, ids, size, common)
    told = {b: unpack(p) for b, p in zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist())}
    padded = _padded(data, items.width)
    least, least_times = np.full(len(items.first), NO_ID), items.least_times()  # once a block: buckets grow with the corpus
    rows = []
    for bucket, entries in items.buckets(buckets):
        if bucket not in told:
            continue
        steps, base, low, role = told[bucket]
        entries = entries[np.cumsum(from_planes(steps))]
        least[entries] = base + from_planes(low)
        send = items.first[entries[role == SENDER]]
        if len(send):
            start, stop = items.start[send], items.stop[send]
            texts = _matrix(padded, start, start, stop, items.width)
            docs = items.doc[send]
            # every place of the context in its smallest document is marked later
            times = least_times[entries[role == SENDER]]
            places = items.start[ragged(send, times)]
            rows.append((bucket, block, False, pack((planes(places), planes(times), stop - start, int(docs.min()), planes(docs - docs.min()), texts[np.arange(items.width) < (stop - start)[:, None]], items.key[send], items.lead[send].astype(np.uint8)))))
    gone = items.doc > least[items.entry]
    start, stop = items.start[gone], items.stop[gone]
    mask = np.zeros(len(data) + 1, np.int32)
    np.add.at(mask, start, 1)
    np.add.at(mask, stop, -1)
    covered = np.diff((np.cumsum(mask, dtype=np.int32) > 0).astype(np.int8), prepend=np.int8(0))
    rows.append((block % buckets, block, True, pack((planes(np.diff(np.flatnonzero(covered == 1), prepend=0)), planes(np.diff(np.flatnonzero(covered == -1), prepend=0))))))
    return pa.table([pa.array(c) for c in zip(*rows)], ["bucket", "block", "spans", "payload"])


class RunLengthIndex:
    """Run-length Burrows-Wheeler index of many short texts (rows of bytes from 1 up, 0 behind the end).

    Rows of the transform are the suffixes of all texts, empty ones included, in order; equal suffixes keep the order of
    their texts, so the step from a suffix to the one longer by a byte is constant within a run of equal bytes.
    """

    def __init__(self, texts, docs, size):
        count, width = texts.shape
        self.lengths = (texts > 0).sum(axis=1)
        suffix_text = np.repeat(np.arange(count), self.lengths + 1)
        suffix_at = np.arange(len(suffix_text)) - np.repeat(np.cumsum(self.lengths + 1) - self.lengths - 1, self.lengths + 1)
        flat = np.zeros((count, width + 8), np.uint8)
        flat[:, :width] = texts
        words = np.lib.stride_tricks.sliding_window_view(flat, 8, axis=1)[suffix_text, suffix_at]
        first_of = np.cumsum(self.lengths + 1) - self.lengths - 1
        key, depth = np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64), 8
        while depth <= width:
            rank = _dense(key)
            if depth <= size < 2 * depth:  # equal strings of ``size`` bytes: two overlapping ranks
                at_size = _pair(rank, self._ahead(rank, first_of, suffix_text, suffix_at, size - depth))
            key = _pair(rank, self._ahead(rank, first_of, suffix_text, suffix_at, depth))
            depth *= 2
        order = np.argsort(key, kind="stable")  # the suffix array; equal suffixes in the order of their texts
        text, at = suffix_text[order], suffix_at[order]
        before = np.where(at > 0, texts[text, np.maximum(at - 1, 0)], 0)
        # runs of equal preceding bytes, with the step that leads from a row to the row of the longer suffix
        run_start = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        head = before[run_start]
        run_length = np.diff(np.concatenate([run_start, [len(before)]]))
        by_head = np.argsort(head, kind="stable")
        target = np.zeros(len(head), np.int64)
        target[by_head] = np.cumsum(run_length[by_head]) - run_length[by_head]
        self.run_of = np.repeat(np.arange(len(head), dtype=np.int32), run_length)
        self.run_step = target - run_start
        # intervals of suffixes that share ``size`` bytes, sampled with their smallest document
        long_enough = self.lengths[text] - at >= size
        same = at_size[order]
        new = np.concatenate([[True], (same[1:] != same[:-1]) | (long_enough[1:] != long_enough[:-1])])
        self.interval_of = np.cumsum(new, dtype=np.int32) - 1
        self.interval_doc = np.minimum.reduceat(np.where(long_enough, docs[text], NO_ID), np.flatnonzero(new))
        self.size, self.docs = size, docs

    def _ahead(self, rank, first_of, suffix_text, suffix_at, by):
        """Rank of the suffix ``by`` bytes shorter; the empty suffix's where the text ends before."""
        return rank[first_of[suffix_text] + np.minimum(suffix_at + by, self.lengths[suffix_text])]

    def stream(self):
        """(text, place) of every string of ``size`` bytes that also occurs in a text of a smaller document."""
        # the empty suffixes come first, in the order of the texts; the byte before one is its text's last
        row, text, found = np.arange(len(self.lengths)), np.arange(len(self.lengths)), []
        for matched in range(1, int(self.lengths.max(initial=0)) + 1):
            going = matched <= self.lengths[text]
            row, text = row[going], text[going]
            row = row + self.run_step[self.run_of[row]]
            if matched >= self.size:
                hit = np.flatnonzero(self.interval_doc[self.interval_of[row]] < self.docs[text])
                found.append((text[hit], self.lengths[text[hit]] - matched))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(c) for c in zip(*found))


def _dense(values):
    """Rank of every value among the distinct ones."""
    order = np.argsort(values)
    ordered = values[order]
    rank = np.empty(len(values), np.uint64)
    rank[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]), dtype=np.uint64)
    return rank


def _partnered(texts, keys, lead, size):
    """Contexts that can share a string with another of their key.

    A string holds the anchor and at least half of the other bytes on one side, so two contexts that share one agree there.
    """
    half = (size - GRAM) // 2
    padded = np.zeros((len(texts), texts.shape[1] + size), np.uint8)
    padded[:, half: half + texts.shape[1]] = texts
    row = np.arange(len(texts))[:, None]
    kept = np.zeros(len(texts), bool)
    for start in (lead, lead + half + GRAM):
        side = _row_hashes(np.pad(padded[row, start[:, None] + np.arange(half)], ((0, 0), (0, -half % 8))), MIX[2])
        _, group, counts = np.unique(mix(keys * MIX[0] + side), return_inverse=True, return_counts=True)
        kept |= counts[group] > 1
    return kept


def _pair(first, second):
    return first << np.uint64(32) | second


def _compare(rows, size):
    """Index the contexts of a bucket and return the marked strings to the blocks that sent them; spans pass through."""
    out, parts = [], []
    for block, spans, payload in zip(*(rows.column(c).to_pylist() for c in ("block", "spans", "payload"))):
        if spans:
            out.append((block, True, payload))
        else:
            parts.append((block, *unpack(payload)))
    if parts:
        counts = [len(p[3]) for p in parts]
        length = np.concatenate([p[3] for p in parts])
        width = int(length.max())
        texts = np.zeros((len(length), width), np.uint8)
        texts[np.arange(width) < length[:, None]] = np.concatenate([p[6] for p in parts])
        docs = np.concatenate([p[4] + from_planes(p[5]) for p in parts])
        keys = np.concatenate([p[7] for p in parts])
        kept = np.flatnonzero(_partnered(texts, keys, np.concatenate([p[8] for p in parts]).astype(np.int64), size))
        kept = kept[np.argsort(keys[kept], kind="stable")]
        bounds = np.concatenate([np.unique(keys[kept], return_index=True)[1], [len(kept)]])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for first, last in slices(np.diff(bounds), INDEX_TEXTS):  # equal strings share a key, so an index may hold a few keys
            own = kept[bounds[first]: bounds[last]]
            text, place = RunLengthIndex(texts[own], docs[own], size).stream()
            found.append((own[text], place))
        text, place = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((place, text))
        text, place = text[order], place[order]
        ends = np.cumsum(counts)
        for (block, *part), start, stop in zip(parts, ends - counts, ends):
            a, b = np.searchsorted(text, [start, stop])
            if b > a:
                out.append((block, False, pack((part[0], part[1], planes(np.diff(text[a:b] - start, prepend=0)), place[a:b].astype(np.uint8)))))
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.binary()))], ["block", "spans", "payload"])


def _as_text(column):
    """Bytes as strings; characters that a cut has parted are dropped."""
    return pa.array([data.decode("utf-8", "ignore") for data in column.to_pylist()], pa.string())


def _cut(blocks, answers, size, as_text=False):
    """One row per document of a block: its bytes without the removed ones, and counts."""
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept"]
    if not blocks.num_rows:
        return pa.table([pa.array([], pa.int64())] * 4 + [pa.array([], pa.string() if as_text else pa.binary())], names)
    ids, offsets, data = _open(blocks.column("payload")[0].as_py())
    mask = np.zeros(len(data) + 1, np.int32)
    for spans, payload in zip(answers.column("spans").to_pylist(), answers.column("payload").to_pylist()):
        if spans:
            start, stop = (np.cumsum(from_planes(p)) for p in unpack(payload))
        else:
            places, times, text, place = unpack(payload)
            times, text = from_planes(times), np.cumsum(from_planes(text))
            start = from_planes(places)[ragged((np.cumsum(times) - times)[text], times[text])] + np.repeat(place.astype(np.int64), times[text])
            stop = start + size
        np.add.at(mask, start, 1)
        np.add.at(mask, stop, -1)
    gone = np.cumsum(mask[:-1], dtype=np.int32) > 0
    del mask
    total = np.concatenate([np.zeros(1, np.int32), np.cumsum(gone, dtype=np.int32)])
    removed = (total[offsets[1:]] - total[offsets[:-1]]).astype(np.int64)
    del total
    begins = gone.copy()
    inner = np.flatnonzero(gone[1:] & gone[:-1]) + 1
    begins[inner] = False
    begins[offsets[:-1][np.diff(offsets) > 0]] = gone[offsets[:-1][np.diff(offsets) > 0]]  # a run ends with its document
    spans = np.concatenate([np.zeros(1, np.int64), np.cumsum(begins, dtype=np.int32)])
    lengths = np.diff(offsets)
    kept = np.concatenate([[0], np.cumsum(lengths - removed)])
    rest = binary_column(data[~gone], kept)
    return pa.table([pa.array(ids, mask=ids == NO_ID), pa.array(lengths), pa.array(removed), pa.array((spans[offsets[1:]] - spans[offsets[:-1]]).astype(np.int64)), _as_text(rest) if as_text else rest], names)


def remove_repeats(docs, size=50, id_col="doc_id", text_col="text", block_bytes=8 << 20, common_at=64, common_share=1 / 40_000, as_text=False):
    """One row per document: id, n_bytes, n_removed, n_spans (maximal removed runs) and ``kept`` (the remaining bytes).

    With ``as_text`` they are a string, without the parts of characters that were cut in two.
    """
    spark, buckets = docs.sparkSession, partitions(docs.sparkSession)
    blocks = cut_lineage(_blocks(docs, id_col, text_col, size, block_bytes, common_at), "text-blocks")
    total = blocks.agg(F.sum("anchors")).first()[0] or 0
    often = blocks.select(F.explode(F.arrays_zip("common", "counts")).alias("c")).groupBy("c.common").agg(F.sum("c.counts").alias("n"))
    often = often.where(F.col("n") >= max(common_at, total * common_share)).collect()  # at most 1 / common_share keys
    common = spark.sparkContext.broadcast(np.array(sorted(r["common"] for r in often), np.uint64))
    texts = blocks.select("block", "payload")
    asked = texts.mapInArrow(lambda batches: _ask(batches, size, buckets, common), "bucket bigint, block bigint, payload binary")
    answered = asked.groupBy("bucket").applyInArrow(lambda rows: give_back(_answer(rows)), "block bigint, bucket bigint, payload binary")
    settled = texts.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(lambda b, a: give_back(_settle(b, a, size, buckets, common.value)), "bucket bigint, block bigint, spans boolean, payload binary")
    compared = settled.groupBy("bucket").applyInArrow(lambda rows: give_back(_compare(rows, size)), "block bigint, spans boolean, payload binary")
    kept = texts.groupBy("block").cogroup(compared.groupBy("block")).applyInArrow(lambda b, a: give_back(_cut(b, a, size, as_text)), f"id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept {'string' if as_text else 'binary'}")
    return kept.withColumnRenamed("id", id_col)
