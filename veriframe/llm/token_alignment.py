"""Cross-tokenizer alignment: groups of tokens that end together, and how often two ids end together in the corpus.

A text is coded by two tokenizers, both over a space and the text. Byte offsets where a token of each ends cut both token
lists into groups. The two lists of ends are compared at the current index shift: equal stretches are one-to-one groups, found
by probing blocks of doubling, then halving length; at the first unequal pair the shorter side steps until both ends meet, and
the shift is updated. Ends are laid end to end over a block of documents, which all end together at their borders.

A document's last ids of each group are a link. A block of documents keeps each of its distinct id pairs once, with a count;
the pairs are added up over the corpus (combined before the shuffle) and sent back to the blocks that hold them, so a pair
that occurs everywhere is one row a block. Blocks are cut by bytes; a longer document is a block of its own.

Tokenizing goes by stretches that start with a space behind another character. No piece of either vocabulary reaches over such
a border (``PieceModel`` checks it when it is read; the byte-level pattern never takes white space behind other characters into
one match), so ids are those of the whole text, and a stretch that repeats within a task is coded once.

A text that is null or empty, or whose joined token bytes differ from a space and the text on either side, has no tokens: all
counts are 0 and ``groups`` is ''. Rows with equal or null ids are handled one by one. Empty tables give no rows. Only the id
and the text column are read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from veriframe.llm.tables import kept_with, ragged, slices, text_buffer
from veriframe.session import cut_lineage

UNEVEN = re.compile(r"\s ")
KNOWN_BYTES = 32 << 20  # a task forgets its coded stretches beyond this size, each counted with 64 bytes more


@dataclass(frozen=True)
class ByteLevelFile:
    """A byte-level tokenizer saved as JSON; special tokens' strings are ordinary text."""

    content: bytes

    @classmethod
    def read(cls, path):
        with open(path, "rb") as file:
            return cls(file.read())

    def token_bytes(self):
        entries = json.loads(self.content)
        # byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        table = {i: bytes(byte_of[c] for c in token) for token, i in entries["model"]["vocab"].items()}
        return [table.get(i, b"") for i in range(max(table, default=-1) + 1)]

    def encoder(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(self.content)
        tokenizer.encode_special_tokens = True
        return lambda words: [e.ids for e in tokenizer.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]


@dataclass(frozen=True)
class PieceModel:
    """A sentence-piece model that puts a space in front of every text."""

    content: bytes

    @classmethod
    def read(cls, path):
        with open(path, "rb") as file:
            model = cls(file.read())
        if any(re.search("[^▁]▁", piece) for piece in model._pieces()):
            raise ValueError("a piece reaches over the start of a word")
        return model

    def _processor(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.content)

    def _pieces(self):
        processor = self._processor()
        return [processor.id_to_piece(i) for i in range(processor.get_piece_size())]

    def token_bytes(self):
        processor = self._processor()
        return [bytes([int(p[3:-1], 16)]) if processor.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self._pieces())]

    def encoder(self):
        processor = self._processor()
        return lambda words: processor.encode(words, num_threads=1)


def stretches(text):
    """The stretches of a space and ``text``, each without the space it starts with."""
    if UNEVEN.search(" " + text):
        words = re.split(r"(?<=\S) ", text)
    else:
        words = text.split(" ")
    if len(words) > 1 and not words[-1]:  # a lone space at the end
        words[-2:] = [words[-2] + " "]
    return words


class _Coder:
    """Ids of a tokenizer by stretch number, with every id's bytes."""

    def __init__(self, tokenizer):
        self.encode = tokenizer.encoder()
        tokens = tokenizer.token_bytes()
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.marked = {mark: np.array([f"{i}{mark}" for i in range(len(tokens))] + [""], object) for mark in ",|;"}
        self.clear()

    def clear(self):
        self.starts, self.lengths, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def learn(self, words):
        coded = self.encode(words)
        self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, coded), np.int64, len(coded))])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(coded), np.int64)])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def tokens(self, sequence, counts):
        """Ids of the stretches ``sequence`` and each document's number of them."""
        by_word = self.lengths[sequence]
        ends = np.concatenate([[0], np.cumsum(by_word)])[np.concatenate([[0], np.cumsum(counts)])]
        return self.ids[ragged(self.starts[sequence], by_word)], np.diff(ends)

    def equal(self, ids, counts, wanted, limits):
        """Whether each document's joined token bytes are ``wanted[limits[k]:limits[k + 1]]``."""
        sizes = self.sizes[ids]
        edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        same = np.diff(edges) == np.diff(limits)
        if same.all():
            wrong = np.flatnonzero(self.data[ragged(self.places[ids], sizes)] != wanted)
            same[np.searchsorted(limits, wrong, side="right") - 1] = False
            return same
        joined = self.data[ragged(self.places[ids], sizes)]
        return np.array([bool(ok) and np.array_equal(joined[edges[k]: edges[k + 1]], wanted[limits[k]: limits[k + 1]]) for k, ok in enumerate(same)], bool)


def common_ends(left, right):
    """Indices (in ``left``, in ``right``) of the ends that both increasing lists hold; their last ends are equal.

    Blocks of both lists are compared at the current shift; a block that is equal doubles the next one, an unequal one is halved.
    """
    a, b = np.ascontiguousarray(left, np.int64).tobytes(), np.ascontiguousarray(right, np.int64).tobytes()
    ends_a, ends_b = left.tolist(), right.tolist()
    n, i, j = len(ends_a), 0, 0
    starts_a, starts_b, lengths = [], [], []
    while i < n:
        step, grow, p, q = 8, True, 8 * i, 8 * j  # in bytes of 64-bit numbers
        while step >= 8:
            if a[p: p + step] == b[q: q + step] and p + step <= len(a):
                p, q = p + step, q + step
                step = step << 1 if grow else step >> 1
            else:
                grow, step = False, step >> 1
        run = (p >> 3) - i
        if run:
            starts_a.append(i)
            starts_b.append(j)
            lengths.append(run)
            i, j = i + run, j + run
            if i >= n:
                break
        x, y = ends_a[i], ends_b[j]
        while x != y:
            if x < y:
                i += 1
                x = ends_a[i]
            else:
                j += 1
                y = ends_b[j]
        starts_a.append(i)
        starts_b.append(j)
        lengths.append(1)
        i, j = i + 1, j + 1
    return ragged(starts_a, lengths), ragged(starts_b, lengths)


def groups_text(text):
    """What to keep of a document's groups: here the whole text ``a1,a2|b1;a3|b2,b3``."""
    return text


def groups_sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


class _Aligner:
    def __init__(self, left, right):
        self.left, self.right, self.numbers, self.held = _Coder(left), _Coder(right), {}, 0

    def block(self, texts, describe):
        """Per document (n_a, n_b, n_groups, groups), the numbers of its links' pairs, and the distinct pairs with their counts."""
        if self.held > KNOWN_BYTES:
            self.numbers, self.held = {}, 0
            self.left.clear()
            self.right.clear()
        numbers, fresh, sequences = self.numbers, [], []
        for text in texts:
            words = stretches(text) if text else []
            for word in set(words).difference(numbers):
                numbers[word] = len(numbers)
                fresh.append(word)
            sequences.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        if fresh:
            self.held += sum(map(len, fresh)) + 64 * len(fresh)
            self.left.learn(fresh)
            self.right.learn(fresh)
        counts = np.array([len(s) for s in sequences], np.int64)
        sequence = np.concatenate(sequences) if sequences else np.zeros(0, np.int64)
        whole = [(" " + t).encode() if t else b"" for t in texts]
        limits = np.concatenate([[0], np.cumsum([len(w) for w in whole])]).astype(np.int64)
        wanted = np.frombuffer(b"".join(whole), np.uint8)
        a, n_a = self.left.tokens(sequence, counts)
        b, n_b = self.right.tokens(sequence, counts)
        good = self.left.equal(a, n_a, wanted, limits) & self.right.equal(b, n_b, wanted, limits)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        at_a, at_b = common_ends(np.cumsum(self.left.sizes[a]), np.cumsum(self.right.sizes[b]))
        stops = np.searchsorted(at_a, np.cumsum(n_a) - 1, side="right")  # groups up to each document's end
        stops = np.where(np.cumsum(n_a) > 0, stops, 0)
        n_groups = np.diff(stops, prepend=0)
        pairs, link, times = np.unique(a[at_a] << 32 | b[at_b], return_inverse=True, return_counts=True)
        described = self._described(a, b, at_a, at_b, n_groups, describe)
        return (n_a, n_b, n_groups, described), link, stops, (pairs >> 32, pairs & 0xFFFFFFFF, times)

    def _described(self, a, b, at_a, at_b, n_groups, describe):
        """Each document's groups as text: tokens of a group side by side, the last of each side with another mark."""
        words_a, words_b = self.left.marked[","][a], self.right.marked[","][b]
        words_a[at_a], words_b[at_b] = self.left.marked["|"][a[at_a]], self.right.marked[";"][b[at_b]]
        size_a, size_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        start = np.cumsum(size_a + size_b) - size_a - size_b
        words = np.empty(len(a) + len(b), object)
        words[ragged(start, size_a)] = words_a
        words[ragged(start + size_a, size_b)] = words_b
        ends = np.concatenate([[0], np.cumsum(size_a + size_b)])[np.concatenate([[0], np.cumsum(n_groups)])].tolist()
        return [describe("".join(words[x:y].tolist())[:-1]) if y > x else "" for x, y in zip(ends, ends[1:])]


@dataclass(frozen=True)
class _Pair:
    left: object
    right: object


def _aligner(shared):
    return kept_with(shared.value, "_aligner", lambda: _Aligner(shared.value.left, shared.value.right))


def _blocks(batches, shared, block_bytes, describe, schema):
    """A row for each document with its links as numbers of the block's pairs, then a row with the block's pairs."""
    aligner, block = _aligner(shared), TaskContext.get().partitionId() << 32
    for batch in batches:
        sizes = np.diff(text_buffer(batch.column(1))[1])
        for start, stop in slices(sizes, block_bytes):
            part = batch.slice(start, stop - start)
            (n_a, n_b, n_groups, described), link, stops, (a, b, times) = aligner.block(part.column(1).to_pylist(), describe)
            width = max(1, (int(len(a)).bit_length() + 7) // 8)
            parts = [np.stack([(own >> (8 * k)).astype(np.uint8) for k in range(width)]).tobytes() for own in np.split(link, stops[:-1])]
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), part.column(0).cast(schema.field("id").type), pa.array(n_a), pa.array(n_b), pa.array(n_groups),
                 pa.array(described, pa.string()), pa.array(parts, pa.binary()), pa.nulls(n, schema.field("pairs").type)], schema=schema)
            kind = schema.field("pairs").type
            own = pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(times, pa.int64())], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.nulls(1, schema.field("id").type), *[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own).cast(kind)], schema=schema)
            block += 1


def _with_counts(docs, answers, schema):
    """Documents of one block with the corpus-wide counts of their links."""
    at = answers.column("at").to_numpy()
    count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    count[at] = answers.column("count").to_numpy()
    best[at] = answers.column("best").to_numpy().astype(np.int64)
    n_links = docs.column("n_groups").to_numpy()
    raw, offsets = text_buffer(docs.column("links"))
    links = []
    for k, n in enumerate(n_links.tolist()):
        own = raw[offsets[k]: offsets[k + 1]].reshape(-1, n) if n else np.zeros((0, 0), np.uint8)
        links.append(sum((plane.astype(np.int64) << (8 * i) for i, plane in enumerate(own)), np.zeros(n, np.int64)))
    link = np.concatenate(links) if links else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(n_links)]).astype(np.int64)
    sums = [np.diff(np.concatenate([[0], np.cumsum(of[link])])[ends]) for of in (best, count)]
    return pa.Table.from_arrays(
        [docs.column("id"), docs.column("n_a"), docs.column("n_b"), docs.column("n_groups"), pa.array(n_links), *map(pa.array, sums), docs.column("groups")], schema=schema)


def align(docs, left, right, id_col="doc_id", text_col="text", describe=groups_text, block_bytes=3 << 20):
    """One row per document: ``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum and ``groups``.

    ``left`` and ``right`` are tokenizers (``token_bytes()`` and ``encoder()``). ``n_best`` counts links whose corpus-wide count
    is the highest of their right id, ``count_sum`` adds up the links' counts. ``describe`` turns a document's groups into what
    is kept of them. ``groups`` of a document without tokens is ''.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    shared = docs.sparkSession.sparkContext.broadcast(_Pair(left, right))  # two vocabulary files: a few MB, whatever the corpus
    kind = docs.schema[id_col].dataType
    id_type, id_arrow = kind.simpleString(), to_arrow_type(kind)
    pair = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))
    numbers = [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups")]
    inner = pa.schema([("block", pa.int64()), ("id", id_arrow), *numbers, ("groups", pa.string()), ("links", pa.binary()), ("pairs", pair)])
    aligned = cut_lineage(docs.select(id_col, text_col).mapInArrow(
        lambda batches: _blocks(batches, shared, block_bytes, describe, inner),
        f"block bigint, id {id_type}, n_a bigint, n_b bigint, n_groups bigint, groups string, links binary, pairs array<struct<a:int,b:int,n:bigint>>",
    ), "aligned")
    asked = aligned.where(F.col("pairs").isNotNull()).select("block", F.posexplode("pairs").alias("at", "pair")).select("block", "at", "pair.*")
    counts = asked.groupBy("a", "b").agg(F.sum("n").alias("count"))
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    counts = counts.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    answers = asked.select("block", "at", "a", "b").join(counts, ["a", "b"]).select(F.col("block").alias("of"), "at", "count", "best")
    outer = pa.schema([("id", id_arrow), *numbers, *[(c, pa.int64()) for c in ("n_links", "n_best", "count_sum")], ("groups", pa.string())])
    rows = aligned.where(F.col("pairs").isNull()).drop("pairs").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(
        lambda mine, back: _with_counts(mine, back, outer),
        f"id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string",
    )
    return rows.withColumnRenamed("id", id_col)
