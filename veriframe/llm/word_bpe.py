"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Documents are cut into blocks of whole rows. A block sends each of its distinct words once to the word's bucket. A bucket
holds every block's request for its words, encodes each distinct word once and answers each block. The block's sequence of
word numbers (the positions) meets the answers by block, where ids are put back by position. A word that fills the corpus is
still one entry per block, so no key gathers more rows than there are blocks. Positions either travel with the words, which
shuffles them twice, or come from a second scan, which costs time; then both scans must see the same rows in the same order,
as scans of files do; a block whose ids or texts differ between its scans, in their order too, is an error, not a wrong result.

A word is a stretch between single spaces with the space in front of it, which is always a border between matches of the
splitting pattern as long as white space does not touch white space; other texts are cut by the pattern itself.

Nulls: a null text encodes like an empty one, to no ids. Repeated rows give repeated results. Empty tables give no rows.
Only the id and the text column are read, so further columns cannot clash.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql.pandas.types import to_arrow_type

from veriframe.llm.tables import binary_column, from_planes, give_back, kept_with, pack, partitions, planes, ragged, slices, text_buffer, unpack

# White space that touches white space, or is neither a space nor a line feed.
UNEVEN = re.compile(r"\s\s|[^\S \n]")


@dataclass(frozen=True)
class RankFile:
    """Ranks of a byte-level vocabulary, read from a file with one base64 token and one rank a line."""

    content: bytes
    pattern: str

    @classmethod
    def read(cls, path, pattern):
        with open(path, "rb") as file:
            return cls(file.read(), pattern)

    def ranks(self):
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, self.content.splitlines())}

    def token_table(self):
        """Token bytes laid end to end, with each id's start and length."""
        ranks = self.ranks()
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        lengths = np.array([len(t) for t in tokens], np.int64)
        return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths

    def build(self):
        import regex
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks(), special_tokens={})
        return (lambda words: [encoding.encode_ordinary(w) for w in words]), regex.compile(self.pattern).findall


@dataclass(frozen=True)
class TokenizerFile:
    """A tokenizer saved as JSON that drops white space; special tokens' strings are ordinary text."""

    content: bytes

    @classmethod
    def read(cls, path):
        with open(path, "rb") as file:
            return cls(file.read())

    def build(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(self.content)
        tokenizer.encode_special_tokens = True
        return (lambda words: [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]), None


def _built(vocabulary):
    """Encoder and splitter of a broadcast vocabulary, built once per worker process."""
    return kept_with(vocabulary.value, "_coder", vocabulary.value.build)


class _Numbers(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def _digest(ids, data, offsets):
    """Names a block's ids and texts in their order, so that two scans of it can be compared."""
    value = xxhash.xxh3_128(ids)
    value.update(np.ascontiguousarray(data))
    value.update(np.ascontiguousarray(offsets))
    return value.digest()


def _words(text, split):
    """Keys of a text's words: a string stands for itself with a space in front, a 1-tuple for exactly its string."""
    if split is not None and UNEVEN.search(text):
        return [(match,) for match in split(text)]
    words = text.split(" ")
    words[0] = (words[0],)
    return words


def _cut(batches, vocabulary, block_bytes, buckets, give_words, give_positions):
    """(bucket, block, positions?, payload): a block's distinct words by bucket, its ids and positions, or both."""
    split = _built(vocabulary)[1]
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        sizes = np.diff(text_buffer(batch.column(1))[1])
        for start, stop in slices(sizes, block_bytes):
            part = batch.slice(start, stop - start)
            numbers, sequences, counts = _Numbers(), [], []
            for text in part.column(1).to_pylist():
                words = _words(text, split) if text else []
                sequences.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                counts.append(len(words))
            rows, ids = [], pa.table({"id": part.column(0)})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema) as writer:
                writer.write_table(ids)
            ids = sink.getvalue().to_pybytes()
            digest = _digest(ids, *text_buffer(part.column(1)))
            if give_positions:
                rows.append((block % buckets, block, True, pack((ids, np.array(counts, np.int64), planes(np.concatenate(sequences)), len(numbers), digest), 6)))
            if give_words:
                words = [word[0] if type(word) is tuple else " " + word for word in numbers]
                bucket_of = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words))
                order = np.argsort(bucket_of, kind="stable")
                bounds = np.searchsorted(bucket_of[order], np.arange(buckets + 1))
                for bucket in np.flatnonzero(np.diff(bounds)):
                    mine = order[bounds[bucket]: bounds[bucket + 1]]
                    own = [words[i] for i in mine]
                    rows.append((int(bucket), block, False, pack((planes(np.diff(mine, prepend=0)), planes([len(w) for w in own]), "".join(own), digest), 6)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["bucket", "block", "positions", "payload"])
            block += 1
        give_back()


def _encode_bucket(rows, vocabulary):
    """Encode each distinct word of the bucket once and answer every block that asked for it."""
    encode = _built(vocabulary)[0]
    requests, blocks, answers = [], [], []
    for block, positions, payload in zip(*(rows.column(c).to_pylist() for c in ("block", "positions", "payload"))):
        if positions:
            answers.append((block, True, payload))
            continue
        blocks.append(block)
        local, sizes, joined, digest = unpack(payload)
        ends = np.cumsum(from_planes(sizes)).tolist()
        requests.append((local, [joined[a:b] for a, b in zip([0, *ends], ends)], digest))
    numbers = _Numbers()
    wanted = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for _, words, _ in requests]
    words, lengths, flat = list(numbers), [], []
    for start in range(0, len(words), 20000):
        coded = encode(words[start: start + 20000])
        lengths += map(len, coded)
        flat.append(np.fromiter(chain.from_iterable(coded), np.uint32))
    flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
    lengths = np.array(lengths, np.int64)
    starts = np.cumsum(lengths) - lengths
    for block, (local, _, digest), index in zip(blocks, requests, wanted):
        answers.append((block, False, pack((local, planes(lengths[index]), planes(flat[ragged(starts[index], lengths[index])]), digest))))
    return pa.table([pa.array(c) for c in zip(*answers)], ["block", "positions", "payload"])


def _assemble(tables, id_type):
    """Put the ids of a block's words back by position and cut them at the documents' ends."""
    parts = {True: [], False: []}
    for rows in tables:
        for positions, payload in zip(rows.column("positions").to_pylist(), rows.column("payload").to_pylist()):
            parts[positions].append(unpack(payload))
    answers = parts[False]
    if len(parts[True]) != 1:
        raise ValueError("the input changed between two scans; write it to a table first")
    ids, counts, sequence, distinct, digest = parts[True][0]
    if any(answer[3] != digest for answer in answers):
        raise ValueError("the input changed between two scans; write it to a table first")
    sequence = from_planes(sequence)
    starts, lengths, flat, at = np.zeros(distinct, np.int64), np.zeros(distinct, np.int64), [np.zeros(0, np.uint32)], 0
    for local, own, values, _ in answers:
        local, own, values = np.cumsum(from_planes(local)), from_planes(own), from_planes(values).astype(np.uint32)
        starts[local], lengths[local] = at + np.cumsum(own) - own, own
        flat.append(values)
        at += len(values)
    if sum(len(own[0]) for _, own, _, _ in answers) != distinct:
        raise ValueError("the input changed between two scans; write it to a table first")
    flat = np.concatenate(flat)
    by_word = lengths[sequence]
    tokens = flat[ragged(starts[sequence], by_word)]
    ends = np.concatenate([[0], np.cumsum(by_word)])[np.concatenate([[0], np.cumsum(counts)])]
    documents = pa.ipc.open_stream(ids).read_all().column("id").cast(id_type)
    return pa.table([documents, pa.array(np.diff(ends)), binary_column(tokens.astype("<u4").view(np.uint8), 4 * ends)], ["id", "n_tokens", "ids"])


def encode(docs, vocabulary, id_col="doc_id", text_col="text", block_bytes=8 << 20, rescan=True):
    """One row per document: ``id_col``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit, as binary).

    ``rescan`` takes positions from a second scan instead of shuffling them with the words.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)  # a vocabulary file: a few MB, whatever the corpus
    buckets = partitions(spark)
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(give_words, give_positions):
        return docs.select(id_col, text_col).mapInArrow(
            lambda batches: _cut(batches, shared, block_bytes, buckets, give_words, give_positions), "bucket bigint, block bigint, positions boolean, payload binary"
        )

    answers = cut(True, not rescan).groupBy("bucket").applyInArrow(lambda rows: give_back(_encode_bucket(rows, shared)), "block bigint, positions boolean, payload binary")
    arrow = to_arrow_type(docs.schema[id_col].dataType)
    schema = f"id {id_type}, n_tokens bigint, ids binary"
    if rescan:  # each scan is a stage of its own, so both number their blocks alike
        both = answers.groupBy("block").cogroup(cut(False, True).groupBy("block"))
        coded = both.applyInArrow(lambda words, positions: give_back(_assemble([words, positions], arrow)), schema)
    else:
        coded = answers.groupBy("block").applyInArrow(lambda rows: give_back(_assemble([rows], arrow)), schema)
    return coded.withColumnRenamed("id", id_col)


def decode(encoded, vocabulary, chunk_tokens=1 << 20):
    """``encoded`` with a binary column ``decoded``: each id joined to its bytes in the token table, in order."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary.token_table())  # one row per token of the vocabulary

    def run(batches):
        data, starts, lengths = shared.value
        for batch in batches:
            raw, offsets = text_buffer(batch.column("ids"))
            for start, stop in slices(np.diff(offsets) // 4, chunk_tokens):
                ids = raw[offsets[start]: offsets[stop]].view("<u4").astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(lengths[ids])])[(offsets[start: stop + 1] - offsets[start]) // 4]
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*part.columns, binary_column(data[ragged(starts[ids], lengths[ids])], ends)], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, encoded.schema.simpleString()[7:-1].replace(":", " ") + ", decoded binary")
