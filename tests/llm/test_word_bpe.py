import base64
import hashlib
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from veriframe.llm import packing, word_bpe
from veriframe.llm.queries import QUERIES

ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces   three "), (5, "tab\tand\nline \n mixed\r\n"), (6, "don't we'll I'M 12345 a1b2"),
    (7, "naïve ÉCOLE Σίσυφος İstanbul ß"), (8, "<|endoftext|> <|startoftext|>"), (9, "日本語 テキスト emoji 😀😀  nbsp em"), (10, "x" * 5000),
    (11, "\x1c\x1fcontrol\x00nul \x85 next"), (12, "word " * 6000), (1, None), (12, "word " * 6000), (None, "no id"), (13, "é a ̈ b"),
]


@pytest.fixture(scope="module")
def own():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_vocabulary():
    return word_bpe.RankFile.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.mark.parametrize("block_bytes", [1, 32 << 20])
def test_byte_bpe_equals_library_and_round_trips(frame, own, block_bytes):
    docs = frame(ODD, "1 as bucket")
    rows = word_bpe.decode(word_bpe.encode(docs, byte_vocabulary(), block_bytes=block_bytes), byte_vocabulary(), chunk_tokens=100).collect()
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in rows)
    want = Counter()
    for doc_id, text in ODD:
        ids = own.encode_ordinary(text or "")
        want[doc_id, len(ids), struct.pack(f"<{len(ids)}I", *ids), (text or "").encode()] += 1
    assert got == want


def test_byte_bpe_query(spark, documents, own):
    rows = {r.doc_id: r for r in QUERIES["op10_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    for doc_id, text in zip(documents.doc_id, documents.text):
        ids = own.encode_ordinary(text)
        assert rows[doc_id].n_tokens == len(ids)
        assert rows[doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert rows[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(frame):
    docs = frame([(1, "a")]).where("false")
    assert word_bpe.decode(word_bpe.encode(docs, byte_vocabulary()), byte_vocabulary()).count() == 0
    assert packing.pack_documents(docs, word_bpe.TokenizerFile.read(public_tokenizers.path("word_bpe_49k.json"))).count() == 0


def check_packing(rows, texts, capacity=4096):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    want, got = Counter(), Counter()
    for doc_id, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start: start + capacity]
            want[doc_id, piece, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    bins = {}
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in rows)


def test_packing_odd_texts(frame):
    rows = packing.pack_documents(frame(ODD), word_bpe.TokenizerFile.read(public_tokenizers.path("word_bpe_49k.json"))).collect()
    check_packing(rows, ODD)


def test_packing_query(spark, documents):
    rows = QUERIES["op4_best_fit_packing"](spark, "/root/testdata/sf0.001").collect()
    bins, tokens = check_packing(rows, list(zip(documents.doc_id, documents.text)))
    assert bins <= -(-tokens // 4096) + 1


def test_hot_length_is_numbered_in_parts(spark):
    pieces = spark.range(5000).selectExpr("id as doc_id", "if(id % 3 = 0, 7, 1 + id % 5) as length")
    rows = packing.pack_lengths(pieces, 10, ["doc_id"], part_rows=100).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in b) <= 10 and sorted(b)[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(sorted(b), sorted(b)[1:])) for b in bins.values())
    assert len(rows) == 5000 and len(bins) <= 1.1 * sum(r.length for r in rows) / 10


def test_fullest_is_exact():
    import itertools
    import random

    random.seed(1)
    for _ in range(200):
        counts = {random.randint(1, 30): random.randint(1, 4) for _ in range(4)}
        room = random.randint(0, 60)
        best = max(sum(n * k for n, k in zip(counts, ks)) for ks in itertools.product(*(range(c + 1) for c in counts.values())) if sum(n * k for n, k in zip(counts, ks)) <= room)
        chosen = packing._fullest(counts, room)
        assert sum(n * k for n, k in chosen.items()) == best and all(k <= counts[n] for n, k in chosen.items())


def test_scans_in_another_order_are_an_error(monkeypatch):
    """Two rows change places between the scan for words and the scan for positions."""
    import types

    import pyarrow as pa

    monkeypatch.setattr(word_bpe.TaskContext, "get", lambda: types.SimpleNamespace(partitionId=lambda: 3))
    shared = types.SimpleNamespace(value=byte_vocabulary())

    def scan(rows, give_words):
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["doc_id", "text"])
        return pa.Table.from_batches(list(word_bpe._cut([batch], shared, 1 << 20, 1, give_words, not give_words)))

    rows = [(1, "one two"), (2, "two one")]
    answers = word_bpe._encode_bucket(scan(rows, True), shared)
    assert word_bpe._assemble([answers, scan(rows, False)], pa.int64()).column("id").to_pylist() == [1, 2]
    for changed in (rows[::-1], [(1, "two one"), (2, "one two")], [(2, "one two"), (1, "two one")]):
        with pytest.raises(ValueError, match="changed between two scans"):
            word_bpe._assemble([answers, scan(changed, False)], pa.int64())


@pytest.mark.parametrize("kind", ["smallint", "decimal(20,0)", "date", "string"])
def test_other_id_types(spark, kind):
    value = {"date": "date'2020-01-02'"}.get(kind, f"cast(7 as {kind})")
    docs = spark.sql(f"select {value} as doc_id, 'one two' as text union all select cast(null as {kind}), 'three'")
    rows = word_bpe.encode(docs, byte_vocabulary())
    assert rows.schema["doc_id"].dataType.simpleString() == kind
    assert {r.doc_id for r in rows.collect()} == {r.doc_id for r in docs.collect()}
