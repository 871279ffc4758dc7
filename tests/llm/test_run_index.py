import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from veriframe.llm import run_index
from veriframe.llm.queries import QUERIES
from veriframe.llm.tables import pack


def brute(rows, size):
    """[(doc_id, n_bytes, n_removed, n_spans, kept)] by comparing all strings; a null id is smaller than none."""
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        if doc_id is not None:
            for i in range(len(data) - size + 1):
                key = data[i: i + size]
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - size + 1):
            least = first.get(data[i: i + size])
            if least is not None and (doc_id is None or least < doc_id):
                gone[i: i + size] = b"\1" * size
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=str)


def passages(seed, n):
    random.seed(seed)
    words = ["the", "of", "and", "äöü", "ing", "tion", "er", "x", "   ", "\n"]
    shared = ["".join(random.choices(words, k=random.randint(8, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(random.randint(0, 6)):
            part = random.choice(shared) if random.random() < 0.6 else "".join(random.choices(words, k=random.randint(1, 40)))
            a = random.randint(0, max(0, len(part) - 20)) if random.random() < 0.5 else 0
            text += part[a:]
        rows.append((i, text))
    return rows


ODD = [(900, None), (901, ""), (902, "short"), (903, "=" * 5000), (904, "=" * 49), (905, "=" * 50), (906, "=" * 51), (None, "=" * 60), (903, "=" * 5000), (907, "ab" * 3000), (899, "\x00" * 80), (908, "\x00" * 70)]


@pytest.mark.parametrize("block_bytes,common_at,share", [(16 << 20, 64, 1 / 40_000), (3000, 64, 1 / 40_000), (3000, 2, 0)])
def test_against_all_strings(frame, block_bytes, common_at, share):
    rows = passages(3, 150) + ODD
    rows += [(2000 + i, ("the words of this text are all plain and odd in none " * 2 + f"end {i}") * (1 + i)) for i in range(4)]
    random.shuffle(rows)
    got = run_index.remove_repeats(frame(rows, "1 as block").repartition(5), 50, block_bytes=block_bytes, common_at=common_at, common_share=share).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute(rows, 50)


def test_anchors_are_the_least_grams():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    offsets = np.array([0, 10, 60, 60, 1000, 3000])
    place, hashes, row = run_index.anchors(data, offsets, 50)
    words = [int(h) for h in _all_hashes(data)]
    want = set()
    for a, b in zip(offsets[:-1], offsets[1:]):
        for i in range(a, b - 49):
            own = words[i: i + 35]
            want |= {i + j for j, h in enumerate(own) if h == min(own)}
    assert sorted(want) == place.tolist()


def _all_hashes(data):
    from veriframe.llm.partenum import MIX, mix

    words = np.array([int.from_bytes(data[i: i + 8].tobytes(), "little") for i in range(len(data) - 7)], np.uint64)
    return mix(words[:-8] * MIX[0] + (words[8:] ^ MIX[2]) * MIX[1]) | np.uint64(1)


def test_index_steps_through_every_text():
    rng = np.random.default_rng(4)
    texts = np.zeros((40, 84), np.uint8)
    for i in range(40):
        n = rng.integers(50, 85)
        texts[i, :n] = rng.integers(1, 3, n) if i % 3 else 5
    docs = np.arange(40)[::-1].copy()
    text, place = run_index.RunLengthIndex(texts, docs, 50).stream()
    got = set(zip(text.tolist(), place.tolist()))
    strings = {}
    lengths = (texts > 0).sum(axis=1)
    for i in range(40):
        for j in range(lengths[i] - 49):
            key = texts[i, j: j + 50].tobytes()
            strings[key] = min(strings.get(key, 99), docs[i])
    assert got == {(i, j) for i in range(40) for j in range(lengths[i] - 49) if strings[texts[i, j: j + 50].tobytes()] < docs[i]}


def test_empty_table(frame):
    assert run_index.remove_repeats(frame([(1, "a")]).where("false")).count() == 0


def test_query(spark, documents):
    import hashlib

    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op9_run_length_index"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {r[0]: (*r[1:4], hashlib.sha256(r[4]).hexdigest()) for r in brute(list(zip(documents.doc_id, documents.text)), 50)}


@pytest.mark.parametrize("block_bytes", [16 << 20, 3000, 400])
def test_repeated_and_null_ids_over_blocks(frame, block_bytes):
    """Rows of one id lose the same bytes in whichever block they lie."""
    passage = "".join(random.Random(5).choices("abcdefgh ", k=200))
    rows = [(1, "one " * 3 + passage + " first end")]
    rows += [(i, f"{'xyz' * 9} {passage[20:150]} {'uvw' * 9}") for i in (7, 7, 7, 9, None, None, None)]
    rows += [(8, f"{passage[100:170]} other {i} {passage[:90]}") for i in range(4)]
    rows += passages(7, 60) + [(i % 5 if i % 3 else None, text) for i, text in passages(8, 60)]
    random.Random(6).shuffle(rows)
    got = run_index.remove_repeats(frame(rows, "1 as block").repartition(4), 50, block_bytes=block_bytes).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute(rows, 50)


def test_a_block_counts_its_occurrences_once_whatever_the_buckets(monkeypatch):
    calls, count = [], run_index.Items.least_times
    monkeypatch.setattr(run_index.Items, "least_times", lambda self: calls.append(1) or count(self))
    size, buckets, common = 50, 40, SimpleNamespace(value=np.zeros(0, np.uint64))
    rows = [(i, text.encode()) for i, text in passages(5, 120)]
    blocks = []
    for number, part in enumerate((rows[:60], rows[60:])):
        offsets = np.cumsum([0, *(len(text) for _, text in part)])
        blocks.append((number, pack((np.array([i for i, _ in part]), offsets, b"".join(text for _, text in part)))))
    table = pa.table([pa.array(c) for c in zip(*blocks)], ["block", "payload"])
    asked = pa.Table.from_batches(run_index._ask(table.to_batches(), size, buckets, common)).combine_chunks()
    each = asked.column("bucket").to_numpy()
    answers = pa.concat_tables([run_index._answer(asked.filter(pa.array(each == b))) for b in np.unique(each)])
    sent = set()
    for number in (0, 1):
        settled = run_index._settle(table.slice(number, 1), answers.filter(pa.array(answers.column("block").to_numpy() == number)), size, buckets, common.value)
        sent |= {bucket for bucket, spans in zip(settled.column("bucket").to_pylist(), settled.column("spans").to_pylist()) if not spans}
    assert len(sent) > 2
    assert len(calls) == 2  # once a block, not once a bucket of it
