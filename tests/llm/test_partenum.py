import random
import re

import numpy as np
import pytest

from veriframe.llm import partenum
from veriframe.llm.queries import QUERIES


def brute(rows, width, percent):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i: i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            linked = sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)
            if (linked and None not in (rows[i][0], rows[j][0])) or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
                parent[root(i)] = root(j)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            best[root(i)] = min(best.get(root(i), doc_id), doc_id)
    return sorted((str(d), len(s), str(best.get(root(i)) if d is not None else None)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def texts(seed, n):
    random.seed(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and random.random() < 0.6:
            body = random.choice(rows)[1].split()
            for _ in range(random.randint(0, 4)):
                body[random.randrange(len(body))] = random.choice(words)
            rows.append((i, " ".join(body[: len(body) - random.randint(0, 3)] or body)))
        else:
            rows.append((i, " ".join(random.choices(words, k=random.choice([3, 12, 60, 150, 400])))))
    return rows


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_against_all_pairs(frame, width, percent):
    rows = texts(width, 250) + [(1000, None), (1001, ""), (1002, "  "), (1003, "one"), (1004, "ONE"), (1005, "one two"), (None, "one two"), (1006, "x y z " * 20000), (1006, "x y z " * 20000)]
    got = partenum.near_duplicates(frame(rows, "1 as _sig"), width, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, width, percent)


def test_large_group_of_near_copies(frame):
    random.seed(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(300):
        body = list(base)
        body[random.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(body)))
    got = partenum.near_duplicates(frame(rows), 3, 90).collect()
    assert {r.component_id for r in got} == {0}


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        for size in (5, 11, 30, 200, 1000):
            for _ in range(20):
                a = np.unique(rng.integers(0, 1 << 62, size, dtype=np.uint64))
                drop = int(size * (100 - percent) / 100)
                b = np.unique(np.concatenate([a[drop // 2:], rng.integers(0, 1 << 62, drop // 2 // 2, dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both < percent * len(np.union1d(a, b)) or np.array_equal(a, b):
                    continue
                found, row = partenum.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
                assert set(found[row == 0]) & set(found[row == 1])


def test_empty_table(frame):
    assert partenum.near_duplicates(frame([(1, "a")]).where("false")).count() == 0


def test_query(spark, documents):
    got = QUERIES["op7_ngram_jaccard"](spark, "/root/testdata/sf0.001").collect()
    rows = list(zip(documents.doc_id, documents.text))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 3, 90)


def test_blocks_of_a_large_group(spark):
    """Near copies that mostly do not link, cut into several chunks."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 120)
    sets = []
    for i in range(90):
        own = base.copy()
        change = rng.choice(120, rng.integers(0, 18), replace=False)
        own[change] = rng.integers(0, 1 << 62, len(change))
        sets.append(np.unique(own))
    rows = [(7, i, i, 90) for i in range(90)]
    members = spark.createDataFrame(rows, "_group bigint, _id bigint, _comp bigint, _n bigint")
    table = spark.createDataFrame([(i, bytearray(s.astype("<u8").tobytes())) for i, s in enumerate(sets)], "_id bigint, _set binary")
    flat, bounds = np.concatenate(sets).astype(np.uint64), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    data, offsets = partenum.parity_sketches(flat, bounds)
    sketches = spark.createDataFrame([(i, bytearray(data[offsets[i]: offsets[i + 1]].tobytes()), len(s)) for i, s in enumerate(sets)], "_id bigint, _sketch binary, _size bigint")
    blocks = partenum._open_blocks(members, sketches, 90, 20)
    assert blocks.select("_block").distinct().count() > 5
    got = {tuple(sorted(r)) for r in partenum._links_in_blocks(blocks, table, 90).collect()}
    want = {(i, j) for j in range(90) for i in range(j) if partenum._similar(sets[i], sets[j], 90)}
    assert got == want and 0 < len(want) < 2000


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_sketches_never_rule_out_similar_sets(percent):
    rng = np.random.default_rng(percent)
    ruled_out = 0
    for size in (1, 3, 16, 17, 60, 300, 2000):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 62, size)).astype(np.uint64)
            keep = rng.random(len(a)) < rng.choice([0.3, 0.8, 0.95, 1.0])
            b = np.unique(np.concatenate([a[keep], rng.integers(0, 1 << 62, rng.integers(0, size // 4 + 2)).astype(np.uint64)]))
            if not len(b):
                continue
            data, offsets = partenum.parity_sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            left, right = data[: offsets[1]].view(np.uint64), data[offsets[1]:].view(np.uint64)
            allowed = bool(partenum.sketches_allow(left, right, len(a), len(b), percent))
            assert allowed or not partenum._similar(a, b, percent)
            assert allowed == bool(partenum.sketches_allow(right, left[None], len(b), np.array([len(a)]), percent)[0])
            ruled_out += not allowed
    assert ruled_out > 30


def test_copies_that_share_signatures_without_links(frame):
    """Texts at about 0.7 to each other, with a few near copies among them: one open group that is settled exactly."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        body = list(base)
        at = rng.randrange(320)
        body[at: at + 65] = [f"x{i}_{k}" for k in range(65)]
        rows.append((i, " ".join(body)))
        if i % 10 == 0:
            body[(at + 200) % 400] = "changed"
            rows.append((1000 + i, " ".join(body)))
    got = partenum.near_duplicates(frame(rows), 5, 80).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 5, 80)


def test_sketches_of_a_block_meet_once_and_folded_first(monkeypatch):
    rng, sets = np.random.default_rng(12), []
    for i in range(300):
        made = rng.integers(0, 1 << 63, int(rng.integers(3, 40) if i % 7 == 0 else rng.integers(150, 400)), dtype=np.uint64)
        if i % 3 == 1:  # a near copy of the one before
            made = np.concatenate([sets[-1][: -max(1, len(sets[-1]) // 20)], made[: len(sets[-1]) // 20]])
        sets.append(np.unique(made))
    sizes, comps = np.array([len(s) for s in sets]), rng.integers(0, 200, 300)
    data, offsets = partenum.parity_sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]))
    sketches = [data[a:b].view(np.uint64) for a, b in zip(offsets, offsets[1:])]
    allow, laid = partenum.sketches_allow, []
    wanted = [any(comps[i] != comps[j] and allow(*((sketches[k] for k in ((i, j) if len(sketches[i]) <= len(sketches[j]) else (j, i)))), sizes[i], sizes[j], 80) for j in range(300)) for i in range(300)]
    monkeypatch.setattr(partenum, "sketches_allow", lambda left, right, *rest: laid.append(right[..., 0].size) or allow(left, right, *rest))
    for slab in ({}, {"slab": 100}):
        laid.clear()
        assert partenum.partners_by_sketch(sketches, sizes, comps, 80, **slab).tolist() == wanted
        assert sum(laid) < 300 * 300 / 20
    assert 50 < sum(wanted) < 250
