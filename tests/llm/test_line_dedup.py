import random

import pytest

from oracle import compare
from veriframe.llm import line_dedup
from veriframe.llm.queries import ORACLES, QUERIES


def brute(rows, k):
    """Rows are distinct (doc_id, text) with distinct ids; returns {doc_id: kept text}."""
    seen, gone = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        lines = [(i, line) for i, line in enumerate((text or "").split("\n")) if line.strip()]
        gone[doc_id] = set()
        for at in range(len(lines) - k + 1):
            window = tuple(line for _, line in lines[at: at + k])
            if window in seen:
                gone[doc_id] |= {i for i, _ in lines[at: at + k]}
            seen.add(window)
    return {d: None if t is None else "\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows}


@pytest.mark.parametrize("k", [1, 2, 3, 4, 7])
def test_random_lines(frame, k):
    random.seed(k)
    rows = [(i, "\n".join(random.choice("ABCDEF ") * random.choice([1, 1, 1, 2]) for _ in range(random.randint(1, 40)))) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(5)] + [(200, None), (201, ""), (202, "A\n" * 3000), (None, "A\nB\nC\nD")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(rows, "1 as seq"), min_lines=k).collect()}
    assert got == brute(rows, k)


def test_repeated_rows_and_empty_table(frame):
    docs = frame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\na\nb\nc")])
    assert sorted((r.doc_id, r.text, r.n_removed, r.n_runs) for r in line_dedup.dedup_lines(docs).collect()) == [(1, "a\nb\nc", 0, 0), (1, "a\nb\nc", 0, 0), (2, "x", 3, 1)]
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def test_query_matches_sql(spark, con):
    assert compare(QUERIES["op1_line_dedup"](spark, "/root/testdata/sf0.001").toPandas(), con.execute(ORACLES["op1_line_dedup"]).df()) is None


def brute_short(rows, k, min_words):
    """As ``brute``, with shorter windows of enough words and whole documents of one or two lines."""
    seen, gone = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        lines = [(i, line) for i, line in enumerate((text or "").split("\n")) if line.strip()]
        gone[doc_id] = set()
        for at in range(len(lines)):
            for span in {k, *range(1, min(k, 3))}:
                window = tuple(line for _, line in lines[at: at + span])
                if len(window) < span:
                    continue
                kinds = ["run"] if span == k else ["short"] * (sum(len(line.split()) for line in window) >= min_words) + ["document"] * (len(lines) == span)
                for kind in kinds:
                    if (kind, window) in seen:
                        gone[doc_id] |= {i for i, _ in lines[at: at + span]}
                for kind in kinds:
                    seen.add((kind, window))
    return {d: None if t is None else "\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows}


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_short_runs_with_enough_words(frame, k):
    rng = random.Random(k)
    pool = ["a b c d e f", "g h i", "j k l", "m", "n o", "  ", "p q r s t u v w"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.choice([1, 1, 2, 2, 3, 9])))) for i in range(80)]
    rows += [(100, "m"), (101, "m\n\n"), (102, "m\nn o"), (103, " \nm\n\nn o"), (104, None), (105, ""), (None, "m\nn o")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(rows), min_lines=k, min_words=6).collect()}
    assert got == brute_short(rows, k, 6)


def test_query_leaves_no_long_line_and_no_short_copy(spark):
    """Later copies of lines of 50 words, and of documents of fewer than three lines, are gone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, min_lines=3, min_words=50).collect()}
    seen, whole = set(), set()
    for doc_id, text in sorted((r.doc_id, r.text) for r in docs.collect()):
        for line in (kept[doc_id] or "").split("\n"):
            assert len(line.split()) < 50 or line not in seen
        lines = [line for line in text.split("\n") if line.strip()]
        if len(lines) < 3 and tuple(lines) in whole:
            assert not kept[doc_id].strip()
        whole.add(tuple(lines))
        seen.update(text.split("\n"))
