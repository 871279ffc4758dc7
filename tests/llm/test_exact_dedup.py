import hashlib

import pytest

from oracle import compare
from veriframe.llm import exact_dedup
from veriframe.llm.queries import ORACLES, QUERIES

ROWS = [(5, "Same"), (9, "sAME"), (7, "same"), (2, None), (3, ""), (4, "ÄB"), (6, "äb"), (8, "ÄB"), (None, "lost"), (None, "same"), (9, "sAME"), (11, "z" * 100000), (12, "Z" * 100000)]


@pytest.mark.parametrize("capacity", [1, 2, 1000])
def test_small_cases(frame, capacity):
    rows = answers(exact_dedup.exact_duplicates(frame(ROWS, "1 as _key"), capacity=capacity))
    assert rows == wanted(ROWS)


def answers(found):
    return sorted(tuple(-1 if v is None else v for v in r) for r in found.collect())


def wanted(rows):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    want = []
    for text in {lower(t) for _, t in rows}:
        group = [d for d, t in rows if lower(t) == text]
        keep = max((d for d in group if d is not None), default=None)
        for i, doc_id in enumerate(group):
            first = doc_id == keep and i == group.index(keep)  # one row of a repeated one
            want.append((doc_id, keep, len(group), first, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(tuple(-1 if v is None else v for v in r) for r in want)


def test_different_texts_under_one_key_and_digest(frame):
    """Keys and digests that collide make chains; texts alone tell their links apart."""
    from pyspark.sql import functions as F

    want = [row[:4] for row in wanted(ROWS)]
    for key in (lambda text: F.lit(7).cast("bigint"), lambda text: F.length(text).cast("bigint")):
        for digest in (exact_dedup.text_digest, lambda text: F.substring(F.sha2(text, 256), 1, 1), lambda text: F.lit("same")):
            rows = answers(exact_dedup.exact_duplicates(frame(ROWS), key=key, digest=digest).drop("text_sha256"))
            assert rows == sorted(want)


def test_owners_group_without_another_exchange(spark, frame):
    """Behind the exchange by ranges of keys only sorts and grouping follow: the owner of a bucket makes its chains."""
    import io
    from contextlib import redirect_stdout

    from pyspark.sql import functions as F

    texts = frame([(i, f"text {i % 40}") for i in range(200)]).select(
        F.col("doc_id").alias("_id"), exact_dedup.text_key(F.col("text")).alias("_key"), exact_dedup.text_digest(F.col("text")).alias("_digest"), F.col("text").alias("_text")).withColumn("_salt", exact_dedup.salt())
    directory, depth = exact_dedup.bucket_directory(texts, 8)
    assert directory.count() > 4
    with redirect_stdout(io.StringIO()) as plan:
        exact_dedup.chains(texts, directory, depth).explain()
    above = plan.getvalue().split("Exchange rangepartitioning")[0]
    assert "HashAggregate" in above and "Exchange" not in above
    assert exact_dedup.chains(texts, directory, depth).agg(F.count(F.lit(1)), F.sum("_size")).first()[:] == (40, 200)


def test_a_hot_text(frame):
    rows = [(i, "the hot text" if i % 2 else f"text {i}") for i in range(6000)] + [(7, "THE HOT TEXT")]
    got = exact_dedup.exact_duplicates(frame(rows))
    assert got.where("kept and group_size = 3001 and doc_id = 5999").count() == 1
    assert got.where("group_size = 3001").count() == 3001 and got.where("kept").count() == 3001


def test_directory_splits_until_buckets_fit(spark):
    entries = spark.range(3000).selectExpr("shiftrightunsigned(xxhash64(id), 2) as _key")
    directory, depth = exact_dedup.bucket_directory(entries, 50)
    rows = sorted((r.low, r.high, r["keys"]) for r in directory.collect())
    assert sum(r[2] for r in rows) == 3000 and max(r[2] for r in rows) <= 50
    assert all(a[1] < b[0] for a, b in zip(rows, rows[1:]))


def test_empty_table(frame):
    assert exact_dedup.exact_duplicates(frame([(1, "a")]).where("false")).count() == 0


def test_query_matches_sql(spark, con):
    assert compare(QUERIES["op8_exact_dedup"](spark, "/root/testdata/sf0.001").toPandas(), con.execute(ORACLES["op8_exact_dedup"]).df()) is None
