"""Building blocks against brute force, with one key holding most rows."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriframe.operators import evaluation, fraud, kernels, keyed, neighbours, passkeys, selection
from veriframe.schemas import CLASSES, FEATURES
from veriframe.session import scratch_dir
from veriframe.streaming import jobs

START = dt.datetime(2026, 1, 1)


def test_exact_quantiles_skewed(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(3000, 7.0), rng.lognormal(3, 2, 4000), [1e9, -5.0]])
    rows = spark.createDataFrame([("hot", float(v)) for v in values] + [("one", 3.5), ("two", 1.0), ("two", 2.0)], "k string, v double")
    wanted = [0.0, 0.05, 0.25, 0.5, 0.77, 0.95, 1.0]
    got = {(r["k"], round(r["probability"], 6)): r["quantile"] for r in keyed.exact_quantiles(rows, ["k"], "v", wanted).collect()}
    for p in wanted:
        assert got["hot", p] == pytest.approx(np.quantile(values, p), rel=1e-12)
        assert got["one", p] == 3.5 and got["two", p] == pytest.approx(1 + p)


def test_quantiles_weighted(spark):
    rows = spark.createDataFrame([(1.0, 5), (2.0, 1), (9.0, 4)], "v double, w bigint")
    got = {r["probability"]: r["quantile"] for r in keyed.exact_quantiles(rows, [], "v", [0.25, 0.5, 0.9], weight="w").collect()}
    flat = np.repeat([1.0, 2.0, 9.0], [5, 1, 4])
    assert all(got[p] == pytest.approx(np.quantile(flat, p)) for p in got)


def test_hash_rank_is_global(spark):
    rows = spark.range(5000).withColumn("k", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    ranked = keyed.hash_rank(rows, ["k"], F.md5(F.col("id").cast("string")), "id", "r").toPandas()
    for _, part in ranked.groupby("k"):
        assert sorted(part["r"]) == list(range(1, len(part) + 1))


def test_rolling_count_hot_address(spark):
    rng = np.random.default_rng(2)
    seconds = np.sort(rng.integers(0, 40 * 3600, 3000))
    rows = [(i, "hot" if i % 4 else f"ip{i % 50}", "FRAUD_GUARDRAIL_TRIGGERED", "BLOCKED", START + dt.timedelta(seconds=int(s))) for i, s in enumerate(seconds)]
    logs = spark.createDataFrame(rows, "log_id bigint, ip_address string, action string, outcome string, ts timestamp")
    got = {r["log_id"]: r["failures"] for r in fraud.rolling_failures(logs, "ip_address").collect()}
    for key in {r[1] for r in rows}:
        mine = [(r[0], (r[4] - START).total_seconds()) for r in rows if r[1] == key]
        for log_id, at in mine[::37]:
            assert got[log_id] == sum(at - 86400 <= s <= at for _, s in mine)


def test_rate_buckets_hot_key(spark):
    rng = np.random.default_rng(3)
    seconds = np.concatenate([np.sort(rng.integers(0, 5 * 3600, 4000)), [3600, 3600, 7200]])
    hits = spark.createDataFrame([(i, "hot" if i % 5 else "cold", START + dt.timedelta(seconds=int(s))) for i, s in enumerate(seconds)], "hit_id bigint, bucket string, ts timestamp")
    got = {r["hit_id"]: r["attempts"] for r in passkeys.rate_buckets(hits, 3, chunk_seconds=1800).collect()}
    for key in ("hot", "cold"):
        mine = sorted((int(s), i) for i, s in enumerate(seconds) if (i % 5 != 0) == (key == "hot"))
        opened, used = None, 0
        for at, hit in mine:
            if opened is None or at > opened + 300:
                opened, used = at, 0
            used += 1
            assert got[hit] == used


def test_near_duplicates_with_copies(spark):
    rng = np.random.default_rng(4)
    base = rng.uniform([50, 0.5, 0.5, 100, 100, 50], [50.6, 0.506, 0.506, 106, 100.6, 50.6], (250, 6))
    x = np.concatenate([base, np.repeat(base[:1], 90, axis=0), rng.uniform([0] * 6, [100, 1, 1, 300, 255, 127], (50, 6))])
    scores = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{f} double" for f in FEATURES))
    z = x / np.array([0.1, 0.001, 0.001, 1, 0.1, 0.1])
    z[:, 3] = np.log1p(x[:, 3]) / 0.01
    d = np.abs(z[:, None, :] - z[None, :, :]).max(axis=2)
    upper = np.triu_indices(len(x), 1)
    pairs = {r["kind"]: r["pairs"] for r in neighbours.near_duplicate_pairs(scores).collect()}
    assert sum(pairs.values()) == (d[upper] <= 1).sum()
    assert pairs["identical"] == 91 * 90 // 2 and pairs["compared"] > 0
    np.fill_diagonal(d, np.inf)
    row = neighbours.nearest_distance_quantiles(scores).first()
    expected = np.quantile(d.min(axis=1), [0, 0.01, 0.5])
    assert [row["min"], row["p01"], row["p50"]] == pytest.approx(list(expected))


def test_bootstrap_matches_row_resampling(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 400)
    a = np.where(rng.random(400) < 0.8, y, rng.integers(0, 3, 400))
    b = np.where(rng.random(400) < 0.7, y, rng.integers(0, 3, 400))
    rows = spark.createDataFrame([(CLASSES[i], CLASSES[j], CLASSES[k]) for i, j, k in zip(y, a, b)], "y string, a string, b string")
    got = evaluation.paired_bootstrap(rows, "y", "a", "b", repeats=2000).first()
    draws = []
    for _ in range(2000):
        i = rng.integers(0, 400, 400)
        draws.append((a[i] == y[i]).mean() - (b[i] == y[i]).mean())
    low, high = np.quantile(draws, [0.025, 0.975])
    assert abs(got["accuracy_difference_low"] - low) < 0.01 and abs(got["accuracy_difference_high"] - high) < 0.01


def test_coupling_minimises(spark):
    rng = np.random.default_rng(6)
    r = rng.uniform(0.05, 0.95, (50, 3))
    p = np.stack(kernels.couple_pairwise(r[:, 0], r[:, 1], r[:, 2]), axis=1)
    assert np.allclose(p.sum(axis=1), 1) and (p > 0).all()
    def cost(p, r):
        full = np.array([[0, r[0], r[1]], [1 - r[0], 0, r[2]], [1 - r[1], 1 - r[2], 0]])
        return sum((full[j, i] * p[i] - full[i, j] * p[j]) ** 2 for i in range(3) for j in range(3) if i != j)
    for k in range(50):
        for step in rng.normal(0, 0.02, (20, 3)):
            q = np.abs(p[k] + step)
            assert cost(p[k], r[k]) <= cost(q / q.sum(), r[k]) + 1e-12


def test_saved_model_and_batch_twin(spark, tmp_path):
    text = ["svm_type c_svc", "kernel_type rbf", "gamma 0.5", "nr_class 3", "total_sv 4", "rho 0.1 -0.2 0.3", "label 0 1 2", "probA -1 -1.5 -2", "probB 0.1 0 -0.1", "nr_sv 1 2 1", "SV",
            "1 2 1:0.5 2:0.5", "-1 0.5 1:0.1 3:0.9", "-0.5 1.5 2:0.7", "-2 -1 6:0.4 1:1"]
    path = tmp_path / "saved.model"
    path.write_text("\n".join(text))
    model = kernels.read_kernel_model(spark, str(path))
    assert model.pair_weights.tolist() == [[1, 2, 0], [-1, 0, 0.5], [-0.5, 0, 1.5], [0, -2, -1]]
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.random((40, 6)))], "request_id bigint, " + ", ".join(f"{f} double" for f in FEATURES))
    names = ["p_verified", "p_review", "p_rejected"]
    a = kernels.score_with_kernel(rows, model).orderBy("request_id").select(*names).toPandas().to_numpy()
    b = kernels.score_with_kernel_sql(rows, model, "request_id").orderBy("request_id").select(*names).toPandas().to_numpy()
    assert np.allclose(a, b, atol=1e-9) and np.allclose(a.sum(axis=1), 1)


def test_split_is_disjoint_and_stratified(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") < 100, "Rejected").otherwise("Verified").alias("target"))
    counts = {(r["target"], r["split"]): r["n"] for r in selection.stratified_split(rows, "k").groupBy("target", "split").agg(F.count("*").alias("n")).collect()}
    assert counts == {("Rejected", "train"): 70, ("Rejected", "validation"): 15, ("Rejected", "test"): 15, ("Verified", "train"): 630, ("Verified", "validation"): 135, ("Verified", "test"): 135}


def test_power_transform_recovers_log(spark):
    rng = np.random.default_rng(8)
    frame = spark.createDataFrame([(float(np.expm1(v)),) for v in rng.normal(3, 0.4, 3000)], "blur_score double")
    assert abs(selection.fit_power(frame, ("blur_score",))["blur_score"]) < 0.15


def test_state_carries_over_batches(spark):
    """Three files, one per micro-batch: results equal the batch twins."""
    folder = scratch_dir(spark, "hits")
    start = [(i, "b", START + dt.timedelta(seconds=70 * i)) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(start[k * 20:(k + 1) * 20], "hit_id bigint, bucket string, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("hit_id bigint, bucket string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    got = {(r["hit_id"], r["attempts"], r["allowed"]) for r in jobs.run_available(jobs.rate_verdicts(stream, 3), "rate-test").collect()}
    batch = spark.createDataFrame(start, "hit_id bigint, bucket string, ts timestamp")
    assert got == {(r["hit_id"], r["attempts"], r["allowed"]) for r in passkeys.rate_buckets(batch, 3).collect()}
    logs = stream.select(F.col("hit_id").alias("log_id"), F.col("bucket").alias("ip_address"), "ts")
    counts = {r["log_id"]: r["failures"] for r in jobs.run_available(jobs.failure_alerts(logs, "ip_address", hours=1), "alert-test").collect()}
    assert counts == {i: min(i, 51) + 1 for i in range(2, 60)}


def test_scratch_reads_the_cluster_setting(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert os.path.dirname(os.path.dirname(scratch_dir(spark, "x"))) == base


def test_rate_buckets_thousand_hits_a_second(spark):
    """One bucket at 1 000 hits a second for an hour: linear work per chunk."""
    hits = spark.range(3_600_000).selectExpr("id as hit_id", "'hot' as bucket", "timestamp_micros(1767225600000000 + id * 1000) as ts")
    rows = passkeys.rate_buckets(hits, 3)
    got = rows.groupBy("opened_at").agg(F.max("attempts").alias("n"), F.count(F.lit(1)).alias("c"), F.sum(F.col("allowed").cast("int")).alias("a")).collect()
    assert sum(r["c"] for r in got) == 3_600_000 and all(r["n"] == r["c"] and r["a"] == min(3, r["c"]) for r in got)
    assert sorted(r["c"] for r in got)[-1] == 300_001


def test_closing_times_match_walk():
    rng = np.random.default_rng(6)
    times = np.unique(rng.integers(0, 5000, 400))
    carried = np.concatenate([[-1], times[times <= 100]])
    got = passkeys._closing_times(times, carried, 100)
    for closes, out in zip(carried, got):
        openers = passkeys._openers(times, int(closes), 100)
        assert out == openers[-1] + 100


def test_nearest_distance_of_single_row(spark):
    one = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], ", ".join(f"{f} double" for f in FEATURES))
    assert [(r["distance"], r["w"]) for r in neighbours.nearest_distances(one).collect()] == [(None, 1)]


def test_quiet_keys_lose_their_state(spark):
    """State of a key goes once the watermark has passed its window; counts before that are right."""
    folder = scratch_dir(spark, "failures-in")
    rows = lambda lo, hi, key: [(i, key, START + dt.timedelta(minutes=10 * i)) for i in range(lo, hi)]
    schema = "log_id bigint, ip_address string, ts timestamp"
    for part, data in enumerate((rows(0, 5, "quiet"), rows(1000, 1005, "late"), rows(3000, 3001, "last"))):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    alerts = jobs.failure_alerts(stream, "ip_address")
    out, checkpoint = scratch_dir(spark, "failures-out"), scratch_dir(spark, "failures-state")
    run = alerts.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r["failures"] for r in spark.read.parquet(out).collect()) == [3, 3, 4, 4, 5, 5]
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_label_texts_are_normalised_once_and_a_verdict_searches_pages_once(spark, monkeypatch):
    """The filter that Spark derives from exploded labels held the normalised text once per label variant; a verdict searched pages five times."""
    from veriframe.operators import ocr

    items = spark.createDataFrame(
        [(1, "front", 0, "SURNAME", 0.9, 10.0, 110.0, 0.0, 20.0), (1, "front", 1, "OTIENO", 0.9, 130.0, 300.0, 0.0, 20.0)],
        "doc_id bigint, side string, item_no bigint, text string, confidence double, x_min double, x_max double, y_min double, y_max double")
    found = ocr.label_items(items)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("[^A-Z0-9]+") == 1
    assert [(r.label_key, r.label_no) for r in found.collect()] == [("surname", 0)]
    searches, search = [], ocr.values_near_labels
    monkeypatch.setattr(ocr, "values_near_labels", lambda *a: searches.append(1) or search(*a))
    zones = spark.createDataFrame([], "doc_id bigint, side string, valid boolean, document_number string, id_number_verified boolean, surname string, given_names string, full_names string, date_of_birth date, date_of_expiry date")
    known = spark.createDataFrame([(1, "Otieno", None, None)], "doc_id bigint, name string, id_number string, date_of_birth string")
    assert ocr.document_verdicts(items, zones, known, F.lit("2026-01-15").cast("date")).count() == 1 and len(searches) == 1
