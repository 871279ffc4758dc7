"""Literal cases of the decision, time, text and zone rules."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from veriframe.functions import clock, mrz, text
from veriframe.functions.scores import score_errors, threshold_decision, with_json_score_errors
from veriframe.operators import decisions, directory, fraud, ocr, passkeys, selection, trail
from veriframe.operators import mrz as zones
from veriframe.schemas import FEATURES

VALID = [84.5, 0.93, 0.88, 72.0, 181.0, 46.0]
SCORES = ", ".join(f"{f} double" for f in FEATURES)


def utc(value):
    return dt.datetime.fromisoformat(value)


def test_window_expiry(spark):
    cases = {
        "2026-10-02 10:00": "2026-10-07 10:00", "2026-10-03 10:00": "2026-10-07 10:00", "2026-10-05 10:00": "2026-10-08 10:00",
        "2026-12-31 22:00": "2027-01-05 22:00",
    }
    rows = spark.createDataFrame([(utc(a), utc(b)) for a, b in cases.items()], "a timestamp, b timestamp")
    assert all(r[0] == r[1] for r in rows.select(clock.audit_expiry(F.col("a")), "b").collect())


def test_window_boundary(spark):
    row = spark.createDataFrame([("verified", "verified", utc("2026-10-02 10:00"))], "s string, f string, t timestamp")
    def is_open(now):
        return row.select(clock.audit_window(F.col("s"), F.col("f"), F.col("t"), clock.at(now))[2]).first()[0]
    assert is_open("2026-10-02 10:00:00") and is_open("2026-10-07 09:59:59") and not is_open("2026-10-07 10:00:00")


def test_number_errors(spark):
    bad = [None, float("nan"), float("inf"), -1.0]
    rows = [tuple(b if k == i else v for k, v in enumerate(VALID)) for i, b in itertools.product(range(6), bad)]
    frame = spark.createDataFrame(rows, SCORES)
    assert frame.where(F.size(score_errors()) != 1).count() == 0
    fine = spark.createDataFrame([tuple(VALID), (84.5, 0.93, 0.88, 1800.0, 255.0, 127.5)], SCORES)
    assert fine.where(F.size(score_errors()) > 0).count() == 0
    over = [(101.0, *VALID[1:]), (VALID[0], 1.01, *VALID[2:]), (*VALID[:2], 1.01, *VALID[3:]), (*VALID[:4], 256.0, VALID[5]), (*VALID[:5], 128.0)]
    assert spark.createDataFrame(over, SCORES).where(F.size(score_errors()) != 1).count() == 0


def test_json_errors(spark):
    good = '{"face_match_score":84.5,"livenessScore":0.93,"ocr_confidence_score":0.88,"blur_score":1800,"brightness_score":181,"contrast_score":46}'
    cases = {
        good: [], "[1]": ["Request body must be a JSON object"], good.replace("84.5", "true"): ["face_match_score must be a number"],
        good.replace("84.5", '"84.5"'): ["face_match_score must be a number"], good.replace("84.5", "null"): ["face_match_score is required"],
        good.replace("}", ',"zeta":1,"alpha":2}'): ["Unknown score fields: alpha, zeta"], good.replace("0.93", "1.01"): ["liveness_score must be in [0, 1]"],
        good.replace("}", ',"liveness_score":0.5}'): ["Provide only one of liveness_score and livenessScore"],
    }
    rows = with_json_score_errors(spark.createDataFrame([(b,) for b in cases], "body string")).collect()
    assert {r["body"]: r["errors"] for r in rows} == cases


@pytest.mark.parametrize("scores, expected", [
    ((80.0, 0.76, 0.71, 90.0), "review"), ((80.1, 0.76, 0.71, 90.0), "verified"), ((90.0, 0.75, 0.71, 90.0), "review"),
    ((90.0, 0.76, 0.7, 90.0), "review"), ((50.0, 0.5, 0.4, 90.0), "review"), ((49.9, 0.9, 0.9, 90.0), "rejected"),
    ((64.9, 0.9, 0.9, 79.9), "rejected"), ((65.0, 0.9, 0.9, 10.0), "review"),
])
def test_threshold_limits(spark, scores, expected):
    row = spark.createDataFrame([(*scores, 100.0, 40.0)], SCORES)
    assert row.select(threshold_decision()).first()[0] == expected


def test_model_first(spark):
    scores = spark.createDataFrame([(k, *VALID) for k in (1, 2, 3)], "request_id bigint, " + SCORES)
    model = spark.createDataFrame(
        [(1, True, "svm_model", "review", 0.2, 0.7, 0.1, "9.9"), (2, True, "svm_model", "review", 0.2, 0.7, 0.2, "9.9"), (3, False, None, None, None, None, None, None)],
        "request_id bigint, available boolean, decision_basis string, final_decision string, verified_probability double, review_probability double, "
        "rejected_probability double, model_version string")
    rows = {r["request_id"]: r for r in decisions.decide_model_first(scores, model).collect()}
    assert (rows[1]["final_decision"], rows[1]["decision_basis"], rows[1]["review_probability"]) == ("review", "svm_model", 0.7)
    assert rows[1]["reasons"] == ["SVM classifier v9.9 predicted Manual Review with 70.0% probability"]
    assert rows[2]["fallback_reason"] == "SVM returned an invalid prediction" and rows[2]["final_decision"] == "verified"
    assert rows[3]["decision_basis"] == "placeholder_threshold"


def test_policy_leaves_probabilities(spark):
    row = spark.createDataFrame([(0.55, 0.35, 0.1)], "p_verified double, p_review double, p_rejected double")
    label = lambda *a: row.select(selection.decide_policy(*a)).first()[0]
    assert label(1.0, 0.0, 0.0) == "Verified" and label(1.0, 0.6, 0.0) == "Manual Review" and label(1.0, 0.0, 0.3) == "Manual Review"


def test_document_dates(spark):
    good = ["01.01.1990", "1.12.2001", "01. 01. 1990", "01 / 01 / 1990", "x 01_01'1990 y"]
    bad = ["1990-01-01", "not a date", "32.01.1990", "31.02.1990", "101.01.1990"]
    rows = spark.createDataFrame([(v,) for v in good + bad], "v string").select("v", text.document_date(F.col("v")).alias("d")).collect()
    assert [r["v"] for r in rows if r["d"] is not None] == good
    iso = spark.createDataFrame([("1990-02-03",), ("03/02/1990",), ("junk",)], "v string").select(text.registered_date(F.col("v"))).collect()
    assert [r[0] for r in iso] == [dt.date(1990, 2, 3), dt.date(1990, 2, 3), None]


def test_date_problems(spark):
    today = F.lit("2026-01-15").cast("date")
    row = spark.range(1)
    problem = lambda f, d: row.select(f(F.lit(d).cast("date"), today)).first()[0]
    assert problem(text.birth_date_problem, "2026-01-16") == "Date of birth is in the future"
    assert problem(text.birth_date_problem, "1900-01-01") == "Date of birth implies age over 120"
    assert problem(text.birth_date_problem, "1990-01-01") is None
    assert problem(text.expiry_problem, "2026-01-14") == "Document has expired" and problem(text.expiry_problem, "2026-01-15") is None


def test_names(spark):
    cases = [
        ("AMINA OTIENO", "Amina Otieno Wanjiru", True), ("OTIENO AMINA", "  amina   otieno ", True), ("AMINA OTIENO WANJIRU", "Amina Otieno", True),
        ("AMINA OTIENO", "Amina Peter", False), ("AMINA OTIENO WANJIRU", "Amina Otieno Peter", False), ("AMINA OTIENO", "Amina Amina", False),
        ("AMINA", "Amina Otieno", False), ("AMINA OTIENO", "Am Otieno", False), ("AMINAOTIENO", "Amina Otieno", False), ("AMINA OTIENO", "", False),
        ("", "", False), ("ANNE-MARIE OTIENO", "Anne Marie Otieno", True),
    ]
    rows = spark.createDataFrame([(k, a, "12-345678", dt.date(1990, 1, 1), b, "12345678", "1990-01-01", e) for k, (a, b, e) in enumerate(cases)],
                                 "k int, a string, i string, d date, b string, ri string, rd string, e boolean")
    got = text.with_identity_match(rows, "a", "i", "d", "b", "ri", "rd").collect()
    assert all(r["name_match"] == r["e"] and r["matched"] == r["e"] and r["id_match"] and r["dob_match"] for r in got)
    assert all(r["confidence"] == 1.0 for r in got if r["e"])


def test_fuzzy_title(spark):
    cases = {"NATIONAL IDENTITY CARD": True, "ONALIDENTIY CARD": True, "REPUBLIC NATI0NAL IDENTTY CARD KENYA": True, "LIBRARY CARD": False, "": False}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.has_phrase(text.normal_label(F.col("t")), text.NEW_CARD_PHRASES[0])).collect()
    assert {r[0]: r[1] for r in rows} == cases


def item(number, words, x, y, width=100, side="front", doc=1):
    return (doc, side, number, words, 0.9, float(x), float(x + width), float(y), float(y + 20))


ITEMS = "doc_id bigint, side string, item_no int, text string, confidence double, x_min double, x_max double, y_min double, y_max double"


def test_fields_near_labels(spark):
    page = [
        item(0, "SURNAME", 10, 0), item(1, "OTIENO", 150, 2), item(2, "GIVEN NAMES", 10, 40), item(3, "AMINA GRACE", 12, 66), item(4, "ID NUMBER: 23456789", 10, 120, 200),
        item(5, "DATE OF", 10, 160, 50), item(6, "BIRTH", 65, 160, 50), item(7, "01.", 150, 160, 20), item(8, "02. 1990", 175, 161, 60), item(9, "DATE OF EXPIRY", 10, 220), item(10, "03.04.2031", 150, 220),
    ]
    items = spark.createDataFrame(page, ITEMS)
    types = ocr.document_types(items)
    assert types.first()["document_type"] == "id_v2_surname_given"
    found = {r["field"]: r["value"] for r in ocr.values_near_labels(items, ocr.wanted_fields(types)).collect()}
    assert found == {"surname": "OTIENO", "given_names": "AMINA GRACE", "id_number": "23456789", "date_of_birth": "01. 02. 1990", "date_of_expiry": "03.04.2031"}


def test_verdicts(spark):
    def card(doc, back, expiry="03.04.2031"):
        rows = [item(0, "SURNAME", 10, 0, doc=doc), item(1, "OTIENO", 150, 0, doc=doc), item(2, "GIVEN NAMES", 10, 40, doc=doc), item(3, "AMINA", 150, 40, doc=doc),
                item(4, "ID NUMBER", 10, 80, doc=doc), item(5, "23456789", 150, 80, doc=doc), item(6, "DATE OF BIRTH", 10, 120, doc=doc), item(7, "01.02.1990", 150, 120, doc=doc),
                item(8, "DATE OF EXPIRY", 10, 160, doc=doc), item(9, expiry, 150, 160, doc=doc)]
        if back:
            rows += [item(0, "ID NUMBER", 10, 0, side="back", doc=doc), item(1, back, 150, 0, side="back", doc=doc)]
        return rows
    pages = card(1, "23456789") + card(2, "99956789") + card(3, None) + card(4, "KEN234567894", "03.04.2020") + [item(0, "LIBRARY CARD", 10, 0, doc=5)]
    items = spark.createDataFrame(pages, ITEMS)
    known = spark.createDataFrame([(k, "Amina Otieno", "23456789", "1990-02-01") for k in range(1, 6)], "doc_id bigint, name string, id_number string, date_of_birth string")
    none = zones.parse_zones(items.withColumn("y", F.col("y_min")), 2026, ("doc_id", "side"))
    rows = {r["doc_id"]: r for r in ocr.document_verdicts(items, none, known, F.lit("2026-01-15").cast("date")).collect()}
    assert rows[1]["matched"] and rows[1]["confidence"] == 1.0 and rows[1]["reject_reason"] is None and not rows[1]["needs_manual_review"]
    assert rows[2]["reject_reason"] == "ID number on the back does not match the front" and rows[2]["confidence"] == 0.0
    assert rows[3]["reject_reason"].endswith(": id_back") and rows[3]["needs_manual_review"] and rows[3]["front_back_match"] is None
    assert rows[4]["document_expired"] and rows[4]["reject_reason"] == "Document has expired" and rows[4]["front_back_match"]
    assert rows[5]["needs_retake"] and rows[5]["document_type"] is None


def test_check_digits(spark):
    cases = {"L898902C3": "6", "740812": "2", "120415": "9", "D23145890": "7"}  # public samples of the zone standard
    rows = spark.createDataFrame([(k,) for k in cases], "f string").select("f", mrz.check_digit(F.col("f"), 9)).collect()
    assert {r[0]: r[1] for r in rows} == cases


def test_sample_passport_zone(spark):
    lines = ["P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"]  # public sample
    items = spark.createDataFrame([(1, n, t, float(n)) for n, t in enumerate(lines)], "doc_id bigint, item_no int, text string, y double")
    row = zones.parse_zones(items, 2026).first()
    assert (row["format"], row["document_number"], row["surname"], row["given_names"], row["valid"], row["checks_passed"]) == ("TD3", "L898902C3", "ERIKSSON", "ANNA MARIA", True, 3)
    assert row["date_of_birth"] == dt.date(1974, 8, 12) and row["date_of_expiry"] == dt.date(2012, 4, 15)


def test_rate_bucket_literal(spark):
    start = utc("2026-01-01 00:00:00")
    seconds = [0, 10, 20, 300, 301]
    hits = spark.createDataFrame([(k, "a", start + dt.timedelta(seconds=s)) for k, s in enumerate(seconds)], "hit_id bigint, bucket string, ts timestamp")
    got = {r["hit_id"]: (r["attempts"], r["allowed"]) for r in passkeys.rate_buckets(hits, 2).collect()}
    assert got == {0: (1, True), 1: (2, True), 2: (3, False), 3: (4, False), 4: (1, True)}


def test_challenges_and_removals(spark):
    start = utc("2026-01-01 00:00:00")
    challenges = spark.createDataFrame([(1, "login", None, start + dt.timedelta(minutes=5))], "id bigint, purpose string, user_id string, expires_at timestamp")
    uses = spark.createDataFrame([(1, 1, "login", None, start), (2, 1, "login", None, start + dt.timedelta(seconds=1)), (3, 9, "login", None, start)],
                                 "use_id bigint, challenge_id bigint, purpose string, user_id string, used_at timestamp")
    assert {r["use_id"]: r["outcome"] for r in passkeys.consume_challenges(uses, challenges).collect()} == {1: "ok", 2: "missing", 3: "missing"}
    keys = spark.createDataFrame([(1, "u", "c1", 0), (2, "v", "c2", 0), (3, "v", "c3", 5)], "id bigint, user_id string, credential_id string, counter bigint")
    methods = spark.createDataFrame([("u", "", False), ("v", "", False)], "user_id string, encrypted_password string, has_identity boolean")
    asked = spark.createDataFrame([(1, "u", 1), (2, "v", 2), (3, "u", 2)], "removal_id bigint, owner_id string, passkey_id bigint")
    assert {r["removal_id"]: r["verdict"] for r in passkeys.removal_verdicts(asked, keys, methods).collect()} == {1: "last_method", 2: "removed", 3: "not_found"}
    seen = spark.createDataFrame([(1, 1, 0, start), (2, 3, 5, start), (3, 3, 6, start + dt.timedelta(days=1)), (4, 3, 6, start + dt.timedelta(days=2))],
                                 "use_id bigint, passkey_id bigint, new_counter bigint, ts timestamp")
    assert {r["use_id"]: r["rejected"] for r in passkeys.counter_regressions(seen, keys).collect()} == {1: False, 2: True, 3: False, 4: True}


def test_reset_among_all_or_newest(spark):
    start = utc("2026-01-01 00:00:00")
    step = dt.timedelta(minutes=1)
    strike, reset, plain = '{"guardrailType":"verification_strike"}', '{"strikesReset":true}', "{}"
    def logs(approvals):
        rows = [(0, 1, "FRAUD_GUARDRAIL_TRIGGERED", strike, start), (1, 1, "ADMIN_APPROVED", reset, start + step)]
        return spark.createDataFrame(rows + [(2 + k, 1, "ADMIN_APPROVED", plain, start + (2 + k) * step) for k in range(approvals)],
                                     "log_id bigint, agent_id bigint, action string, details string, ts timestamp")
    assert fraud.strike_counts(logs(49), "2026-01-01 02:00:00").count() == 0
    assert fraud.strike_counts(logs(50), "2026-01-01 02:00:00").count() == 0
    assert fraud.last_resets(logs(49), newest=50).count() == 1 and fraud.last_resets(logs(50), newest=50).count() == 0


def test_purge_plan_literal(spark):
    decided = utc("2026-10-02 10:00:00")
    hour = dt.timedelta(hours=1)
    requests = spark.createDataFrame([(1, 1, 1, "verified", decided - hour), (2, 2, 2, "review", decided - hour)], "request_id bigint, agent_id bigint, document_id bigint, status string, created_at timestamp")
    final = spark.createDataFrame([(1, "verified", decided), (2, "review", decided)], "request_id bigint, final_decision string, decided_at timestamp")
    documents = spark.createDataFrame([(1, 1, "id_front", "1/documents/a.jpg", decided - hour), (2, 1, "selfie", "2/selfies/b.jpg", decided - hour), (3, 1, "id_back", "1/../c.jpg", decided - hour)],
                                      "document_id bigint, agent_id bigint, document_type string, file_url string, uploaded_at timestamp")
    files = spark.createDataFrame([(1, "documents", "old.jpg", decided - hour), (1, "documents", "new.jpg", decided + hour)], "agent_id bigint, folder string, file_name string, modified_at timestamp")
    at = lambda now: {(r["kind"], r["path"]) for r in trail.purge_plan(requests, final, documents, files, now).collect()}
    assert at("2026-10-07 09:59:59") == set()
    assert at("2026-10-07 10:00:00") == {("file", "1/documents/old.jpg"), ("file", "1/documents/a.jpg"), ("row", "1/documents/a.jpg")}
    plan = trail.purge_plan(requests, final, documents, files, "2026-10-07 10:00:00")
    failed = spark.createDataFrame([(1, "1/documents/old.jpg", False)], "agent_id bigint, path string, removed boolean")
    assert trail.rows_to_blank(plan, failed).count() == 0


def test_dob_and_search(spark):
    now = clock.at("2026-01-15 00:00:00")
    cases = {"1990-01-01": None, "1990-02-30": None, "1990-13-01": "Enter a valid date of birth", "2020-01-01": "You must be at least 18 years old", "": "Date of birth is required",
             "2027-01-01": "Date of birth must be in the past", "1900-01-01": "Enter a valid date of birth", " 1990-01-01 ": None}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", directory.date_of_birth_error(F.col("v"), now)).collect()
    assert {r[0]: r[1] for r in rows} == cases


def test_every_document_gets_a_verdict(spark):
    """A front of low confidence, a back alone and a document without items ask for a new photo."""
    columns = "doc_id bigint, side string, item_no bigint, text string, confidence double, x_min double, y_min double, x_max double, y_max double"
    items = spark.createDataFrame([
        (1, "front", 1, "SURNAME", 0.2, 0.0, 0.0, 10.0, 5.0), (2, "back", 1, "ID NUMBER 12345678", 0.9, 0.0, 0.0, 10.0, 5.0),
    ], columns)
    known = spark.createDataFrame([(i, "A B", "12345678", "1990-01-01") for i in (1, 2, 3)], "doc_id bigint, name string, id_number string, date_of_birth string")
    from veriframe.operators import mrz as zones

    none = zones.parse_zones(items.where("false").select("doc_id", "side", "item_no", "text", F.col("y_min").alias("y")), 2026, ("doc_id", "side"))
    rows = {r["doc_id"]: r for r in ocr.document_verdicts(items, none, known, F.lit("2026-01-15").cast("date")).collect()}
    assert set(rows) == {1, 2, 3}
    assert all(r["needs_retake"] and not r["matched"] and r["reject_reason"] == ocr.NOT_FOUND for r in rows.values())


def test_phrase_search_is_linear(spark):
    """Long pages with damaged titles are found, and time follows the length."""
    import time

    prose = lambda n: "LOREM IPSUM DOLOR SIT AMET " * (n // 27)
    cases = [(prose(2000) + "NATIONAL 1DENTITY CARD" + prose(2000), True), (prose(4000), False), ("NATONAL IDENTTY CARD", True), ("KITAMBULISHO", False)]
    rows = spark.createDataFrame(cases, "t string, want boolean").coalesce(1)
    assert all(r["got"] == r["want"] for r in rows.select("want", text.has_phrase(text.normal_label(F.col("t")), text.NEW_CARD_PHRASES[0]).alias("got")).collect())

    def seconds(n):
        pages = spark.range(40).select(F.concat(F.lit(prose(n)), F.col("id").cast("string")).alias("t")).coalesce(1)
        found = pages.select(text.has_phrase(text.normal_label(F.col("t")), text.NEW_CARD_PHRASES[0]).alias("f")).agg(F.count_if("f"))
        found.collect()
        start = time.time()
        found.collect()
        return time.time() - start

    assert seconds(32_000) < 1 + 40 * seconds(2_000)


def test_texts_keep_their_spaces_unless_trimmed(spark):
    page = [("PASSPORT NO", 0, 0), ("SURNAME", 0, 60), ("KIPTOO", 130, 60), ("GIVEN NAMES", 0, 120), (" p<ken JANE", 130, 120), ("  ", 0, 180)]
    items = spark.createDataFrame([item(i, *line) for i, line in enumerate(page)], ITEMS)
    for trimmed, name in ((False, " p<ken JANE"), (True, "p<ken JANE")):
        rows = ocr.usable_items(items, trimmed=trimmed)
        assert rows.count() == 5
        found = {r["field"]: r["value"] for r in ocr.values_near_labels(rows, ocr.wanted_fields(ocr.document_types(rows))).collect()}
        assert found["given_names"] == name


def test_damaged_fragments_of_a_title_are_found(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    phrase = text.NEW_CARD_PHRASES[0]
    needle = phrase.replace(" ", "")
    allowed, rng = max(1, round(len(needle) * 0.15)), __import__("random").Random(5)
    samples = set()
    for _ in range(150):
        start, size = rng.randrange(0, 9), rng.randrange(9, len(needle) + 2)
        part = list(needle[start: start + size])
        for _ in range(rng.randrange(0, allowed + 3)):
            at = rng.randrange(len(part))
            part[at: at + 1] = rng.choice([[], ["X"], [part[at], "Q"]])
        samples.add("".join(part))
    rows = spark.createDataFrame([(s,) for s in sorted(samples)], "t string")
    got = {r.t: r.f for r in rows.select("t", text.has_phrase(F.col("t"), phrase).alias("f")).collect()}
    parts = {needle[a: b] for a in range(len(needle)) for b in range(a + 2, len(needle) + 1)}
    inside = lambda s: any(distance(s[i: i + w], needle) <= allowed for w in range(len(needle) - allowed, len(needle) + allowed + 1) for i in range(len(s) - w + 1))
    fragment = lambda s: 0.6 * len(needle) <= len(s) <= len(needle) + allowed and any(abs(len(p) - len(s)) <= allowed and distance(p, s) <= allowed for p in parts)
    assert got == {s: bool(s) and (needle in s or inside(s) or fragment(s)) for s in samples}
    assert 20 < sum(got.values()) < len(got) - 20


def test_small_fact_tables_are_dealt_over_all_cores(spark):
    from veriframe.bindings import BoundTables

    facts = BoundTables(spark, "/root/testdata/sf0.001").identity_facts
    assert facts.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
