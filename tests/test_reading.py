"""Database reading over JDBC and audit pages by rank directory."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from veriframe.operators import directory
from veriframe.schemas import TABLES
from veriframe.sources import readers

URL = "jdbc:derby:memory:veriframe;create=true"
DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def plan(frame):
    return frame._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def requests(spark):
    """Keys with a crowded stretch, wide gaps and a null."""
    keys = [*range(1000, 1800), *range(10**6, 10**9, 10**7), None]
    rows = [(k, i % 7, i, ("review", "verified", "pending")[i % 3], dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i)) for i, k in enumerate(keys)]
    frame = spark.createDataFrame(rows, TABLES["verification_requests"])
    frame.write.option("createTableColumnTypes", "status VARCHAR(20)").jdbc(URL, "verification_requests", "overwrite", DRIVER)
    return rows


def test_ranges_take_every_row_once(spark, requests):
    got = readers.read_table_jdbc(spark, "verification_requests", URL, "request_id", 8, **DRIVER)
    assert got.schema == TABLES["verification_requests"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(requests, key=str)
    sizes = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * sum(sizes) / 8


def test_filters_reach_the_database(spark, requests):
    for extra in ({}, {"partition_column": "request_id", "partitions": 4}):
        got = readers.read_table_jdbc(spark, "verification_requests", URL, **extra, **DRIVER).where("status = 'review' and agent_id = 3").select("request_id")
        assert "*EqualTo(agent_id,3)" in plan(got) and "ReadSchema: struct<request_id:bigint,status:string>" in plan(got)
        assert got.count() == sum(r[3] == "review" and r[1] == 3 for r in requests)


def test_empty_table_and_few_keys(spark, requests):
    none = spark.createDataFrame([], TABLES["verification_requests"])
    none.write.jdbc(URL, "no_requests", "overwrite", DRIVER)
    assert readers.read_table_jdbc(spark, "verification_requests", URL, "request_id", 8, table="no_requests", **DRIVER).count() == 0
    spark.createDataFrame(requests[:1] * 3, TABLES["verification_requests"]).write.jdbc(URL, "one_key", "overwrite", DRIVER)
    assert readers.read_table_jdbc(spark, "verification_requests", URL, "request_id", 8, table="one_key", **DRIVER).count() == 3


def test_arrays_are_read_from_text(spark):
    row = (1, "u", "c", "k", 3, '["usb","nfc"]', "multiDevice", True, "l", None, None)
    columns = ", ".join(f"{f.name} {'string' if f.name == 'transports' else f.dataType.simpleString()}" for f in TABLES["passkeys"].fields)
    spark.createDataFrame([row, (2, *row[1:5], "ble, usb", *row[6:])], columns).write.jdbc(URL, "passkeys", "overwrite", DRIVER)
    got = readers.read_table_jdbc(spark, "passkeys", URL, **DRIVER)
    assert got.schema == TABLES["passkeys"] and {r.id: r.transports for r in got.collect()} == {1: ["usb", "nfc"], 2: ["ble", "usb"]}


@pytest.fixture(scope="module")
def logs(spark):
    """A third of the rows in one moment, some without a time."""
    rng, start = random.Random(2), dt.datetime(2025, 12, 1)
    rows = []
    for i in range(600):
        moment = start if i % 3 == 0 else None if i % 50 == 1 else start + dt.timedelta(seconds=rng.randrange(-10**6, 10**6))
        rows.append((i, i % 5, None, "LOGIN", "success", None, "system", None, None, moment))
    return spark.createDataFrame(rows, TABLES["audit_logs"]).repartition(4), rows


@pytest.mark.parametrize("part_rows", [1, 40, 100_000])
@pytest.mark.parametrize("page,size", [(1, 20), (4, 50), (9, 50), (12, 50), (31, 20), (13, 50)])
def test_pages(spark, logs, part_rows, page, size):
    frame, rows = logs
    agents = spark.createDataFrame([(1, "A")], "agent_id bigint, full_name string")
    got = directory.audit_page(frame, agents, page, size, part_rows).collect()
    order = sorted(rows, key=lambda r: (r[-1] is not None, r[-1] or dt.datetime.min, r[0]), reverse=True)
    want = order[(page - 1) * size: page * size]
    assert {r.log_id for r in got} == {r[0] for r in want} and all(r.total == 600 for r in got)


def test_late_page_orders_a_part_only(spark, logs):
    agents = spark.createDataFrame([(1, "A")], "agent_id bigint, full_name string")
    text = plan(directory.audit_page(logs[0], agents, 25, 20, 60))
    assert "ts" in text and ">= 20" in text.replace("2025", "20") and directory.audit_page(logs[0].where("false"), agents).count() == 0


def test_unlabelled_dates_are_parsed_once_for_each_text(spark):
    """The date of a text is a column of its own; the filters and the result do not parse it again."""
    from veriframe.operators import ocr

    texts = {1: ["NAME", "12.", "03.", "1990", "ID 12345678"], 2: ["01.02.1980", "05.06.2031"], 3: ["01.02.1980", "03.04.1981"], 4: ["12345"], 5: ["7 / 8 / 1970"]}
    items = spark.createDataFrame([(d, "front", i, t) for d, page in texts.items() for i, t in enumerate(page)], "doc_id bigint, side string, item_no int, text string")
    expiries = spark.createDataFrame([(d, "front", "05.06.2031") for d in texts], "doc_id bigint, side string, date_of_expiry string")
    found = ocr.unlabelled_birth_dates(items, expiries, F.lit(dt.date(2026, 1, 15)))
    assert {(r.doc_id, r.value, str(r.born)) for r in found.collect()} == {(1, "NAME 12. 03. 1990", "1990-03-12"), (2, "01.02.1980", "1980-02-01"), (5, "7 / 8 / 1970", "1970-08-07")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("yyyy-M-d") <= 3
