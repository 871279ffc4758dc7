from oracle import compare
from veriframe.llm import license_scan
from veriframe.llm.queries import ORACLES, QUERIES


def rows_of(frame_, lends="path like '%LICENSE'"):
    from pyspark.sql import functions as F

    return {(r.doc_id, r.path): (r.own_license, r.license, r.inherited_from) for r in license_scan.scan(frame_, F.expr(lends)).collect()}


def test_headers_and_inheritance(spark):
    mit, gpl = "// Released under the MIT License.", "This work is licensed under\nthe GNU General Public License, version 3."
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/c/x.py", "code only"), (3, "a/b/LICENSE", gpl), (4, "a/b/c/y.py", "x = 1\n# Licensed under CC BY-NC 4.0.\ny = 2"),
        (5, "d/z.py", "nothing"), (6, None, "nothing"), (7, "a/q.py", None), (8, "a/r.py", ""), (9, "ab/s.py", "the license of the version " * 5000),
        (10, "a/t.py", "prose " * 60 + mit), (2, "a/b/c/x.py", "code only"), (None, "a/u.py", "no id"),
    ]
    got = rows_of(spark.createDataFrame(rows, "doc_id int, path string, text string").selectExpr("*", "1 as license"))
    assert got[1, "a/LICENSE"] == ("MIT", "MIT", None)
    assert got[3, "a/b/LICENSE"][0] == "GPL-3.0"
    assert got[2, "a/b/c/x.py"] == (None, "GPL-3.0", "a/b")
    assert got[4, "a/b/c/y.py"] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None)
    assert got[5, "d/z.py"] == got[6, None] == got[9, "ab/s.py"] == (None, None, None)
    assert got[7, "a/q.py"] == got[8, "a/r.py"] == got[10, "a/t.py"] == got[None, "a/u.py"] == (None, "MIT", "a")


def test_empty_table(spark):
    assert rows_of(spark.createDataFrame([], "doc_id int, path string, text string")) == {}


def test_query_matches_sql(spark, con):
    assert compare(QUERIES["op2_license_scan"](spark, "/root/testdata/sf0.001").toPandas(), con.execute(ORACLES["op2_license_scan"]).df()) is None
