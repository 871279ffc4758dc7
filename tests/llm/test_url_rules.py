import random
import re
from collections import Counter

import pytest

from veriframe.llm import url_rules
from veriframe.llm.queries import ORACLES, QUERIES, URL_RULES

LOWER = str.maketrans(url_rules.UPPER, url_rules.LOWER)


def brute(urls, rules, default="allow"):
    out = Counter()
    for page_id, url in urls:
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(LOWER)
        fitting = [
            (len(h + p), len(h), v == "block", h + p, v) for h, p, v in ((h.translate(LOWER), p, v) for h, p, v in rules if None not in (h, p, v))
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        best = max(fitting, default=(0, 0, 0, None, default))
        out[page_id, host, path, best[3], best[4]] += 1
    return out


def got(rows):
    return Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows)


def urls_of(seed, n):
    rng = random.Random(seed)
    hosts = ["a.b.c", "b.c", "c", "A.b.C", "x.b.c", "bc", "", "a..c", ".c", "c.", "d.e", "e", "z.y.x.b.c:80"]
    hosts += ["a.b.c"] * 6  # a hot host
    tails = ["", "/", "/en/", "/en/x?q=/de/", "/EN/", "#/en/", "?a://b", "/de//", "//", "/e"]
    urls = [(i, rng.choice(["http://", "://", "", "x"]) * (rng.random() < 0.95) + rng.choice(hosts) + rng.choice(tails)) for i in range(n)]
    return urls + [(1, None), (None, "http://c/en/"), (2, ""), (3, "http://" + "a." * 5000 + "c/" + "p" * 20000)] + [(7, "http://b.c/en/1")] * (n // 2)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_against_brute_force(spark, ranges):
    urls = urls_of(ranges, 400)
    rng = random.Random(5)
    rules = [(rng.choice(["c", "b.c", "a.b.c", "B.C", "e", "", "c.", "y.x.b.c"]), rng.choice(["", "/", "/e", "/en/", "/en/x", "/d"]), rng.choice(["allow", "block"])) for _ in range(30)]
    rules += [(None, "/", "block"), ("c", None, "block"), ("c", "/", None)]
    pages = spark.createDataFrame(urls, "page_id bigint, url string").selectExpr("*", "'h' as host", "1 as key", "2 as range").repartition(5)
    result = url_rules.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), ranges=ranges)
    assert got(result.collect()) == brute(urls, rules)


def test_empty_tables_and_default(spark):
    pages = spark.createDataFrame([("p", "http://a/b")], "page_id string, url string")
    rules = spark.createDataFrame([("a", "/", "block")], "host string, path string, verdict string")
    assert url_rules.judge_urls(pages.where("false"), rules).count() == 0
    assert [tuple(r) for r in url_rules.judge_urls(pages, rules.where("false"), default="block").collect()] == [("p", "a", "/b", None, "block")]
    assert [tuple(r) for r in url_rules.judge_urls(pages, rules).collect()] == [("p", "a", "/b", "a/", "block")]


def test_many_paths_of_one_host(spark):
    rules = [("h", f"/{i}", "block") for i in range(300)]
    urls = [(i, f"http://s.h/{i}/x") for i in range(0, 600, 7)]
    result = url_rules.judge_urls(spark.createDataFrame(urls, "page_id bigint, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"), ranges=9)
    assert got(result.collect()) == brute(urls, rules)


def test_query(spark, con):
    urls = con.execute("select page_id, url from pages").fetchall()
    rows = QUERIES["op13_url_rules"](spark, "/root/testdata/sf0.001").collect()
    assert got(rows) == brute(urls, URL_RULES)
    want = con.execute(f"select page_id, host, path, rule, verdict from ({ORACLES['op13_url_rules']})").fetchall()
    assert got(rows) == Counter(want)
