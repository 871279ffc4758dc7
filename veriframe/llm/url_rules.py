"""URL filters: rules on hosts and paths, found by a sort-merge range join with a stack of nested rules.

A host's labels in reversed order, each closed by a dot, are its canonical key, so a rule covers the interval of keys that start
with its own: its host and all subdomains. Intervals nest or are disjoint. Rules and urls are dealt by key ranges and sorted by
key inside a range; one sweep keeps the stack of rules whose interval is open and judges each url by the rules on the stack whose
path its path starts with. The longest rule wins (host and path together; of equal ones the one with the longer host).

Cut points come from a bounded sample of (key, place) pairs, spread by a hash that includes the row's place in its scan, so
a host or a url with a third of the rows is cut as well. A range gets the rules that begin in it, and those open at its first
key: there are at most as many hosts of these as the key has labels. Ranges stream through the sweep; only the stack is held.

A url that is null or without ``://`` has an empty host and path; hosts are lower-cased (A-Z). No rule fits: ``rule`` is null
and ``verdict`` the default, ``allow`` unless another is given. Rules with a null host, path or verdict are left out; of rules
equal in host and path a block wins. Repeated rows stay. Empty tables of urls give no rows, empty tables of rules the default.
Only the id and url column are read.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import functions as F

SAMPLE_PER_RANGE = 16  # balances the ranges; results do not depend on it
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url):
    """Lower-cased host and path of a url column; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical_key(host):
    """Labels in reversed order, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def enclosing(key):
    """A key and those of the hosts that enclose it, outermost first."""
    ends = [i + 1 for i, c in enumerate(key) if c == "."]
    return [key[:e] for e in ends]


def _ranged(batches, cuts, schema):
    """Adds the number of the range that holds (key, place)."""
    for batch in batches:
        places = zip(batch.column("key").to_pylist(), batch.column("place").to_pylist())
        numbers = pa.array([bisect_right(cuts, place) for place in places], pa.int32())
        yield pa.RecordBatch.from_arrays([numbers, *batch.columns], schema=schema)


def _sweep(batches, default, schema):
    """Judge the urls of sorted ranges; rules of a key come before its urls."""
    current, stack = None, []  # stack: (key, [(length, path, rule, verdict)])
    for batch in batches:
        out = []
        for number, key, path, rule, verdict, host in zip(*(batch.column(c).to_pylist() for c in ("range", "key", "path", "rule", "verdict", "host"))):
            if number != current:
                current, stack = number, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if verdict is not None:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}))
                stack[-1][1].setdefault(path, (rule, verdict))
                continue
            best = None
            for depth, (_, rules) in enumerate(stack):
                for prefix in _prefixes(path, rules):
                    text, own = rules[prefix]
                    if best is None or (len(text), depth) > best[0]:
                        best = (len(text), depth), text, own
            out.append((host, path, best[1] if best else None, best[2] if best else default))
        pages = batch.filter(pa.compute.is_null(batch.column("verdict")))
        if len(pages):
            columns = [pa.array(c, pa.string()) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pages.column("id"), *columns], schema=schema)


def _prefixes(path, rules):
    """The rules' paths that ``path`` starts with."""
    if len(rules) <= len(path):
        return [p for p in rules if path.startswith(p)]
    return [path[:n] for n in range(len(path) + 1) if path[:n] in rules]


def judge_urls(pages, rules, id_col="page_id", url_col="url", default="allow", ranges=None):
    """One row per page: ``id_col``, host, path, rule and verdict. ``rules`` has the string columns host, path and verdict."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = pages.sparkSession
    ranges = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = pages.schema[id_col].dataType
    host, path = host_and_path(F.col(url_col))
    keyed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.xxhash64(url_col, F.monotonically_increasing_id()).alias("place"))
    keyed = keyed.withColumn("key", canonical_key("host"))
    wanted, n = SAMPLE_PER_RANGE * ranges, pages.count()
    # about so many rows, chosen by a hash of their place
    sample = keyed.select("key", "place").where(F.pmod(F.xxhash64("place"), F.lit(max(n, 1))) < wanted).collect()
    sample = sorted((r["key"], r["place"]) for r in sample)
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []

    given = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").where("host is not null and path is not null and verdict is not null")
    given = given.groupBy("host", "path").agg(F.max(F.struct(F.col("verdict") == "block", "verdict"))["verdict"].alias("verdict"))
    given = given.select(canonical_key("host").alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict", F.lit(None).cast("bigint").alias("place"))
    # rules open where a range begins: a cut's host and those around it, a row for each label of a cut
    open_at = [(i + 1, key) for i, (cut, _) in enumerate(cuts) for key in enclosing(cut)]
    opened = spark.createDataFrame(open_at, "range int, key string").join(given, "key").select("range", "key", "path", "rule", "verdict")
    least = -(1 << 63)  # a rule stands in front of all urls of its key
    kinds = {"range": pa.int32(), "key": pa.string(), "place": pa.int64(), "path": pa.string(), "rule": pa.string(), "verdict": pa.string(), "host": pa.string(), "id": to_arrow_type(kind)}
    numbered = pa.schema(list(kinds.items()))
    none = F.lit(None).cast("string")
    urls = keyed.select("key", "place", "path", none.alias("rule"), none.alias("verdict"), "host", "id")
    begun = given.select("key", F.lit(least).alias("place"), "path", "rule", "verdict", none.alias("host"), F.lit(None).cast(kind).alias("id"))
    ddl = f"range int, key string, place bigint, path string, rule string, verdict string, host string, id {kind.simpleString()}"
    placed = urls.unionByName(begun).mapInArrow(lambda batches: _ranged(batches, cuts, numbered), ddl)
    opened = opened.select("range", "key", F.lit(least).alias("place"), "path", "rule", "verdict", none.alias("host"), F.lit(None).cast(kind).alias("id"))
    dealt = placed.unionByName(opened).repartitionById(len(cuts) + 1, "range").sortWithinPartitions("range", "key", F.col("verdict").isNull())
    judged = pa.schema([("id", kinds["id"]), *[(c, pa.string()) for c in ("host", "path", "rule", "verdict")]])
    rows = dealt.mapInArrow(lambda batches: _sweep(batches, default, judged), f"id {kind.simpleString()}, host string, path string, rule string, verdict string")
    return rows.withColumnRenamed("id", id_col)
