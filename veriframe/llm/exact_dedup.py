"""Exact duplicates by an extendible-hash index kept on the shared folder; DataFrame functions only.

Entries (key, digest, id, row) are written once. The directory starts at a depth at which buckets are about full and doubles
where one holds more distinct keys than its capacity: such buckets hand their keys to two buckets of one more bit, the others
keep their local depth. Slots of the full depth point to buckets, whose numbers follow the order of the keys.

A key met once is settled by its entry. The texts of keys met more often go to the owners of the buckets, found through the
slots: copies are first combined under a salt, so a text that a third of all rows share arrives as a few rows, then range
partitions over buckets and keys give every owner task a range of keys. There, without another shuffle, texts are compared
byte by byte: equal ones become one link of their key's chain with its size and the largest id, different texts under one key
are links of their own. The chains are written to the shared folder, and entries find their link by key and digest; where two
links of a key agree in their digest too, its rows find theirs by the text.

Links with over a ten-thousandth of all rows, so fewer than 10 000 of them, meet the entries by broadcast; no task gets a hot group.

Nulls: a null text equals an empty one; a null id never wins against an id and keeps null only in a group without ids.
Repeated rows count each; exactly one row of a group is marked kept. An empty table gives no rows. Only the id and text
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veriframe.session import cut_lineage

KEY_BITS = 62
SALTS = 16
HOT_SHARE = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text):
    """Lower-cases A-Z only; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def text_key(text):
    """The top 62 bits of a 64-bit hash, so that unsigned order is the order of the numbers."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS)


def text_digest(text):
    return F.sha2(text, 256)


def bucket_directory(entries, capacity):
    """Buckets (low, high, depth, keys): key ranges of ``2 ** (KEY_BITS - depth)`` with at most ``capacity`` distinct keys."""
    keys = cut_lineage(entries.select("_key").distinct(), "index-keys")
    count = keys.count()
    depth = max(0, (max(count, 1) // capacity).bit_length() - 1)
    done, open_keys = [], keys
    while True:
        span = 1 << (KEY_BITS - depth)
        sizes = open_keys.groupBy(F.expr(f"_key div {span}L").alias("_prefix")).agg(F.count(F.lit(1)).alias("keys"))
        sizes = cut_lineage(sizes.select((F.col("_prefix") * F.lit(span)).alias("low"), (F.col("_prefix") * F.lit(span) + F.lit(span - 1)).alias("high"), F.lit(depth).alias("depth"), "keys"), "index-buckets")
        full = (F.col("keys") > capacity) & F.lit(depth < KEY_BITS)
        done.append(sizes.where(~full))
        overfull = sizes.where(full)
        if overfull.isEmpty():
            break
        # only the keys of overfull buckets are dealt out again, one bit deeper
        open_keys = open_keys.withColumn("low", F.expr(f"(_key div {span}L) * {span}L")).join(overfull.select("low"), "low").select("_key")
        depth += 1
    directory = done[0]
    for part in done[1:]:
        directory = directory.unionByName(part)
    return directory, depth


def _in_buckets(rows, directory, depth):
    """``rows`` with the ``_bucket`` to which the directory's slot at full depth points, as in extendible hashing."""
    span = 1 << (KEY_BITS - depth)
    slots = directory.select(F.explode(F.sequence(F.expr(f"low div {span}L"), F.expr(f"high div {span}L"))).alias("_slot"), F.col("low").alias("_bucket"))
    return rows.withColumn("_slot", F.expr(f"_key div {span}L")).join(slots, "_slot").drop("_slot")


def salt():
    """Spreads the rows of one key over SALTS parts."""
    return F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")


def chains(texts, directory, depth):
    """(_bucket, _key, _digest, _text, _keep, _size): the links of every chain, made by the owners of the buckets.

    ``texts``: _id, _key, _digest, _text, _salt.
    """
    salted = texts.groupBy("_key", "_digest", "_text", "_salt").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    owned = _in_buckets(salted, directory, depth).repartitionByRange("_bucket", "_key")
    # an owner holds whole keys: grouping by the bytes of the text needs no further exchange
    return owned.groupBy("_bucket", "_key", "_digest", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_size").alias("_size"))


def exact_duplicates(docs, id_col="doc_id", text_col="text", capacity=1024, key=text_key, digest=text_digest):
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    ``key`` and ``digest`` make an index key of 62 bits and the digest of a text; poorer ones only make chains longer.
    """
    source = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"))
    source = source.select("_id", key(F.col("_text")).alias("_key"), digest(F.col("_text")).alias("_digest"), "_text")
    entries = cut_lineage(source.drop("_text").withColumn("_row", F.monotonically_increasing_id()), "index-entries")
    counted = entries.groupBy("_key", "_digest").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("_id", "_row")).alias("_last"))
    counted = cut_lineage(counted, "index-counts")
    several = counted.groupBy("_key").agg(F.sum("_n").alias("_n")).where("_n > 1").select("_key")
    directory, depth = bucket_directory(counted, capacity)
    # a key's rows arrive in SALTS parts, which are combined where they arrive
    spread = several.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    links = chains(source.withColumn("_salt", salt()).join(spread, ["_key", "_salt"], "left_semi"), directory, depth)
    alike = F.count(F.lit(1)).over(Window.partitionBy("_bucket", "_key", "_digest"))
    links = links.withColumn("_alike", alike).withColumn("_text", F.when(F.col("_alike") > 1, F.col("_text")))
    links = cut_lineage(links, "index-chains")
    chain = ["_key", "_digest"]
    # links that key and digest tell apart; the row that stays is the last one of the largest id
    plain = links.where("_alike = 1").join(counted.select(*chain, "_last._row"), chain).select(*chain, "_keep", "_size", F.col("_row").alias("_stays"))
    hot = F.col("_size") > F.greatest(F.lit(1000), F.lit(entries.count() // HOT_SHARE))
    found = _with_links(entries, plain, hot, chain)
    twins = links.where("_alike > 1").select(*chain, "_text", "_keep", "_size")
    if not twins.isEmpty():
        found = found.join(twins.select(*chain).distinct(), chain, "left_anti").unionByName(_by_text(source, twins, chain))
    return found.select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").cast("bigint").alias("group_size"), "kept",
        F.col("_digest").alias("text_sha256"),
    )


def _with_links(entries, links, hot, chain):
    """Entries with what their link says; an entry without a link is alone."""
    large = F.broadcast(links.where(hot))  # fewer than HOT_SHARE links: each holds more than that share of all rows
    of_large = entries.join(large, chain)
    others = entries.join(large.select(*chain), chain, "left_anti").join(links.where(~hot), chain, "left")
    alone = F.col("_stays").isNull()
    return of_large.unionByName(others).select(
        "_id", *chain, F.when(alone, F.col("_id")).otherwise(F.col("_keep")).alias("_keep"), F.coalesce("_size", F.lit(1)).alias("_size"),
        (alone | (F.col("_row") == F.col("_stays"))).alias("kept"),
    )


def _by_text(source, twins, chain):
    """Rows of keys that hold different texts of one digest."""
    rows = cut_lineage(source.join(twins, [*chain, "_text"]).withColumn("_row", F.monotonically_increasing_id()), "index-twins")
    last = rows.groupBy(*chain, "_text").agg(F.max(F.struct("_id", "_row"))["_row"].alias("_stays"))
    return rows.join(last, [*chain, "_text"]).select("_id", *chain, "_keep", "_size", (F.col("_row") == F.col("_stays")).alias("kept"))
