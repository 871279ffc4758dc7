"""Line dedup: repeated runs of lines found by distributed prefix doubling over line-ID sequences.

A document is the sequence of its lines that hold more than white space. Ranks by one line are line IDs; each round pairs a
position's rank with the rank ``h`` lines on and ranks the pairs, which doubles the compared length to ``2 h`` - the suffix
array's order by the first ``2 h`` lines, in which equal suffixes share a rank. Positions whose rank is theirs alone have no
longer repeat and leave; a suffix shorter than the compared length leaves as well. A group of suffixes of equal rank at
depth ``min_lines`` is exactly an interval of the suffix array whose longest common prefix reaches that length, so intervals
are found by grouping on the rank, with map-side combining, and not by scanning the sorted array, which would put a hot run
into one task. Overlapping windows of an interval's members merge to the maximal repeated run.

The first position of an interval, by (doc_id, row key, line), stays; lines covered by a later one are deleted. Depths that
are no power of two are reached by two overlapping windows.

With ``min_words`` shorter repeats count as well, if they hold enough text: members of the intervals of one and of two lines with at
least so many words, and documents of one or two lines that are repeated whole (whatever their words).

Nulls: a null text has no lines and stays null; a null doc_id orders last. Rows equal in doc_id and text are one document
(they get the same verdict, and do not delete each other). Blank lines are no part of a run and always stay. Empty tables
give no rows. Only the id and text columns are read; other columns pass through.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from veriframe.llm.tables import row_key
from veriframe.session import cut_lineage


WORD = r"[^ \t\r\f\x0B]+"


def line_positions(docs, id_col="doc_id", text_col="text"):
    """(_uid, _doc, seq, line_no, _line, words, _size): the non-blank lines of each distinct (id, text), with the number of these lines."""
    rows = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("_uid"), F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    lines = F.transform(F.split("_text", "\n"), lambda line, i: F.struct(i.alias("line_no"), line.alias("line")))
    lines = F.filter(lines, lambda x: x["line"].rlike(r"\S"))
    lines = F.transform(lines, lambda x: F.struct(x["line_no"].alias("line_no"), F.unhex(F.md5(x["line"])).alias("_line"), F.regexp_count(x["line"], F.lit(WORD)).alias("words")))
    rows = rows.select("_uid", "_doc", lines.alias("_lines")).select("_uid", "_doc", F.size("_lines").alias("_size"), F.posexplode("_lines").alias("seq", "_entry"))
    return rows.select("_uid", "_doc", "seq", "_entry.line_no", "_entry._line", "_entry.words", "_size")


def _ranked(positions, keys, name):
    """Positions whose ``keys`` occur more than once, with a new ``_rank``: the place of the keys in sorted order."""
    repeated = positions.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*keys)
    # ids given after a range sort follow the order of the keys
    ranks = cut_lineage(repeated.orderBy(*keys).withColumn("_place", F.monotonically_increasing_id()), f"{name}-ranks")
    return cut_lineage(positions.join(ranks, keys).select("_uid", "_doc", "seq", "line_no", F.col("_place").alias("_rank"), "words", "_size"), name)


def _shifted(positions, by, *more):
    return positions.select("_uid", (F.col("seq") - by).alias("seq"), F.col("_rank").alias("_next"), *more)


def _windows(rows, kind, span):
    """Windows of ``span`` lines with their group: (_kind, _rank, _next, _uid, _doc, seq, span)."""
    return rows.select(F.lit(kind).alias("_kind"), "_rank", "_next", "_uid", "_doc", "seq", F.lit(span).alias("span"))


def _short_windows(single, min_lines, min_words):
    """Windows of one and two lines with enough words, and of whole documents, among the repeated lines ``single``."""
    single = single.withColumn("_next", F.lit(0).cast("bigint"))
    found = [_windows(single.where(F.col("words") >= min_words), "line", 1), _windows(single.where("_size = 1"), "document of a line", 1)]
    if min_lines > 2:
        pairs = single.drop("_next").join(_shifted(single, 1, F.col("words").alias("more")), ["_uid", "seq"])
        found += [_windows(pairs.where(F.col("words") + F.col("more") >= min_words), "pair", 2), _windows(pairs.where("_size = 2"), "document of a pair", 2)]
    return found


def repeated_windows(lines, min_lines, min_words=None):
    """The lines, and windows of them that occur more than once (see ``_windows``): of ``min_lines``, or shorter with enough words."""
    lines = cut_lineage(lines.dropDuplicates(["_uid", "seq"]), "lines")
    positions, depth = _ranked(lines, ["_line"], "depth-1"), 1
    found = _short_windows(positions, min_lines, min_words) if min_words is not None and min_lines > 1 else []
    while depth * 2 <= min_lines:
        pairs = positions.join(_shifted(positions, depth), ["_uid", "seq"])
        depth *= 2
        positions = _ranked(pairs, ["_rank", "_next"], f"depth-{depth}")
    whole = positions.withColumn("_next", F.lit(0).cast("bigint")) if depth == min_lines else positions.join(_shifted(positions, min_lines - depth), ["_uid", "seq"])
    windows = _windows(whole, "run", min_lines)
    for more in found:
        windows = windows.unionByName(more)
    return lines, windows


def later_copies(docs, min_lines=3, id_col="doc_id", text_col="text", min_words=None):
    """(_uid, removed): the line numbers to delete of each document that repeats an earlier run, and its number of runs."""
    lines, windows = repeated_windows(line_positions(docs, id_col, text_col), min_lines, min_words)
    place = F.struct(F.col("_doc").isNull().alias("no_id"), F.col("_doc").alias("doc"), F.col("_uid").alias("uid"), F.col("seq").alias("seq"))
    placed, group = windows.withColumn("_place", place), ["_kind", "_rank", "_next"]
    first = placed.groupBy(*group).agg(F.min("_place").alias("_first"))
    later = placed.join(first, group).where(F.col("_place") != F.col("_first"))
    covered = later.select("_uid", F.explode(F.sequence(F.col("seq"), F.col("seq") + F.col("span") - 1)).alias("seq")).distinct()
    numbered = lines.select("_uid", "seq", "line_no").join(covered, ["_uid", "seq"])
    return numbered.groupBy("_uid").agg(F.sort_array(F.collect_list(F.struct("seq", "line_no"))).alias("_lines")).select(
        "_uid",
        F.transform("_lines", lambda x: x["line_no"]).alias("removed"),
        # a run starts where the line before it is not removed
        F.size(F.array_except(F.transform("_lines", lambda x: x["seq"]), F.transform("_lines", lambda x: x["seq"] + 1))).alias("n_runs"),
    )


def without_lines(text: pd.Series, removed: pd.Series) -> pd.Series:
    def cut(body, numbers):
        if body is None or numbers is None:
            return body
        gone = set(numbers)
        return "\n".join(line for i, line in enumerate(body.split("\n")) if i not in gone)

    return pd.Series([cut(body, numbers) for body, numbers in zip(text, removed)], dtype=object)


def dedup_lines(docs, min_lines=3, id_col="doc_id", text_col="text", min_words=None):
    """``docs`` with later copies of repeated runs cut out of ``text_col``, plus n_lines, n_removed and n_runs."""
    names = docs.columns
    verdicts = later_copies(docs, min_lines, id_col, text_col, min_words)
    joined = docs.withColumn("_uid", row_key(F.col(id_col), F.col(text_col))).join(verdicts, "_uid", "left")
    kept = {c: F.col(c) for c in names} | {text_col: F.pandas_udf(without_lines, "string")(F.col(text_col), F.col("removed"))}
    return joined.select(
        *[column.alias(c) for c, column in kept.items()],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(text_col, "\n"))).alias("n_lines"),
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).alias("n_removed"),
        F.coalesce("n_runs", F.lit(0)).alias("n_runs"),
    )
