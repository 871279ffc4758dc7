"""Corpus pipeline: language ID, line dedup, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's ``docs``. All
but the last return the columns of documents; a text that changes gets a new n_chars. Rows without an id cannot be followed
and go in the first stage. A document whose text is deleted whole goes with it. Repeated rows (one id) are one document after
the third stage. Empty tables stay empty. As each stage's result is written before the next begins, that one first deletes the
intermediate tables behind it and lets Spark drop their shuffles.
"""

from __future__ import annotations

import functools
import gc
import os

import public_tokenizers
from pyspark.sql import Window
from pyspark.sql import functions as F

from veriframe.llm import language_id, line_dedup, packing, partenum, run_index, word_bpe
from veriframe.llm.tables import table
from veriframe.session import cut_lineage, delete_intermediates, intermediates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None  # language ID and packing have no SQL form; tests hold every stage against a plain version


def _columns(docs, **changed):
    return docs.select(*[changed.get(c, F.col(c)).alias(c) for c in COLUMNS])


def _with_text(docs, changed):
    """New n_chars; documents whose text is gone go."""
    docs = docs.where(~changed | F.col("text").rlike(r"\S"))
    return _columns(docs, n_chars=F.length("text").cast("bigint"))


def _far_from_language(scored):
    """Texts that cost far more bits than rows of their language do: over twice the median and 2 bits a byte, by over 64 bits in all.

    The medians are taken over all rows that carry the predicted label. A few bytes do not tell noise from a name, so they stay.
    """
    own = scored.where((F.col("lang") == F.col("lang_pred")) & F.col("bits_per_byte").isNotNull())
    medians = own.groupBy("lang_pred").agg(F.percentile_approx("bits_per_byte", 0.5, 10_000).alias("bits")).collect()  # a row per language
    if not medians:
        return F.lit(False)
    limits = {r["lang_pred"]: 2 * r["bits"] + 2 for r in medians}
    known = F.create_map(*[F.lit(v) for pair in limits.items() for v in pair])
    limit = F.coalesce(F.try_element_at(known, F.col("lang_pred")), F.lit(max(limits.values())))
    return (F.col("bits_per_byte") - limit) * F.octet_length("text") > 64


def keep_known_languages(spark, docs, sf_dir):
    """Rejects texts without a language (null, without letters or far from all learned ones) and rows without an id; a missing label is filled in."""
    docs = docs.where(F.col("doc_id").isNotNull())
    scored = language_id.identify(docs, language_id.fit(docs))
    kept = scored.where((F.col("lang_pred") != language_id.UNKNOWN) & ~_far_from_language(scored))
    return _columns(kept, lang=F.coalesce("lang", "lang_pred"))


def cut_repeated_lines(spark, docs, sf_dir):
    """Deletes later copies of runs of three lines or more, of one or two lines with 50 words or more, and of whole documents of one or two lines."""
    cut = line_dedup.dedup_lines(docs, min_lines=3, min_words=50)
    return _with_text(cut, F.col("n_removed") > 0)


def keep_one_of_near_duplicates(spark, docs, sf_dir):
    """Of documents linked by shared five-word shingles (Jaccard 0.8 or more) the one with the smallest id stays."""
    groups = partenum.near_duplicates(docs, width=5, percent=80)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    same_id = Window.partitionBy("doc_id").orderBy("text")
    return _columns(docs.join(kept, "doc_id", "left_semi").withColumn("_n", F.row_number().over(same_id)).where("_n = 1"))


def cut_repeated_passages(spark, docs, sf_dir):
    """Deletes bytes of 50-byte strings that an earlier document holds; characters cut in two are dropped."""
    kept = run_index.remove_repeats(docs, size=50, as_text=True).select("doc_id", "n_removed", F.col("kept").alias("text"))
    return _with_text(docs.drop("text").join(kept, "doc_id"), F.col("n_removed") > 0)


def pack_sequences(spark, docs, sf_dir):
    """Pieces of at most 4096 tokens with their sequence and offset."""
    vocabulary = word_bpe.TokenizerFile.read(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack_documents(docs, vocabulary, capacity=4096, closing_id=1)


_LEFT = {}  # intermediates of an application's last stage


def _after_the_last(stage):
    """The stage, which first frees the disk that the stage before it took; input that still reads those tables keeps them."""

    @functools.wraps(stage)
    def run_stage(spark, docs, sf_dir):
        left = _LEFT.pop(spark.sparkContext.applicationId, [])
        names = {os.path.basename(path) for path in left}
        kept = []
        if stage is keep_known_languages:
            pass  # what is left belongs to the result of an earlier run
        elif any(names.intersection(file.split("/")) for file in docs.inputFiles()):
            kept = left
        else:
            delete_intermediates(spark, left)
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # shuffles go once the driver drops their plans
        with intermediates() as written:
            result = stage(spark, docs, sf_dir)
        _LEFT[spark.sparkContext.applicationId] = kept + written
        return result

    return run_stage


STAGES = [(name, _after_the_last(stage)) for name, stage in [
    ("language_id", keep_known_languages),
    ("line_dedup", cut_repeated_lines),
    ("ngram_jaccard", keep_one_of_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("best_fit_packing", pack_sequences),
]]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
