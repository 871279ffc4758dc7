"""Language identification by prediction by partial matching (PPM, escape method C).

Per language, a context tree holds how often each byte followed each context of up to ``order`` bytes. A byte costs
-log2(count / (total + kinds)) in its longest known context; a byte that is new there costs the escape,
-log2(kinds / (total + kinds)), and is looked up in the context one byte shorter, down to 8 bits for a byte never seen. The
statistics are frozen after fitting, so the cost of every context and byte is worked out once; a text's exact code length
under a language is the sum over all its bytes, and the shortest code wins.

The fit uses at most ``rows_per_language`` labelled rows per language (a documented bound: the classifier's sample, chosen by
a hash of the id and text). Scoring reads whole texts.

Nulls: a null text, or one without a letter, is ``und`` with score 0. A null label is no training row. Equal code lengths go
to the language first in the alphabet. Repeated rows get equal results; an empty table gives no rows; with no training rows
every text is ``und``. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from veriframe.llm.tables import give_back, kept_with, pack, slices, text_buffer, unpack

UNKNOWN = "und"


def _grams(data, offsets, k):
    """Keys of all (k+1)-byte grams inside rows (lowest byte: the predicted one) and their positions."""
    if len(data) <= k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = data[k:].astype(np.uint64)
    for back in range(1, k + 1):
        keys |= data[k - back: len(data) - back].astype(np.uint64) << np.uint64(8 * back)
    if not k or len(offsets) == 2:
        return keys, np.arange(k, len(data))
    inside = np.ones(len(data), bool)
    for step in range(k):  # the first k bytes of a row have shorter contexts
        starts = offsets[:-1][np.diff(offsets) > step] + step
        inside[starts] = False
    position = np.flatnonzero(inside[k:]) + k
    return keys[position - k], position


class Lookup:
    """Row numbers of 64-bit keys: one probe in a table, and a sorted list for keys whose place was taken."""

    def __init__(self, keys):
        self.bits = np.uint64(64 - max(8, int(len(keys) * 4).bit_length()))
        size = 1 << (64 - int(self.bits))
        place = self._place(keys)
        self.row = np.full(size, -1, np.int32)
        self.row[place[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        self.key = np.zeros(size, np.uint64)
        taken = self.row >= 0
        self.key[taken] = keys[self.row[taken]]
        self.extra = np.flatnonzero(self.row[place] != np.arange(len(keys)))  # stays sorted by key
        self.extra_keys = keys[self.extra]

    def _place(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def find(self, keys):
        place = self._place(keys)
        row = np.where(self.key[place] == keys, self.row[place], np.int32(-1))
        if len(self.extra):
            missing = np.flatnonzero(row < 0)
            at = np.minimum(np.searchsorted(self.extra_keys, keys[missing]), len(self.extra) - 1)
            row[missing] = np.where(self.extra_keys[at] == keys[missing], self.extra[at], -1)
        return row


@dataclass(frozen=True)
class Frozen:
    """Per order: known grams with their cost under each language, known contexts with the cost of an escape."""

    languages: tuple
    grams: list
    costs: list
    contexts: list
    escapes: list

    def tables(self):
        return [Lookup(g) for g in self.grams], [Lookup(c) for c in self.contexts]


def count_language(texts, order):
    """Packed [(grams, counts)] for orders 0..order of one language's rows."""
    data, offsets = text_buffer(texts)
    return pack([np.unique(_grams(data, offsets, k)[0], return_counts=True) for k in range(order + 1)])


def freeze(counts):
    """Worked-out costs from {language: [(grams, counts) per order]}."""
    languages = tuple(sorted(counts))
    model = Frozen(languages, [], [], [], [])
    order = len(next(iter(counts.values())))
    for k in range(order):
        grams = np.unique(np.concatenate([counts[lang][k][0] for lang in languages]))
        context = np.unique(grams >> np.uint64(8))
        of_gram = np.searchsorted(context, grams >> np.uint64(8))
        lower = np.full((len(grams), len(languages)), 8.0)
        if k:
            lower = model.costs[k - 1][np.searchsorted(model.grams[k - 1], grams & np.uint64((1 << 8 * k) - 1))].astype(np.float64)
        cost, escape = np.zeros_like(lower), np.zeros((len(context), len(languages)))
        for column, lang in enumerate(languages):
            own, n = counts[lang][k]
            seen = np.zeros(len(grams))
            seen[np.searchsorted(grams, own)] = n
            total = np.bincount(of_gram, seen, len(context))
            kinds = np.bincount(of_gram, seen > 0, len(context))
            known = total > 0
            escape[known, column] = -np.log2(kinds[known] / (total + kinds)[known])
            hit = seen > 0
            cost[:, column] = escape[of_gram, column] + lower[:, column]
            cost[hit, column] = -np.log2(seen[hit] / (total + kinds)[of_gram[hit]])
        for values, value in ((model.grams, grams), (model.costs, cost.astype(np.float32)), (model.contexts, context), (model.escapes, escape.astype(np.float32))):
            values.append(value)
    return model


def fit(labelled, rows_per_language=1500, order=4, id_col="doc_id", text_col="text", lang_col="lang", bytes_per_language=64 << 20):
    """Frozen statistics from a bounded sample of rows per language; None without labelled rows.

    The sample of a language ends at ``rows_per_language`` rows or with the row that reaches ``bytes_per_language``. Texts may be
    empty or shorter than the order; orders that no training text reaches are left out of the code lengths.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("order"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not sizes:
        return None
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, 1.5 * rows_per_language / n))])
    # a hash threshold first, so that only about the wanted rows are put in order
    drawn = rows.where(F.pmod("order", F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    inside = Window.partitionBy("lang").orderBy("order", "text")
    held = F.sum(F.octet_length("text")).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    sample = drawn.withColumns({"rank": F.row_number().over(inside), "held": F.coalesce(held, F.lit(0))})
    sample = sample.where((F.col("rank") <= rows_per_language) & (F.col("held") < bytes_per_language)).select("lang", "text")

    def count(key, rows):
        return give_back(pa.table({"lang": [key[0].as_py()], "counts": pa.array([count_language(rows.column("text"), order)], pa.binary())}))

    counted = sample.groupBy("lang").applyInArrow(count, "lang string, counts binary").collect()  # bounded by the sample
    return freeze({r["lang"]: unpack(bytes(r["counts"])) for r in counted})


def code_lengths(model, tables, data, offsets):
    """Bits of every row under every language."""
    grams, contexts = tables
    rows = len(offsets) - 1
    bits = np.zeros((rows, len(model.languages)))
    for k in range(len(model.grams)):  # bytes near a row's start have a context of exactly k bytes
        last = k == len(model.grams) - 1
        if last:
            keys, position = _grams(data, offsets, k)
        else:
            starts = offsets[:-1][np.diff(offsets) > k]
            position = starts + k
            keys = data[position].astype(np.uint64)
            for back in range(1, k + 1):
                keys |= data[position - back].astype(np.uint64) << np.uint64(8 * back)
        if not len(keys):
            continue
        cost = _costs(model, grams, contexts, keys, k)
        if last:
            bounds = np.searchsorted(position, offsets)
            filled = np.flatnonzero(np.diff(bounds))
            bits[filled] += np.add.reduceat(cost, bounds[filled], axis=0, dtype=np.float64)
        else:
            np.add.at(bits, np.searchsorted(offsets, position, side="right") - 1, cost)
    return bits


def _costs(model, grams, contexts, keys, k):
    if not len(model.grams[k]):  # no training text was long enough for this order
        return _costs(model, grams, contexts, keys & np.uint64((1 << 8 * k) - 1), k - 1) if k else np.full((len(keys), len(model.languages)), np.float32(8))
    found = grams[k].find(keys)
    cost = model.costs[k][found]
    missing = np.flatnonzero(found < 0)
    if len(missing):
        keys = keys[missing]
        context = contexts[k].find(keys >> np.uint64(8))
        escape = np.where((context >= 0)[:, None], model.escapes[k][context], np.float32(0))
        lower = _costs(model, grams, contexts, keys & np.uint64((1 << 8 * k) - 1), k - 1) if k else np.float32(8)
        cost[missing] = escape + lower
    return cost


def identify(docs, model, text_col="text", chunk_bytes=1 << 20):
    """``docs`` plus lang_pred, score (share of the winner when code lengths count as probabilities) and bits_per_byte."""
    names = docs.columns
    if model is None:
        return docs.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample and the order

    def run(batches):
        frozen = shared.value
        tables = kept_with(frozen, "_lookups", frozen.tables)
        for batch in batches:
            data, offsets = text_buffer(batch.column(text_col))
            bits = np.zeros((len(batch), len(frozen.languages)))
            for start, stop in slices(np.diff(offsets), chunk_bytes):
                own = offsets[start: stop + 1] - offsets[start]
                bits[start:stop] = code_lengths(frozen, tables, data[offsets[start]: offsets[stop]], own)
            best = bits.argmin(axis=1)
            least = bits.min(axis=1)
            score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            letter = np.array(batch.column("_letter").to_pylist(), bool)
            language = np.where(letter, np.array(frozen.languages, object)[best], UNKNOWN)
            per_byte = least / np.maximum(np.diff(offsets), 1)
            columns = [batch.column(n) for n in names] + [pa.array(language, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(per_byte, mask=~letter)]
            yield give_back(pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score", "bits_per_byte"]))

    marked = docs.withColumn("_letter", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return marked.mapInArrow(run, f"{fields}, lang_pred string, score double, bits_per_byte double")


def held_out(id_col, parts, rest):
    """Fold rule: crc32 of the id's text modulo ``parts`` equals ``rest``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts, F.lit(0)) == rest
