"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

DataFrame functions only. Every line, every paragraph and the text as a whole is a candidate passage. Terms weigh by their
inverse document frequency over all texts; terms outside the templates weigh as much as the rarest template term, so prose
around a notice lowers its cosine. A passage can only reach ``threshold`` if it holds one of a template's informative terms:
the terms are cut where the rest of each template could not reach the threshold alone. That exact test precedes any explode,
so ordinary text costs one pattern search.

A file without a licence of its own takes the one of the nearest ancestor directory that has a licence file with a detected
licence: each path is exploded into its ancestors, which meet the directories by equality, and the deepest one stays.

Nulls: a null text or path has no own licence; a null path inherits nothing and lends nothing. Ties between templates go to
the name first in the alphabet, ties between licence files of one directory to the larger cosine, then the name. Rows with
one id are one file with several texts. Repeated rows get equal results; an empty table gives no rows. Only the named columns
are read.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

# Notices by which files name their licence; fixed values, in the wording of the licences' own instructions.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
TERM = r"[a-z0-9.]*[a-z0-9]"


def terms(text):
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), 1)


def template_terms(templates):
    import re

    return {name: re.findall(TERM, text.lower()) for name, text in templates.items()}


def inverse_frequencies(docs, templates, text_col="text"):
    """{template term: ln((N + 1) / (n + 1)) + 1} over all texts: one row per template term reaches the driver."""
    known = sorted({t for words in template_terms(templates).values() for t in words})
    held = F.array_intersect(terms(F.col(text_col)), F.array(*[F.lit(t) for t in known]))
    total = docs.agg(F.count(text_col)).first()[0]
    rows = docs.select(F.explode(held).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r["term"]: r["n"] for r in rows}
    return {t: math.log((total + 1) / (counts.get(t, 0) + 1)) + 1 for t in known}


def template_weights(templates, idf):
    """{name: {term: weight}}, unit length."""
    out = {}
    for name, words in template_terms(templates).items():
        raw = {t: words.count(t) * idf[t] for t in set(words)}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        out[name] = {t: w / norm for t, w in raw.items()}
    return out


def informative_terms(weights, idf, threshold):
    """Fewest rare terms such that no template reaches ``threshold`` without one of them."""
    chosen = set()
    for term in sorted(idf, key=lambda t: (-idf[t], t)):
        if all(math.sqrt(sum(w * w for t, w in own.items() if t not in chosen)) < threshold for own in weights.values()):
            break
        chosen.add(term)
    return sorted(chosen)


def notices(docs, templates=None, threshold=0.8, id_col="doc_id", text_col="text"):
    """(_id, license, cosine): the best template of each text whose cosine reaches ``threshold``."""
    templates = templates or TEMPLATES
    spark = docs.sparkSession
    idf = inverse_frequencies(docs, templates, text_col)
    weights = template_weights(templates, idf)
    rare = informative_terms(weights, idf, threshold)
    pattern = r"(?i)(?<![a-z0-9.])(" + "|".join(r"\Q" + t + r"\E" for t in rare) + r")(?![a-z0-9])"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").rlike(pattern))
    passages = F.array_distinct(F.concat(F.split("_text", "\n"), F.split("_text", r"\n\s*\n"), F.array("_text")))
    rows = rows.select("_id", F.explode(F.filter(passages, lambda p: p.rlike(pattern))).alias("_passage")).distinct()
    rows = rows.withColumn("_key", F.md5("_passage"))
    counted = rows.select("_key", "_passage").distinct().select("_key", F.explode(terms(F.col("_passage"))).alias("term")).groupBy("_key", "term").agg(F.count(F.lit(1)).alias("tf"))
    own = spark.createDataFrame([(t, float(v)) for t, v in idf.items()], "term string, idf double")
    table = spark.createDataFrame([(n, t, float(w)) for n, ws in weights.items() for t, w in ws.items()], "license string, term string, weight double")
    weighed = counted.join(F.broadcast(own), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(float(max(idf.values())))))  # template terms: a fixed few
    norms = weighed.groupBy("_key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(table), "term").groupBy("_key", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "_key").select("_key", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).where(F.col("cosine") >= threshold)
    best = rows.select("_id", "_key").join(scored, "_key").groupBy("_id", "license").agg(F.max("cosine").alias("cosine"))
    top = best.groupBy("_id").agg(F.min(F.struct((-F.col("cosine")).alias("order"), "license", "cosine")).alias("top"))
    return top.select("_id", "top.license", "top.cosine")


def ancestors(path):
    """Directories above a path, nearest first: a/b/c -> a/b, a and the root ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files, is_licence_file, templates=None, threshold=0.8, id_col="doc_id", path_col="path", text_col="text"):
    """One row per file: id, path, own_license, own_cosine, license, inherited_from (the directory, null for an own licence)."""
    own = notices(files, templates, threshold, id_col, text_col)
    paths = files.select(F.col(id_col).alias("_id"), F.col(path_col).alias("_path"), is_licence_file.alias("_lends"))
    marked = paths.join(own, "_id", "left")
    lent = marked.where(F.col("_lends") & F.col("license").isNotNull() & F.col("_path").isNotNull())
    lent = lent.groupBy(F.element_at(ancestors(F.col("_path")), 1).alias("_dir")).agg(F.min(F.struct((-F.col("cosine")).alias("order"), "license")).alias("best"))
    lent = lent.select("_dir", F.col("best.license").alias("_lent"))
    wanting = marked.where(F.col("license").isNull() & F.col("_path").isNotNull()).select("_path").distinct()
    up = wanting.select("_path", F.posexplode(ancestors(F.col("_path"))).alias("_up", "_dir")).join(lent, "_dir")
    nearest = up.groupBy("_path").agg(F.min(F.struct("_up", "_dir", "_lent")).alias("near")).select("_path", "near._dir", "near._lent")
    return marked.join(nearest, "_path", "left").select(
        F.col("_id").alias(id_col), F.col("_path").alias(path_col), F.col("license").alias("own_license"), F.col("cosine").alias("own_cosine"),
        F.coalesce("license", "_lent").alias("license"), F.when(F.col("license").isNull(), F.col("_dir")).alias("inherited_from"),
    )
