"""Registered queries of the training-data operators, with checking SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from veriframe.llm import (
    exact_dedup, hash_forest, language_id, license_scan, line_dedup, lookup_kmeans, packing, partenum, run_index, token_alignment, toxicity,
    url_rules, word_bpe,
)
from veriframe.llm.tables import table


def op1_line_dedup(spark, sf_dir):
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_lines=3, min_words=50)
    return docs.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
with lines as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no
  from (select distinct doc_id, text from documents where text is not null)
), filled as (
  select *, row_number() over (partition by doc_id, text order by line_no) as seq, count(*) over (partition by doc_id, text) as size,
    len(regexp_extract_all(line, '[^ \t\r\f\v]+')) as words
  from lines where regexp_matches(line, '[^\s]')
), windows as (
  select *, line as a, lead(line, 1) over w as b, lead(line, 2) over w as c, words as wa, lead(words) over w as wb from filled window w as (partition by doc_id, text order by seq)
), keyed as (
  select *, struct_pack(no_id := doc_id is null, id := doc_id, uid := unhex(md5(concat('v', doc_id, chr(1), 'v', text))), seq := seq) as place from windows
), placed as (
  select doc_id, text, seq, 3 as span, row_number() over (partition by a, b, c order by place) as copy from keyed where c is not null
  union all select doc_id, text, seq, 1, row_number() over (partition by a order by place) from keyed where wa >= 50
  union all select doc_id, text, seq, 2, row_number() over (partition by a, b order by place) from keyed where wa + wb >= 50
  union all select doc_id, text, seq, size, row_number() over (partition by size, a, b order by place) from keyed where size <= 2 and seq = 1
), gone as (
  select distinct doc_id, text, seq + k as seq from placed, (values (0), (1), (2)) steps(k) where copy > 1 and k < span
), marked as (
  select l.doc_id, l.text, l.line, l.line_no, f.seq, g.seq is not null as removed
  from lines l left join filled f on f.doc_id = l.doc_id and f.text = l.text and f.line_no = l.line_no
  left join gone g on g.doc_id = l.doc_id and g.text = l.text and g.seq = f.seq
), runs as (
  select doc_id, text, count(*) as n_runs from gone g
  where not exists (select 1 from gone h where h.doc_id = g.doc_id and h.text = g.text and h.seq = g.seq - 1) group by all
), verdicts as (
  select doc_id, text, count(*) as n_lines, count(*) filter (removed) as n_removed,
    coalesce(string_agg(line, chr(10) order by line_no) filter (not removed), '') as kept
  from marked group by doc_id, text
)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(n_runs, 0) as n_runs, sha256(kept) as kept_sha256
from documents d left join verdicts v on v.doc_id = d.doc_id and v.text = d.text
left join runs r on r.doc_id = d.doc_id and r.text = d.text
"""


def repository_paths(docs):
    """A document as a file: its source is the repository, its id the place; ids 0 and 1 of each directory of 20 are its licence files."""
    folder = F.concat_ws("/", "source", F.expr("doc_id div 400"), F.expr("doc_id div 20"))
    return docs.select("doc_id", "text", F.concat(folder, F.when(F.col("doc_id") % 20 < 2, F.concat(F.lit("/LICENSE-"), "doc_id")).otherwise(F.concat(F.lit("/"), "doc_id"))).alias("path"))


def op2_license_scan(spark, sf_dir):
    """Sources split over directories of 20 ids in directories of 400; ids 0 and 1 of a directory are its licence files."""
    files = repository_paths(table(spark, sf_dir, "documents"))
    return license_scan.scan(files, F.col("doc_id") % 20 < 2)


def _op2_sql():
    names = ", ".join(f"('{n}', '{t}')" for n, t in license_scan.TEMPLATES.items())
    found = f"regexp_extract_all(lower(%s), '{license_scan.TERM}')"
    return rf"""
with templates(license, notice) as (values {names}),
template_tf as (select license, term, count(*) as tf from (select license, unnest({found % 'notice'}) as term from templates) group by all),
total as (select count(text) as n from documents),
df as (select term, count(distinct doc_id) as n from (select doc_id, unnest({found % 'text'}) as term from documents) where term in (select term from template_tf) group by term),
idf as (select term, ln((total.n + 1) / (coalesce(df.n, 0) + 1)) + 1 as idf from (select distinct term from template_tf) left join df using (term), total),
weights as (select license, term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by license)) as weight from template_tf join idf using (term)),
passages as (
  select distinct doc_id, unnest(string_split(text, chr(10)) || string_split_regex(text, '\n\s*\n') || [text]) as passage from documents
), tf as (select doc_id, passage, term, count(*) as tf from (select doc_id, passage, unnest({found % 'passage'}) as term from passages) group by all),
weighed as (select doc_id, passage, term, tf * coalesce(idf, (select max(idf) from idf)) as w from tf left join idf using (term)),
norms as (select doc_id, passage, sqrt(sum(w * w)) as norm from weighed group by all),
scored as (
  select doc_id, license, round(sum(w * weight) / any_value(norm), 6) as cosine
  from weighed join weights using (term) join norms using (doc_id, passage) group by doc_id, passage, license
), own as (
  select doc_id, license, cosine from scored where cosine >= 0.8
  qualify row_number() over (partition by doc_id order by cosine desc, license) = 1
), files as (
  select d.doc_id, source || '/' || doc_id // 400 || '/' || doc_id // 20 as dir,
    source || '/' || doc_id // 400 || '/' || doc_id // 20 || case when doc_id % 20 < 2 then '/LICENSE-' else '/' end || doc_id as path, license, cosine
  from documents d left join own using (doc_id)
), lent as (
  select dir, license from files where doc_id % 20 < 2 and license is not null
  qualify row_number() over (partition by dir order by cosine desc, license) = 1
)
select doc_id, path, files.license as own_license, cosine as own_cosine, coalesce(files.license, lent.license) as license,
  case when files.license is null then lent.dir end as inherited_from
from files left join lent using (dir)
"""


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(~language_id.held_out("doc_id", 3, 1)))
    rows = docs.select("doc_id", language_id.held_out("doc_id", 3, 1).alias("held_out"), "text")
    return language_id.identify(rows, model).drop("text")


def op4_best_fit_packing(spark, sf_dir):
    vocabulary = word_bpe.TokenizerFile.read(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary, capacity=4096, closing_id=1)


def op5_hash_prefix_forest(spark, sf_dir):
    return hash_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, docs.where(~language_id.held_out("doc_id", 5, 0)), table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", language_id.held_out("doc_id", 5, 0).alias("held_out"), "text")
    return toxicity.score(rows, model).drop("text")


def op7_ngram_jaccard(spark, sf_dir):
    return partenum.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=90)


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = """
with texts as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents
)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept,
  sha256(body) as text_sha256
from texts window same as (partition by body)
"""


def op9_run_length_index(spark, sf_dir):
    kept = run_index.remove_repeats(table(spark, sf_dir, "documents"), size=50)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_byte_bpe(spark, sf_dir):
    vocabulary = word_bpe.RankFile.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = word_bpe.decode(word_bpe.encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_token_alignment(spark, sf_dir):
    left = token_alignment.ByteLevelFile.read(public_tokenizers.path("byte_bpe_50k.json"))
    right = token_alignment.PieceModel.read(public_tokenizers.path("piece_bpe_32k.model"))
    rows = token_alignment.align(table(spark, sf_dir, "documents"), left, right, describe=token_alignment.groups_sha256)
    return rows.withColumnRenamed("groups", "groups_sha256")


def op12_lookup_kmeans(spark, sf_dir):
    rows = lookup_kmeans.cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, dims=64, scale=64, rounds=3, seed=1)
    return rows.drop("centroid")


def _op12_sql(k=16, dims=64, scale=64, rounds=3):
    """Rounds written out one after another; whole quotients are taken from exact multiples, as division may go through doubles."""
    steps = []
    for step in range(rounds + 1):
        steps.append(f"""d{step} as (
  select vec_id, row_no, c.cluster, sum((x.v - c.v) * (x.v - c.v)) as distance from parts x join c{step} c using (dim) group by all
), a{step} as (
  select vec_id, row_no, cluster, distance from d{step} qualify row_number() over (partition by row_no order by distance, cluster) = 1
)""")
        if step < rounds:
            steps.append(f"""s{step} as (
  select cluster, dim, sum(v)::bigint as s, count(*) as n from a{step} join parts using (row_no) group by all
), c{step + 1} as (
  select c.cluster, c.dim, case when s is null then c.v else ((s - ((s % n) + n) % n) // n)::bigint end as v from c{step} c left join s{step} using (cluster, dim)
)""")
    return f"""
with kept as (
  select vec_id, row_number() over (order by sha256(concat('1:', vec_id)), vec_id) as row_no, [floor(x::double * {scale})::bigint for x in embedding] as v
  from embeddings where len(embedding) = {dims} and len([x for x in embedding if x is not null and isfinite(x)]) = {dims}
), parts as (
  select vec_id, row_no, unnest(v) as v, generate_subscripts(v, 1) as dim from kept
), c0 as (
  select row_no - 1 as cluster, dim, v from parts where row_no <= {k}
), {", ".join(steps)}
select vec_id, cluster::int as cluster, distance::bigint as distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia,
  sum(distance) over ()::bigint as inertia, centroid_sha256
from a{rounds} join (select cluster, sha256(string_agg(v::varchar, ',' order by dim)) as centroid_sha256 from c{rounds} group by cluster) using (cluster)
"""


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op13_url_rules(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


OP13_SQL = f"""
with rules(host, path, verdict) as (values {", ".join(map(str, URL_RULES))}),
rests as (
  select row_number() over () as row_no, page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parts as (
  select row_no, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_rules.UPPER}', '{url_rules.LOWER}') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from rests
), fitting as (
  select row_no, r.host || r.path as rule, verdict from parts p join rules r
  on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
  qualify row_number() over (partition by row_no order by length(rule) desc, length(r.host) desc) = 1
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join fitting using (row_no)
"""


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_language_id": op3_language_id,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_hash_prefix_forest": op5_hash_prefix_forest,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_run_length_index": op9_run_length_index,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_token_alignment": op11_token_alignment,
    "op12_lookup_kmeans": op12_lookup_kmeans,
    "op13_url_rules": op13_url_rules,
}
ORACLES = {
    "op1_line_dedup": OP1_SQL, "op2_license_scan": _op2_sql(), "op8_exact_dedup": OP8_SQL, "op12_lookup_kmeans": _op12_sql(), "op13_url_rules": OP13_SQL,
}
