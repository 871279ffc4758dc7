import corpus_pipeline
from test_line_dedup import brute_short as brute_lines
from test_partenum import brute as brute_groups
from test_run_index import brute as brute_bytes
from test_word_bpe import check_packing
from veriframe.llm.queries import QUERIES  # noqa: F401
from veriframe.session import cut_lineage

FOLDER = "/root/testdata/sf0.001"


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def check_stages(spark, docs):
    by_name = dict(corpus_pipeline.STAGES)
    known = cut_lineage(by_name["language_id"](spark, docs, FOLDER), "test")
    before, after = pairs(docs), dict(pairs(known))
    assert set(after) == {d for d, t in before if d is not None and t and any(c.isalpha() for c in t)}
    lines = cut_lineage(by_name["line_dedup"](spark, known, FOLDER), "test")
    cut = brute_lines(list(after.items()), 3, 50)
    assert dict(pairs(lines)) == {d: t for d, t in cut.items() if t == after[d] or t.strip()}
    single = cut_lineage(by_name["ngram_jaccard"](spark, lines, FOLDER), "test")
    rows = pairs(lines)
    assert sorted(str(d) for d, _ in pairs(single)) == sorted(d for d, _, c in brute_groups(rows, 5, 80) if d == c)
    rest = cut_lineage(by_name["suffix_array_dedup"](spark, single, FOLDER), "test")
    kept = {r[0]: (r[4].decode("utf-8", "ignore"), r[2]) for r in brute_bytes(pairs(single), 50)}
    assert dict(pairs(rest)) == {d: t for d, (t, n) in kept.items() if not n or t.strip()}
    assert all(r.n_chars == len(r.text) for r in rest.collect())
    assert known.columns == lines.columns == single.columns == rest.columns == corpus_pipeline.COLUMNS
    check_packing(by_name["best_fit_packing"](spark, rest, FOLDER).collect(), pairs(rest))


def test_stages_on_documents(spark):
    check_stages(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_stages_on_odd_rows(spark, frame):
    prose = "the words of this text are all plain and there is nothing odd in any of them at all "
    rows = [(i, f"{prose} number {i} " + "\n".join(f"line {i} {k}" for k in range(i % 4)), "en") for i in range(30)]
    rows += [(100, None, "en"), (101, "", None), (102, "123", "en"), (None, prose, "en"), (103, "Ä" + prose * 3, None), (104, "É" + prose * 3, None)]
    docs = frame(rows).selectExpr("*", "cast(length(text) as bigint) as n_chars", "1 as _n")
    check_stages(spark, docs)
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, FOLDER)
        assert out.count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 4096


def test_noise_and_unlearned_languages_are_rejected(spark, frame):
    import base64
    import random

    rng = random.Random(1)
    noise = [rng.randbytes(300).hex(), base64.b64encode(rng.randbytes(300)).decode(), "to jest zwykły tekst po polsku którego nikt się nie uczył", "Это текст на русском языке который никто не учил"]
    clean = spark.read.parquet(f"{FOLDER}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    odd = frame([(10**9 + i, text) for i, text in enumerate(noise)], "cast(length(text) as bigint) as n_chars").select(*corpus_pipeline.COLUMNS)
    ids = {d for d, t in pairs(clean) if t and any(c.isalpha() for c in t)}
    kept = corpus_pipeline.keep_known_languages(spark, clean.unionByName(odd), FOLDER)
    assert {d for d, _ in pairs(kept)} == ids


def test_a_stage_frees_the_disk_of_the_one_before(spark):
    from pathlib import Path

    from veriframe.session import scratch_root

    folders = lambda: {p.name for p in Path(scratch_root(spark)).iterdir()}
    by_name = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    before = folders() if Path(scratch_root(spark)).exists() else set()
    unwritten = by_name["line_dedup"](spark, docs, FOLDER)
    own = folders() - before
    by_name["suffix_array_dedup"](spark, unwritten, FOLDER).count()  # still reads them
    assert own and own <= folders()
    written = cut_lineage(unwritten, "test")
    by_name["best_fit_packing"](spark, written, FOLDER).count()
    assert not own & folders() and written.count()
