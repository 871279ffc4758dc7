import zlib

import numpy as np

from veriframe.llm import toxicity as tox
from veriframe.llm.queries import QUERIES


def test_restores_hidden_words(spark, frame):
    docs = frame([(1, "the idiot and the moron met a stupid clown who was an idiot " * 50)])
    restorer = tox.Restorer(tox.language_model(tox.character_counts(docs)))
    for hidden in ("1d10t", "i.d.i.o.t", "idiiiiot", "i d i o t", "!d!0t"):
        assert restorer.restore(hidden) == ["idiot"]
    assert restorer.restore("m0r0n") == ["moron"]
    assert "idiot" in tox.tokens_of("you i d i o t there", restorer)


def test_counts_cover_all_text(frame):
    counts = tox.character_counts(frame([(1, "Ab"), (2, None), (3, "ab"), (4, "é")]))
    a, b = 1, 2
    assert counts[(0 * tox.SIZE + a) * tox.SIZE + b] == 2


def auc(scores, y):
    order = np.argsort(scores)
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    n1 = y.sum()
    return (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_query_held_out(spark):
    import duckdb

    rows = QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.01").toPandas()
    labels = duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.01/labels.parquet'").df()
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    assert (rows.held_out == rows.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    held = rows[rows.held_out].merge(labels, on="doc_id")
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.85


def test_odd_rows(spark, frame):
    rows = [(i, "plain words here and there" if i % 3 else "you are an idiot") for i in range(60)]
    docs = frame(rows + [(100, None), (101, ""), (102, "i d i o t"), (102, "i d i o t"), (None, "1d10t"), (103, "!" * 100000)], "1 as y")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    model = tox.fit(docs, docs, labels)
    got = {}
    for r in tox.score(docs, model).collect():
        got.setdefault(r.doc_id, set()).add(r.predicted)
    assert got[0] == got[102] == got[None] == {1} and got[1] == got[100] == got[101] == got[103] == {0}
    assert tox.score(docs.where("false"), model).count() == 0
    none = tox.fit(docs, docs, labels.where("false"))
    assert {r.score for r in tox.score(docs, none).collect()} == {0.0}


def test_restores_long_tokens(spark, frame):
    """Tokens of any length are decoded, in time that grows with their length."""
    docs = frame([(1, "the idiot and the moron met a stupid clown who was an idiot " * 50)])
    restorer = tox.Restorer(tox.language_model(tox.character_counts(docs)))
    sentence = "the.moron.met.a.stupid.clown." * 20 + "1d10t"
    assert restorer.restore(sentence) == ["the", "moron", "met", "a", "stupid", "clown"] * 20 + ["idiot"]
    assert "idiot" in tox.features(sentence, restorer) and "idiot" in tox.features("id" + "i" * 500 + "ot", restorer)
    assert restorer.restore("the_moron_met_" * 20_000) == ["the", "moron", "met"] * 20_000


def test_scores_long_tokens(spark, frame):
    docs = frame([(i, "plain words here and there" if i % 3 else "you are an idiot") for i in range(60)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id bigint, toxic int")
    model = tox.fit(docs, docs, labels)
    odd = frame([(1, "here_and_there_" * 20 + "idiot"), (2, "here_and_there_" * 20 + "plain"), (3, "id" + "i" * 300 + "ot")])
    assert {r.doc_id: r.predicted for r in tox.score(odd, model).collect()} == {1: 1, 2: 0, 3: 1}
