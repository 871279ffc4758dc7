import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Small documents table from rows (doc_id, text[, lang])."""

    def build(rows, extra=""):
        rows = [tuple(r) + (None,) * (3 - len(r)) for r in rows]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "'x' as source", *([extra] if extra else []))

    return build


@pytest.fixture(scope="session")
def con():
    from oracle import connect

    return connect("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def documents(con):
    return con.execute("select doc_id, text, lang, source from documents order by doc_id").df()
