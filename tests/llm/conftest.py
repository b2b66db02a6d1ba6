import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark):
    """(doc_id, text) of the smallest documents table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, repeated, very long and odd texts, with columns of clashing names."""
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "null id here"), (4, " \n\t "), (5, "é ü 漢字 🎉 mixed"), (6, "word " * 30_000), (7, "x" * 300_000), (None, None)]
    return spark.createDataFrame([(i, t, "en", "s", 0, "c", "h", 1, "v") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, id string, key string, spans int, value string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
