import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, with an extra column whose name clashes with inner ones."""
    from pyspark.sql import functions as F

    def make(texts, first=0, source="s"):
        rows = [(first + i, t, "en", source if isinstance(source, str) else source[i], None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS).withColumns({"text_hash": F.lit(1), "shard": F.lit("x"), "size": F.lit(2), "d": F.lit(3), "h": F.lit(4), "key": F.lit("k"), "n": F.lit(0), "place": F.lit(5), "row": F.lit(6)})

    return make


EDGE = [None, "", "one", "word " * 20_000, "a b c d e", "a b c d e", "\x0b\t \n", "Straße ΑΣ İ 한국어 😀", "x" * 30_000]


@pytest.fixture(scope="session")
def edge_docs(make_docs):
    return make_docs(EDGE)


@pytest.fixture(scope="session")
def empty_docs(make_docs, spark):
    return make_docs([])
