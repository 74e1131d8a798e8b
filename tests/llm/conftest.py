import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, langs=None, sources=None, ids=None):
        rows = [(ids[k] if ids else k, t, langs[k] if langs else "en", sources[k] if sources else "s", None if t is None else len(t)) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs, spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing columns."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    df = make_docs([None, "", "  \n\t", "one", long, long, "a b c d e f", "a b c d e f"], [None] * 8, [None, "s", None, "s", "s", "s", "t", "t"], [0, 1, None, 3, 4, 5, 6, 6])
    from pyspark.sql import functions as F

    for c in ("id", "n", "s", "raw", "x", "size", "score", "spans", "kept", "a", "b", "ball", "chunk", "c"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
