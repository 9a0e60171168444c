import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, x string, is_secret string"


def documents(spark, rows):
    """A table of documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, 9.5, "c", "y", None) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeats, ties, no letters, and one very long text."""
    long = "word and more of the same kind " * 40_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "short one"), (4, "short one"), (None, "short one"), (5, "short one"), (6, "1234 5678"), (7, long), (8, "é ü ß 漢字 🙂"), (9, "a" * 5000), (None, None)]
    return documents(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, []) if False else spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def plain(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
