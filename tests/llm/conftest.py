import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta " * 20_000


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text) pairs."""
    return lambda rows: spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], COLUMNS)


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and very long texts, ties, repeated rows."""
    return docs_of([(1, "the cat sat on the mat\nthe end"), (1, "the cat sat on the mat\nthe end"), (2, None), (3, ""), (None, "the cat sat on the mat\nthe end"), (None, None), (4, LONG), (5, "!!!"), (6, "the cat sat on the mat\nthe end"), (7, "ééé 中文 \U0001f600 \x00x")])


@pytest.fixture(scope="session")
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
