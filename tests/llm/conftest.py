import pytest


@pytest.fixture()
def docs_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int")

    return make


@pytest.fixture()
def odd(docs_of):
    """Null ids and texts, empty, blank, ties, a repeated row, a very long text, a clashing column."""
    long = " ".join(f"word{i % 977} tail{i % 31}" for i in range(20000))
    rows = [(None, "a b c d e f g h", "en", "s", 1, 1), (1, None, "en", "s", 0, 1), (2, "", None, None, None, None), (3, " \n\t ", "en", "s", 4, 1), (4, "one two", "en", "s", 7, 1), (5, long, "en", "s", 1, 1), (6, long, "en", "s", 1, 1), (4, "one two", "en", "s", 7, 1), (7, "x" * 30000, "en", "s", 1, 1)]
    return docs_of(rows)


@pytest.fixture()
def none(docs_of):
    return docs_of([])
