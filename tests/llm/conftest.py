import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """A documents table from (doc_id, text, source) rows, with extra columns whose names operators use themselves."""

    def build(data):
        data = [(d, t, s, "x", 1, "y") for d, t, s in data]
        return spark.createDataFrame(data, "doc_id long, text string, source string, key string, rank int, `bucket` string")

    return build


ODD = [(None, "a b c d e f g", None), (1, None, "s"), (2, "", "s"), (3, " \t\n ", None), (4, "one", "t"), (4, "one", "t"), (5, "ä" * 5000 + " x " + "word " * 30000, "t")]


@pytest.fixture(scope="session")
def odd(rows):
    """Nulls, empty and blank texts, repeated rows, a long text."""
    return rows(ODD)
