import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, kept boolean"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table of the given (doc_id, text) rows, with columns whose names the
    operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, None, None, 0.5, "x", None) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return make


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here"), (5, "é日本 \x00 'll don't"),
    (6, "word " * 30_000), (7, "a" * 200_000), (8, "!!! ### |||"),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
