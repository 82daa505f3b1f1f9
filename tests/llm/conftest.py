import pytest

SCHEMA = "doc_id long, text string, lang string, source string, kept string, score double"


@pytest.fixture
def docs(spark):
    def make(texts, lang="en"):
        return spark.createDataFrame([(i, t, lang, "s0", "x", None) for i, t in enumerate(texts)], SCHEMA)

    return make


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a very long text, clashing columns."""
    long_text = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (None, None, None, None, None, None), (1, None, "en", "s0", "x", 1.0), (2, "", "en", None, None, None),
        (3, " \n\t ", None, "s0", None, None), (4, "one two", "de", "s1", None, None), (4, "one two", "de", "s1", None, None),
        (5, long_text, "en", "s1", None, None), (None, "text without an id", "en", "s1", None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
