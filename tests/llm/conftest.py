import pytest


@pytest.fixture
def docs(spark):
    """A maker of document tables, with columns whose names clash with those of the operators."""
    def make(rows):
        rows = [(i, t, "en", "s", None if t is None else len(t), "x", "y") for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, fp string")
    return make
