import pytest


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text[, lang, source]) tuples."""

    def build(*rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return build
