import pytest


@pytest.fixture
def docs(spark):
    """Rows of ``documents`` from (doc_id, text[, source]) tuples, with extra columns whose names clash easily."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, id long, windows string")

    return make
