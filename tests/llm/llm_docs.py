"""A fixture that several tests of this folder import."""

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents frame from (doc_id, text) pairs, with the other columns of the table."""
    def make(pairs):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs],
                                     "doc_id long, text string, lang string, source string, n_chars long")
    return make
