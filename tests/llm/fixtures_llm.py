"""Shared by the tests of tessera.llm."""

import pytest

SF_SMALL = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text, ...) rows, short ones filled with nulls."""
    def make(rows):
        return spark.createDataFrame([tuple(r) + (None,) * (5 - len(r)) for r in rows], DOC_SCHEMA)
    return make
