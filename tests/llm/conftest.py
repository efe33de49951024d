import pytest


@pytest.fixture
def documents(spark):
    """Makes a table of documents, with columns whose names clash with those the operators add."""

    def make(rows):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, component_id int, length string"
        full = [(i, t, "en", s, len(t or ""), "own", 7, None) for i, t, s in ((*r, "a")[:3] for r in rows)]
        return spark.createDataFrame(full, schema).repartition(3)

    return make
