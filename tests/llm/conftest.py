import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Frame from rows, in several partitions."""
    def build(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)
    return build


DOCS = "doc_id bigint, text string"
#: Columns whose names clash with the operators' own.
EXTRA = "doc_id bigint, text string, lang string, source string, n_chars bigint, name string, pos int, row int, key string, component string, hash string"


@pytest.fixture(scope="session")
def docs(make):
    def build(texts, extra=False, parts=3):
        rows = [(i, t) for i, t in texts] if texts and isinstance(texts[0], tuple) else list(enumerate(texts))
        if extra:
            return make([(i, t, "en", "s", 1, "n", 2, 3, "k", "c", "h") for i, t in rows], EXTRA, parts)
        return make(rows, DOCS, parts)
    return build
