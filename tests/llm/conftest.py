import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents frame from texts; ids count up, sources take turns unless given."""

    def build(texts, ids=None, sources=None):
        rows = [((ids or range(len(texts)))[i], t, "en", sources[i] if sources else f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return build


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
