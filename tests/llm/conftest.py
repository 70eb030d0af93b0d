import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A table of documents from texts; ids count from 0, sources alternate."""

    def make(texts, sources=("a", "b")):
        return spark.createDataFrame([(k, t, "en", sources[k % len(sources)], len(t or "")) for k, t in enumerate(texts)], DOCS)

    return make


@pytest.fixture(scope="session")
def sample():
    """Texts of the smallest test table."""
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id").column("text").to_pylist()
