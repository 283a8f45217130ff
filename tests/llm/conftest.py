"""Small documents with every awkward case, shared by the operator tests."""

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_documents(spark):
    """A documents table from texts or (doc_id, text) pairs."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows], DOCUMENTS)

    return make


@pytest.fixture()
def sf_of(tmp_path):
    """Tables written as a test-data folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
