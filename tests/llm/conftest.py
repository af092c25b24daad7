import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def documents(spark):
    if not os.path.isdir(SF):
        pytest.skip("no driver test data")
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def make_docs(spark):
    """docs(rows) with the columns of documents; rows are (doc_id, text) or fuller tuples."""
    def docs(rows, extra=""):
        full = [(*r, *[None] * (5 - len(r))) if len(r) < 5 else r for r in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long" + extra)
    return docs
