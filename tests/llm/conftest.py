import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """A table of documents from ids and texts, with a column whose name operators use themselves."""

    def make(*rows):
        return spark.createDataFrame(
            [(i, t, "kept") for i, t in rows], "doc_id long, text string, score string"
        )

    return make


@pytest.fixture
def given(spark):
    def read(name):
        return spark.read.parquet(f"{FOLDER}/{name}.parquet")

    return read
