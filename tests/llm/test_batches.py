"""What operators send to Python: batches of few bytes, and no Python workers for an empty list."""

import pandas as pd
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from sluiceway.llm import packing, simhash, toxicity
from sluiceway.llm.common import BATCH_SETTING

WORDS = public_tokenizers.path("word_bpe_49k.json")


def largest(docs):
    @F.pandas_udf("long")
    def rows_of_batch(texts: pd.Series) -> pd.Series:
        return pd.Series([len(texts)] * len(texts))

    return docs.coalesce(1).select(rows_of_batch("text").alias("n")).agg(F.max("n")).first()[0]


def score(docs):
    return toxicity.score(docs, docs.sparkSession.createDataFrame([(1, 0)], "doc_id long, toxic int"))


@pytest.mark.parametrize("operator", [score, simhash.near_duplicates, lambda docs: packing.pack(docs, WORDS)])
def test_batches_of_long_texts_are_bounded(spark, operator):
    docs = spark.newSession().range(24).selectExpr("id AS doc_id", "repeat('word ', 200000) AS text")
    assert largest(docs) == 24
    found = operator(docs)
    # Texts of a megabyte each, in batches of four megabytes and the text that passes the bound.
    assert largest(docs) <= 5
    assert found.select("doc_id").distinct().count() == 24


def test_own_setting_stays(spark):
    docs = spark.newSession().range(3).selectExpr("id AS doc_id", "'word' AS text")
    docs.sparkSession.conf.set(BATCH_SETTING, "1m")
    simhash.near_duplicates(docs)
    assert docs.sparkSession.conf.get(BATCH_SETTING) == "1m"


def test_packing_joins_no_list_from_python(docs):
    packed = packing.pack(docs((1, "some words"), (2, "more words")), WORDS)
    assert "ExistingRDD" not in packed._jdf.queryExecution().toString()
    assert packed.count() == 2
