"""Empty tables, repeated rows, clashing columns and very long texts, where an operator's own tests have none."""

import public_tokenizers
from pyspark.sql import functions as F

from sluiceway.llm import bpe, licenses, rules, toxicity

BYTES = public_tokenizers.path("byte_bpe_50k.json")
CLASHING = ["key", "doc", "row", "rule", "kept", "ids", "licenses", "held_out", "predicted", "n_words"]


def clashing(table):
    return table.withColumns({name: F.lit("own") for name in CLASHING})


def test_empty_tables(spark, docs):
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    assert bpe.encode(docs(), BYTES).count() == 0
    assert toxicity.score(docs(), labels).count() == 0
    assert rules.judge(docs(), labels).count() == 0
    assert licenses.scan(docs()).count() == 0


def test_no_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    table = docs((1, "some words"), (2, " ".join(f"word{i}" for i in range(80))))
    assert all(0 <= r.score < 1e-6 for r in toxicity.score(table, labels).collect())
    assert {r.doc_id: r.kept for r in rules.judge(table, labels).collect()} == {1: False, 2: True}


def test_repeated_rows_and_clashing_columns(spark, docs):
    text = " ".join(f"word{i}" for i in range(80))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    table = clashing(docs((1, text), (1, text), (None, None), (None, "")))
    judged = sorted((str(r.doc_id), r.n_words, r.kept) for r in rules.judge(table, labels).collect())
    assert judged == [("1", 80, True), ("1", 80, True), ("None", 0, False), ("None", 0, False)]
    assert len(toxicity.score(table, labels).collect()) == 4
    assert sorted(len(r.licenses) for r in licenses.scan(table).collect()) == [0, 0, 0, 0]
    # The column that is asked for takes the place of one of the same name.
    assert sorted(len(r.ids) for r in bpe.encode(table, BYTES).collect())[:2] == [0, 0]


def test_very_long_texts(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    table = docs((1, " ".join(f"w{i}" for i in range(200_000))), (2, "x" * 1_000_000))
    judged = {r.doc_id: (r.n_words, r.word_chars, r.n_repeat_words) for r in rules.judge(table, labels).collect()}
    assert judged[1][0] == 200_000 and judged[1][2] == 0 and judged[2] == (1, 1_000_000, 0)
    assert len(toxicity.score(table, labels).collect()) == 2
