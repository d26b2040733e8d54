import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluiceway.llm import infill
from sluiceway.llm.infill import Recipe, SkipList

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ALWAYS = Recipe(rate=100)
ODD = ["", " ", "a", " a", "a ", "\n\n a\tb \x0b c\r\n", "ünïcode 漢字 \U0001f600\U0001f600 x", "a b c", "x" * 500]


@pytest.mark.parametrize("text", ODD)
def test_units_are_those_of_the_pattern(text):
    assert infill.unit_ends(text).tolist() == [m.end() for m in UNIT.finditer(text)]


@pytest.mark.parametrize("size", [0, 1, 2, 3, 4, 5, 17, 100, 5000])
def test_every_rank_is_found(size):
    lengths = np.random.default_rng(size).integers(1, 9, size)
    ends = np.cumsum(lengths)
    units = SkipList(ends)
    ranks = range(size + 1) if size < 200 else random.Random(1).sample(range(size + 1), 200)
    for rank in ranks:
        assert units.seek(rank) == (ends[rank - 1] if rank else 0)


def test_lanes_are_express():
    """Each lane is a part of the one below, and every lane is as wide as the text."""
    ends = np.cumsum(np.random.default_rng(3).integers(1, 9, 20_000))
    units = SkipList(ends)
    assert len(units.lanes) > 4
    for low, high in zip(units.lanes, units.lanes[1:]):
        assert len(high.units) < len(low.units) / 2
    for lane in units.lanes:
        assert lane.units.sum() == len(ends) and lane.points.sum() == ends[-1]


def _expected(key, text, recipe):
    import hashlib

    digest = hashlib.sha256(f"{recipe.seed}:{key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    units = UNIT.findall(text)
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in recipe.marks) or h[2] % 100 >= recipe.rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < recipe.suffix_first:
        return len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


@pytest.mark.parametrize("recipe", [ALWAYS, Recipe(), Recipe(seed=7, rate=100, suffix_first=0)])
def test_against_the_pattern(recipe):
    pick = random.Random(5)
    texts = ODD + ["a <P> b", "<S>", "x<M", "<P", "<<S", "S>P>M> <", "< S >"]
    texts += ["".join(pick.choice("ab<>PSM \n é") for _ in range(pick.randrange(60))) for _ in range(300)]
    for key, text in enumerate(texts):
        made = infill.cut(str(key), text, recipe)
        assert (made.n, made.form, made.prefix_chars, made.middle_chars, made.output) == _expected(key, text, recipe)
        assert infill.joined(made.output, made.form, recipe) == text


def test_rows(spark, docs):
    """Nulls, empty and very long texts, repeated rows and columns of the operator's own names."""
    long = " ".join(str(i) for i in range(300_000))
    given = docs((1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "x y"), (4, long), (5, "no <M> here"))
    given = given.withColumn("n", F.lit("other")).withColumn("form", F.lit(0))
    made = infill.fill_in_middle(given, ALWAYS)
    assert made.columns.count("n") == 1 and "score" in made.columns
    back = made.withColumn("back", infill.restore(F.col("output"), F.col("form"), ALWAYS))
    rows = back.collect()
    assert len(rows) == 7
    for row in rows:
        key = "" if row.doc_id is None else row.doc_id
        assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == _expected(
            key, row.text or "", ALWAYS
        )
        assert row.back == (row.text or "")
    assert rows[0] == rows[1]


def test_large_ids_keep_their_digits(spark):
    near = spark.createDataFrame([(2**60 + 1, "a b c d e f"), (None, "a b")], "doc_id long, text string")
    made = infill.fill_in_middle(near, ALWAYS).filter("doc_id IS NOT NULL").first()
    assert made.output == _expected(2**60 + 1, "a b c d e f", ALWAYS)[4]


def test_empty_table(spark, docs):
    assert infill.fill_in_middle(docs((1, "a")).filter("doc_id > 1")).collect() == []


def test_restore_of_nulls(spark):
    rows = spark.createDataFrame([(None, "spm"), ("x", None), ("x", "plain")], "o string, f string")
    found = rows.select(infill.restore(F.col("o"), F.col("f")).alias("t")).collect()
    assert [r.t for r in found] == [None, None, "x"]
