import random
import re

import pytest
from pyspark.sql import functions as F

from sluiceway.llm import winnowing
from sluiceway.llm.registry import op11_winnowing

FOLDER = "/root/testdata/sf0.001"


def _words(text):
    found = re.findall(r"[a-zà-ÿ0-9]+", text.lower())
    return found or text.split()


def _choices(words, k, window):
    """Which runs of words are chosen: their places, and the words behind each."""
    return words and [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]


def _expected(spark, texts, k, window):
    """Winnowing in plain Python, over hashes that Spark gives for each run of words."""
    runs = sorted({run for t in texts for run in _choices(_words(t), k, window)})
    rows = spark.createDataFrame([(list(run),) for run in runs], "run array<string>")
    padded = [F.get("run", F.lit(i)) for i in range(k)]
    hashes = dict(zip(runs, [r[0] for r in rows.coalesce(1).select(F.xxhash64(*padded)).collect()]))
    for text in texts:
        of = [hashes[run] for run in _choices(_words(text), k, window)]
        chosen = {}
        for start in range(max(1, len(of) - window + 1)) if of else []:
            seen = of[start : start + window]
            least = min(seen)
            at = start + max(i for i, h in enumerate(seen) if h == least)
            chosen[at] = least
        yield sorted((at, h) for at, h in chosen.items())


@pytest.mark.parametrize(("k", "window"), [(3, 4), (1, 1), (2, 3), (5, 8)])
def test_against_plain_python(spark, docs, k, window):
    pick = random.Random(k)
    texts = ["", "a", "a b", "a b c", "A, b; C.", "aa " * 50, "!!! ??? !!!", " \n ", "é É è"]
    texts += [" ".join(pick.choice("abcde") for _ in range(pick.randrange(60))) for _ in range(60)]
    rows = docs(*enumerate(texts)).withColumn("fingerprint", F.lit("other"))
    made = winnowing.with_fingerprint(rows, k=k, window=window).orderBy("doc_id").collect()
    for row, wanted in zip(made, _expected(spark, texts, k, window), strict=True):
        assert [(f.position, f.hash) for f in row.fingerprint] == wanted, row.text


def test_shared_words_are_always_found(spark, docs):
    """Texts that share K + WINDOW - 1 words in a row share a choice, wherever the words stand."""
    pick = random.Random(2)
    rows = []
    for n in range(100):
        shared = [f"s{n}x{i}" for i in range(winnowing.K + winnowing.WINDOW - 1)]
        for side in "ab":
            around = [[f"{side}{n}y{pick.random()}" for _ in range(pick.randrange(9))] for _ in range(2)]
            rows.append((n, side, " ".join(around[0] + shared + around[1])))
    made = winnowing.with_fingerprint(spark.createDataFrame(rows, "n int, side string, text string"))
    pairs = made.groupBy("n").agg(*[F.max(F.when(F.col("side") == s, F.col("fingerprint"))).alias(s) for s in "ab"])
    found = pairs.select(
        winnowing.likeness(F.col("a"), F.col("b")).alias("near"),
        winnowing.shared_places(F.col("a"), F.col("b")).alias("places"),
    ).collect()
    assert len(found) == 100 and all(0 < r.near <= 1 and r.places for r in found)
    assert all(len(p.positions) == len(p.other_positions) == 1 for r in found for p in r.places)


def test_scripts_without_spaces(spark, docs):
    one, other = "漢字仮名交じり文の長い一行", "前置き漢字仮名交じり文の長い一行後"
    made = winnowing.with_fingerprint(docs((1, one), (2, other))).orderBy("doc_id").collect()
    assert len(made[0].fingerprint) > 1
    assert {f.hash for f in made[0].fingerprint} & {f.hash for f in made[1].fingerprint}


def test_odd_rows(spark, docs):
    long = " ".join(str(i) for i in range(200_000))
    rows = docs((1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, long))
    made = {(r.doc_id, r.text): r.fingerprint for r in winnowing.with_fingerprint(rows).collect()}
    assert made[1, None] == made[2, ""] == []
    assert len(made[4, long]) > 60_000
    assert winnowing.with_fingerprint(rows.filter("doc_id > 9")).collect() == []
    with pytest.raises(ValueError):
        winnowing.with_fingerprint(rows, k=0)


@pytest.mark.parametrize("rows", [1, 3, 7, 10_000])
def test_next_rows(spark, rows):
    """Every row gets the one behind it, over the bounds of ranges and at the end, with nulls and repeated keys."""
    pick = random.Random(rows)
    keys = [pick.randrange(-50, 50) * 10**15 for _ in range(60)] + [None, None]
    given = [(k, f"t{i:03}") for i, k in enumerate(keys)]
    table = spark.createDataFrame(given, "doc_id long, text string").repartition(5)
    made = winnowing.with_next(winnowing.dealt_by_order(table, "doc_id", rows), ["text"]).collect()
    order = sorted(given, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    wanted = {t: order[(i + 1) % len(order)][1] for i, (_, t) in enumerate(order)}
    assert {r.text: r.next.text for r in made} == wanted and len(made) == len(given)
    assert made[0].__fields__ == ["doc_id", "text", "next"]


def test_next_of_one_row_and_none(spark):
    one = spark.createDataFrame([(5, "t")], "doc_id long, text string")
    made = winnowing.with_next(winnowing.dealt_by_order(one, "doc_id"), ["text"]).collect()
    assert [(r.text, r.next.text) for r in made] == [("t", "t")]
    none = one.filter("doc_id > 5")
    assert winnowing.with_next(winnowing.dealt_by_order(none, "doc_id"), ["text"]).collect() == []


def test_query(spark, given):
    import hashlib

    texts = {r.doc_id: r.text or "" for r in given("documents").collect()}
    order = sorted(texts, reverse=True)
    made = op11_winnowing(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in made) == sorted(texts)
    edits = {}
    for row in made:
        text, behind = texts[row.doc_id], texts[order[(order.index(row.doc_id) + 1) % len(order)]]
        half = len(text) // 2
        edits[row.doc_id] = edited = text[: len(text) - half] + behind[:half]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row.near_next <= 1 and 0 <= row.near_edited <= 1
        if edited == text:
            assert row.near_edited == 1 and row.fingerprint == row.edited_fingerprint
    # The first half is kept, so about half of the fingerprint is.
    long = [r for r in made if r.n_chars > 300]
    assert sum(abs(r.near_edited - 0.5) < 0.25 for r in long) > 0.9 * len(long)
    assert sum(r.near_edited > r.near_next for r in long) > 0.97 * len(long)
    same = {}
    for row in made:
        assert same.setdefault(texts[row.doc_id], row.fingerprint) == row.fingerprint
    assert len(set(same.values())) > 0.95 * len(same)
