import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluiceway.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def _expected(rows, depth=4, least=30, covered=80, top=2000):
    """The same by counting every run of words."""
    runs, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            found = runs.setdefault(lang, Counter())
            found.update(tuple(words[i : i + m]) for m in range(1, depth + 1) for i in range(len(words) - m + 1))
    out = []
    for lang, found in runs.items():
        frequent = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        kept = []
        for phrase, a in frequent.items():
            score, _, left, right = min(
                (2_000_000 * a // (found[phrase[:k]] + found[phrase[k:]]), k, found[phrase[:k]], found[phrase[k:]])
                for k in range(1, len(phrase))
            )
            longer = max(
                (
                    b
                    for other, b in frequent.items()
                    if len(other) > len(phrase)
                    and any(other[i : i + len(phrase)] == phrase for i in range(len(other) - len(phrase) + 1))
                ),
                default=None,
            )
            if longer is None or 100 * longer < covered * a:
                kept.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], start=1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def _found(spark, rows, **options):
    table = spark.createDataFrame([(*r, 7) for r in rows], "lang string, text string, score int").repartition(3)
    made = phrases.collocations(table, **options)
    assert made.columns == COLUMNS
    return sorted(tuple(r) for r in made.collect())


def _texts(seed, many, words):
    pick = random.Random(seed)
    common = [f"w{i}" for i in range(words)] + ["Of", "The", "é", "漢字", "x y"]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "; ", "!", "\r\n"]
    for _ in range(many):
        lang = pick.choice(["en", "en", "de", None, "und", ""])
        yield lang, "".join(pick.choice(common) + pick.choice(ends) for _ in range(pick.randrange(80)))


def test_against_counting(spark):
    rows = [*_texts(1, 300, 9), ("en", None), ("en", ""), (None, "..,, "), ("fr", "only one word")]
    assert _found(spark, rows, least=5) == _expected(rows, least=5)


def test_common_leading_words(spark):
    """Pairs and threes that are too common for a route are counted over several."""
    pick = random.Random(3)
    rows = [("en", " ".join(pick.choice(["of the x", "of the", "of", f"w{pick.randrange(4)}"]) for _ in range(40))) for _ in range(200)]
    assert _found(spark, rows, least=4, route=64) == _expected(rows, least=4)


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_other_depths(spark, depth):
    rows = list(_texts(depth, 120, 5))
    assert _found(spark, rows, least=4, depth=depth, covered=50) == _expected(rows, depth, 4, 50)


def test_only_the_best(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PICK", 10)
    rows = list(_texts(9, 300, 12))
    assert _found(spark, rows, least=3, top=7) == _expected(rows, least=3, top=7)


def test_text_in_parts(spark, monkeypatch):
    """A long text is cut between words, and no phrase is lost or counted twice."""
    text = " ".join(f"w{i % 5} of.the x" for i in range(400)) + " " + "y" * 300
    parts = list(phrases.parts_of("en", text.encode(), 50, 4))
    assert len(parts) > 50 and b"".join(p.text[: p.own] for p in parts) == text.encode()
    monkeypatch.setattr(phrases, "CHUNK", 64)
    monkeypatch.setattr(phrases, "BLOCK", 5)
    rows = [("en", text), ("en", "a b c d " * 40), ("de", "z" * 1000)]
    table = spark.createDataFrame(rows, "lang string, text string")
    counted = Counter()
    for batch in table.toArrow().to_batches():
        for words in phrases._chunks(iter([batch]), 64, 4):
            found = phrases.suffixes_of(words, 4)
            names = [*words.texts.to_pylist(), None]
            for i, n in enumerate(found.count.tolist()):
                counted[(words.langs[found.columns[0][i]], *[names[c[i]] for c in found.columns[1:]])] += n
    wanted = Counter()
    for lang, body in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", body):
            words = piece.split()
            wanted.update((lang, *(words[i : i + 4] + [None] * 4)[:4]) for i in range(len(words)))
    assert counted == wanted


def test_equal_parts():
    """The quicksort finds every beginning of a suffix with its whole weight, and gives up the light ones."""
    pick = np.random.default_rng(4)
    columns = [pick.integers(0, 3, 4000), *[pick.integers(-1, 12, 4000) for _ in range(3)]]
    for one, behind in zip(columns[1:], columns[2:]):
        behind[one == phrases.END] = phrases.END
    weight = pick.integers(1, 5, 4000)
    wanted = Counter()
    for i, w in enumerate(weight.tolist()):
        row = [int(c[i]) for c in columns]
        for depth in range(1, 5):
            if row[depth - 1] == phrases.END:
                break
            wanted[tuple(row[:depth])] += w
    for least in (1, 40):
        found = {}
        for pointers, depths, totals in phrases.equal_parts(columns, weight, [least] * 4):
            for p, d, t in zip(pointers.tolist(), depths.tolist(), totals.tolist()):
                key = tuple(int(c[p]) for c in columns[:d])
                assert key not in found
                found[key] = t
        assert found == {k: n for k, n in wanted.items() if n >= least}


def test_products_beyond_64_bits(spark):
    """Counts near 2^50 score exactly."""
    big = 2**50 + 1
    known = [("a b", 2, big), ("b c", 2, big - 3), ("a b c", 3, 4 * big // 5 - 1)]
    counts = phrases.Counts(
        spark.createDataFrame([("en", *k) for k in known], "lang string, phrase string, words int, a bigint"),
        spark.createDataFrame([("en", "a", big + 1), ("en", "b", big + 2), ("en", "c", big)], "lang string, phrase string, a bigint"),
    )
    rows = {r.phrase: r for r in phrases.score_phrases(counts).collect()}
    assert rows["a b"].score == 2_000_000 * big // (2 * big + 3)
    assert rows["a b c"].score == 2_000_000 * (4 * big // 5 - 1) // (2 * big)
    # 100 f(a b c) is just over 80 f(b c), and just under 80 f(a b).
    assert set(rows) == {"a b", "a b c"}


def test_no_rows(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(none).collect() == []
    rare = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    assert phrases.collocations(rare).collect() == []


def test_repeated_rows_count_each(spark):
    rows = [("en", "to be or")] * 30
    made = _found(spark, rows)
    assert made == [("en", 1, "to be or", 30, 30, 30, 90, 1_000_000)]
    assert phrases.collocations(spark.createDataFrame(rows[:29], "lang string, text string")).select(F.count("*")).first()[0] == 0
