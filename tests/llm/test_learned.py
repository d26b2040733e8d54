"""Learned operators: toxicity, language and quality rules."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sluiceway.llm import language, registry, rules, toxicity
from tests.llm.conftest import FOLDER


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


# Toxicity


def test_pairs_of_terms_matter():
    """A label that no sum of weights gives: exactly one of two terms is there."""
    rng = np.random.default_rng(1)
    found = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(2000)]
    label = np.array([float((0 in f) != (1 in f)) for f in found])
    machine = toxicity.fit(np.arange(6), found, label)
    right = [(machine.logit(f) > 0) == bool(y) for f, y in zip(found, label)]
    assert np.mean(right) > 0.95


def test_toxic_terms_are_learned(docs, spark):
    rng = np.random.default_rng(2)
    words = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(words, 20))
        rows.append((i, text + (" Nasty!" if i % 4 == 0 else "")))
    rows += [(None, "nasty"), (1000, None), (1001, ""), (1002, "nasty " * 20_000)]
    labels = spark.createDataFrame(
        [(i, int(i % 4 == 0)) for i in range(400)] + [(5, None), (None, 1), (7, 0)], "doc_id long, toxic int"
    )
    scored = toxicity.score(docs(*rows), labels).collect()
    assert len(scored) == len(rows)
    found = {r.doc_id: r for r in scored}
    assert all(found[i].predicted == (i % 4 == 0) for i in range(400))
    assert all(found[i].held_out == held_out(i) for i in range(400))
    assert found[1000].score == found[1001].score < 0.5 <= found[1002].score and found[None].predicted == 1


@pytest.mark.parametrize("toxic, want", [([], 0.0), ([0, 0], 0.0), ([1, 1], 1.0)])
def test_nothing_to_learn(docs, spark, toxic, want):
    labels = spark.createDataFrame([(i + 1, y) for i, y in enumerate(toxic)], "doc_id long, toxic int")
    rows = [(i, "a b") for i in range(6)]
    assert {round(r.score, 6) for r in toxicity.score(docs(*rows), labels).collect()} == {want}


def test_op5(spark, given):
    rows = registry.op5_factorization(spark, FOLDER).collect()
    assert len(rows) == given("documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == held_out(r.doc_id) for r in rows)


# Language


def test_backoff_to_shorter_sequences():
    model = language.fit(
        ["der", "hallo", "hello", "the"], ["de", "en"], np.array([[9, 0], [5, 0], [0, 5], [0, 9]])
    )
    score = model.scorer()

    def best(word):
        return model.languages[int(np.frombuffer(score(word), np.float32).argmax())]

    assert best("hello") == "en" and best("der") == "de"
    assert best("helloing") == "en" and best("halloing") == "de"
    assert best("xd") == "de"  # by the single letter
    assert not np.frombuffer(score("zzz"), np.float32).any()


def test_languages_of_odd_rows(spark):
    english, german = "the house and the garden of the king", "das haus und der garten von dem koenig"
    rows = [(i, english if i % 2 else german, "en" if i % 2 else "de", "x") for i in range(60)]
    rows += [(70, "THE garden, and the house!", None, "x"), (71, None, "en", "x"), (72, "12 34 ² _", "en", "x")]
    rows += [(None, german, None, "x"), (70, german, None, "x"), (73, "der " * 30_000, None, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = sorted((str(r.doc_id), r.lang_pred) for r in language.languages(table).collect() if r.doc_id is None or r.doc_id > 60)
    assert got == [("70", "de"), ("70", "en"), ("71", "und"), ("72", "und"), ("73", "de"), ("None", "de")]
    assert all(0 <= r.score <= 1 for r in language.languages(table).collect())


def test_no_language_to_learn(spark):
    table = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.languages(table).collect()] == [("und", 0.0)]
    assert language.languages(table.limit(0)).count() == 0


def test_op7(spark, given):
    rows = {r.doc_id: r for r in registry.op7_language(spark, FOLDER).collect()}
    known = dict(given("documents").select("doc_id", "lang").collect())
    held = [doc_id for doc_id in known if held_out(doc_id)]
    assert len(rows) == len(known) and held
    assert np.mean([rows[i].lang_pred == known[i] for i in held]) > 0.95


# Quality rules


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


ODD = [None, "", " \n\t ", "x y", "a b c", "a b c a b c", "a a a a a", "a\nb\na\n \n \nb\x0bc\n", "é <b> é <b> é z\r\n", "😀 | 😀"]


def test_statistics(docs):
    texts = ODD + ["a b " * 20_000, "w" * 100_000, " ".join(map(str, range(30_000)))]
    found = {r.key: tuple(r[c] for c in rules.BASE) for r in rules.statistics(docs(*enumerate(texts))).collect()}
    assert [found[i] for i in range(len(texts))] == [plain(t) for t in texts]


@pytest.mark.parametrize(
    "text, lines",
    [("foo\r\nbar\r\nfoo\r\n", 1), (" foo\nbar\n foo", 1), ("foo\nfoo ", 0), ("\n\nfoo\nfoo\n\n", 1)],
)
def test_lines_are_whole(docs, text, lines):
    (row,) = rules.statistics(docs((1, text))).collect()
    assert row.n_dup_lines == lines
    assert tuple(row[c] for c in rules.BASE) == plain(text)


def test_rules_are_learned_in_order(docs, spark):
    rng = np.random.default_rng(3)

    def text(kind):
        words = [f"w{n}" for n in rng.integers(0, 10_000, 80)]
        if kind == 1:
            words[::4] = ["#"] * 20
        if kind == 2:
            words = [w.upper() + "LOUD!" for w in words]
        return " ".join(words)

    rows = [(i, text(i % 4)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 in (0, 3))) for i in range(600)] + [(1, None)], "doc_id long, quality int")
    judged = rules.judge(docs(*rows, (None, None), (700, rows[0][1]), (700, rows[1][1])), labels).collect()
    found = {r.doc_id: r for r in judged if r.doc_id != 700}
    assert all(found[i].kept == (i % 4 in (0, 3)) for i in range(600))
    assert len({found[i].rule for i in range(600)}) == 3
    assert found[None].base_failed and not found[None].kept
    assert sorted(r.kept for r in judged if r.doc_id == 700) == [False, True]


def test_nothing_learned(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    words = " ".join(f"w{i}" for i in range(60))
    judged = rules.judge(docs((1, words), (2, "few")), labels).collect()
    assert sorted((r.doc_id, r.kept) for r in judged) == [(1, True), (2, False)]
    assert rules.judge(docs(), labels).count() == 0


def test_op9(spark, given):
    texts = dict(given("documents").select("doc_id", "text").collect())
    rows = registry.op9_rules(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, *_, repeated = want = plain(texts[r.doc_id])
        assert tuple(r[c] for c in rules.BASE) == want
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert not (r.kept and r.base_failed)


def test_no_python_in_native_operators(spark, given):
    for name in ("op2_personal_data", "op9_rules"):
        plan = registry.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_luck_is_the_tail_of_drawing_without_putting_back():
    from math import comb

    for poor, covered, all_poor, everything in ((0, 3, 4, 20), (2, 2, 2, 82), (1, 1, 1, 1000), (3, 5, 6, 30), (5, 5, 5, 5)):
        ways = sum(
            comb(all_poor, k) * comb(everything - all_poor, covered - k) for k in range(poor, min(covered, all_poor) + 1)
        )
        assert abs(rules.luck(poor, covered, all_poor, everything) - ways / comb(everything, covered)) < 1e-9


def test_a_rule_of_two_conditions_where_neither_is_enough(spark):
    rng = random.Random(11)
    stats, labels = [], []
    for i in range(1200):
        symbols, shouts = rng.random() < 0.3, rng.random() < 0.3
        n = rng.randint(100, 300)
        stats.append((i, n, 5 * n, 40 if symbols else rng.randint(0, 5), 0, 0, 10, 0, 5, 60 if shouts else rng.randint(0, 5)))
        labels.append((i, 0 if symbols and shouts else 1))
    names = "key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    rows = spark.createDataFrame(stats, names + ", n_capitals long, n_marks long, n_shouts long")
    learned = rules.learn(rows, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert {c.feature for c in learned[0]} == {"symbols_per_word", "shouts_per_word"}
    got = {r.key for r in rows.withColumn("rule", rules.decision(learned)).filter("rule IS NOT NULL").collect()}
    assert got == {i for i, label in labels if label == 0}


def test_nothing_is_learned_from_chance_labels(spark):
    rng = random.Random(12)
    stats = [(i, 200, 1000, rng.randint(0, 50), 0, 0, 10, rng.randint(0, 50), 5, rng.randint(0, 50)) for i in range(800)]
    names = "key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    rows = spark.createDataFrame(stats, names + ", n_capitals long, n_marks long, n_shouts long")
    labels = [(i, 0 if rng.random() < 0.1 else 1) for i in range(800)]
    assert rules.learn(rows, spark.createDataFrame(labels, "doc_id long, quality int")) == []


def test_a_rule_has_as_many_conditions_as_it_takes(spark):
    """Poor texts are those where five statistics are high."""
    bits = "transform(sequence(0, 8), i -> if(i < 5, int(shiftright(id, i) & 1), 0))"
    rows = spark.range(640).selectExpr("int(id % 32 = 31) AS poor", "1 AS part", f"{bits} AS bins")
    rule = rules._grow(rows, [[0.5]] * len(rules.FEATURES))
    assert {c.feature for c in rule} == set(list(rules.FEATURES)[:5]) and all(c.above for c in rule)


def test_as_many_rules_as_there_are_kinds_of_poor_texts(spark):
    """Texts are poor where the number of symbols is odd: twelve ranges, each between good ones."""
    stats = spark.range(25 * 100).selectExpr("id AS key", "id % 25 AS n_symbols")
    for name, value in [("n_words", 1000), ("word_chars", 5000), ("n_lines", 10)]:
        stats = stats.selectExpr("*", f"{value}L AS {name}")
    for name in ("n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "n_shouts"):
        stats = stats.selectExpr("*", f"0L AS {name}")
    labels = stats.selectExpr("key AS doc_id", "int(n_symbols % 2 = 0) AS quality")
    learned = rules.learn(stats, labels)
    found = stats.select("n_symbols", rules.decision(learned).isNotNull().alias("poor")).distinct().collect()
    assert {r.n_symbols: r.poor for r in found} == {n: n % 2 == 1 for n in range(25)}
