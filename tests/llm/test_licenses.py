"""Patience alignment against the longest common subsequence, and license scans."""

import random

import pytest

from sluiceway.llm import licenses, registry
from tests.llm.conftest import FOLDER


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_align_is_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 12))]
        found = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
        assert len(found) <= longest(a, b)


def test_align_unique_words_is_longest():
    rng = random.Random(2)
    for _ in range(200):
        a, b = (rng.sample(range(14), rng.randint(0, 14)) for _ in range(2))
        assert len(licenses.align(a, b)) == longest(a, b)


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
def test_each_template_is_found_whole(scanner, name):
    text = "x y " * 200 + licenses.TEMPLATES[name].upper() + " z" * 300
    (found,) = scanner.scan(text)
    assert found[0] == name and found[3] == 1
    assert text[found[1] : found[2]].split() == licenses.TEMPLATES[name].upper().strip(". ").rstrip(".").split()


def test_changed_and_commented_text(scanner):
    lines = [f" * {line.strip()}" for line in licenses.TEMPLATES["MIT"].replace("copyright", "author").split("\n")]
    assert [m[0] for m in scanner.scan("\n".join(lines))] == ["MIT"]


def test_several_licenses(scanner):
    line = licenses.TEMPLATES["MIT notice"] + ". "
    assert len(scanner.scan(line * 500)) == 500
    stray = "is this work " + licenses.TEMPLATES["GPL-3.0 notice"]
    assert scanner.scan(stray)[0][1:] == (13, len(stray), 1.0)


@pytest.mark.parametrize(
    "name, old, new", [("MIT notice", "the", "an"), ("MIT", "copyright", "author"), ("ISC", "and", "or"), ("MIT", "Software", "work")]
)
def test_changed_copies_in_a_row(scanner, name, old, new):
    whole = licenses.TEMPLATES[name].strip()
    changed = whole.replace(old, new, 1)
    assert changed != whole
    for copies in ([changed] * 2, [changed] * 40, [changed, whole] * 10, [whole, changed] * 10):
        found = scanner.scan(".\n".join(copies))
        assert [m[0] for m in found] == [name] * len(copies)


@pytest.mark.parametrize("text", [None, "", "the of and license " * 3000, "under the license", "x" * 100_000])
def test_no_license(scanner, text):
    assert scanner.scan(text) == []


def test_rows(docs):
    text = licenses.TEMPLATES["MIT notice"]
    found = licenses.scan(docs((1, text), (1, text), (None, None), (3, ""))).collect()
    assert sorted((str(r.doc_id), len(r.licenses)) for r in found) == [("1", 1), ("1", 1), ("3", 0), ("None", 0)]
    assert licenses.scan(docs()).count() == 0


def test_op6(spark, given):
    lines = {name: text for name, text in licenses.TEMPLATES.items() if "\n" not in text}
    texts = dict(given("documents").select("doc_id", "text").collect())
    rows = registry.op6_licenses(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = {name for name, line in lines.items() if line in texts[r.doc_id]}
        assert want <= set(r.licenses.split(","))
        assert r.n_licenses >= len(want) and (want or not r.licenses)
