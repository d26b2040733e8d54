"""Fingerprints and components against plain Python."""

import random
import re

import numpy as np
import pytest
import xxhash

from sluiceway.llm import registry, simhash
from tests.llm.conftest import FOLDER


def plain(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints):
    """The smallest connected place for each fingerprint."""
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "a b c", "A b C d", "a b c d e", "É Straße x y z q " * 40])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def dense(seed, n, flips):
    rng = random.Random(seed)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    found = set()
    while len(found) < n:
        value = rng.choice(seeds)
        for bit in rng.sample(range(64), rng.randint(0, flips)):
            value ^= 1 << bit
        found.add(value)
    return sorted(found)


@pytest.mark.parametrize("prints", [dense(1, 300, 3), dense(2, 300, 9), list(range(400)), [0], [0, 2**64 - 1]])
def test_trie_join(prints):
    values = np.array(prints, np.uint64)
    found = simhash.trie_join(values, np.array([0]), np.array([len(values)]))
    assert found.tolist() == brute(prints)


def test_the_walk_finds_every_link_and_prunes():
    prints = dense(4, 400, 8) + [random.Random(5).getrandbits(64) for _ in range(2000)]
    prints = sorted(set(prints))
    tally = {}
    found = simhash.trie_join(np.array(prints, np.uint64), np.array([0]), np.array([len(prints)]), 0, tally)
    assert found.tolist() == brute(prints)
    assert tally["walked"] and tally["pruned"]
    # Most pairs are never compared.
    assert tally["compared"] < len(prints) ** 2 / 4


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_pairs_of_nodes_below_a_cut(depth):
    prints = dense(6, 250, 6)
    groups = {}
    for value in prints:
        top = value >> (64 - depth)
        for other in range(1 << depth):
            if (top ^ other).bit_count() <= 4:
                groups.setdefault((min(top, other), max(top, other)), []).append(value)
    place = {value: i for i, value in enumerate(prints)}
    edges = []
    for (a, b), group in groups.items():
        group = sorted(group)
        if a == b or len({v >> (64 - depth) for v in group}) == 2:
            found = simhash.trie_join(np.array(group, np.uint64), np.array([0]), np.array([len(group)]), depth)
            edges += [(place[v], place[group[r]]) for v, r in zip(group, found.tolist())]
    joined = simhash.Connected(len(prints))
    joined.link(*(np.array(side) for side in zip(*edges)))
    assert joined.root.tolist() == brute(prints)


def test_depth_grows_with_the_fingerprints():
    assert [simhash.depth_for(n) for n in (0, 1, 1 << 22, (1 << 22) + 1, 1 << 26)] == [6, 6, 6, 7, 10]


def clustered():
    """Fingerprints that agree in their first bits, so that one node holds nearly all."""
    rng = random.Random(7)
    return sorted({5 << 58 | rng.getrandbits(12) << rng.choice((0, 20)) for _ in range(300)} | {1 << 63, 3 << 62, 0})


@pytest.mark.parametrize("limit", [20_000, 7])
@pytest.mark.parametrize("prints", [dense(3, 300, 7), clustered()], ids=["dense", "clustered"])
def test_links_and_components(spark, limit, prints):
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in prints], "fingerprint long")
    found = {r.node: r.component for r in simhash.components(simhash.links(rows, limit)).collect()}
    root = brute(prints)
    groups = {}
    for value, place in zip(prints, root):
        groups.setdefault(place, set()).add(value - (1 << 64) if value >> 63 else value)
    for group in groups.values():
        assert {found.get(v, v) for v in group} == {min(group)}


def test_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    assert {r.component for r in simhash.components(edges).collect()} == {0}


def test_near_duplicates_of_odd_rows(docs):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (3, text), (None, text), (8, None), (7, ""), (None, "other words here now")]
    found = simhash.near_duplicates(docs(*rows)).collect()
    got = sorted(((r.doc_id, r.component_id) for r in found), key=str)
    assert got == sorted([(3, 3), (3, 3), (None, 3), (8, 7), (7, 7), (None, None)], key=str)
    kept = sorted(str(r.doc_id) for r in simhash.one_of_each(docs(*rows)).collect())
    assert kept == ["3", "7", "None"]
    assert simhash.one_of_each(docs(*rows)).columns == ["doc_id", "text", "score"]


def test_empty(docs):
    assert simhash.near_duplicates(docs()).count() == 0


def test_op10(spark, given):
    texts = sorted(tuple(r) for r in given("documents").select("doc_id", "text").collect())
    prints = [plain(t) for _, t in texts]
    root = brute(prints)
    want = {d: (f"{p:016x}", texts[r][0]) for (d, _), p, r in zip(texts, prints, root)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.op10_simhash(spark, FOLDER).collect()}
    assert got == want
