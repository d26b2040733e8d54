"""Byte-pair encoding and packing against the tokenizers library."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sluiceway.llm import bpe, packing, registry
from tests.llm.conftest import FOLDER

BYTES, WORDS = registry.BYTE_VOCABULARY, registry.WORD_VOCABULARY
PARTS = ["a", "B", "the", "Foo.", " ", "  ", "\n", "\t", "'s", "'RE", "!", "1", "23", "é", "É", "ß", "Σ", "İ", "Ñ"]
PARTS += ["<|endoftext|>", "<|ENDOFTEXT|>", "　", "\x1c", "\x85", "中文", "😀", "é", ".", ",", "\r\n", "\xa0", "_", "²"]


def mixed(n, seed=1):
    choose = random.Random(seed)
    return ["".join(choose.choices(PARTS, k=choose.randint(0, 14))) for _ in range(n)]


def test_encode_and_decode_like_the_library():
    library, own = Tokenizer.from_file(BYTES), bpe.Codec(BYTES)
    for text in mixed(4000):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, text
        assert own.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["abcdethe" * 5000, "a" * 20_000, "é" * 3000, " " * 5000, "x" * bpe.LONG])
def test_long_pieces(text):
    library, own = Tokenizer.from_file(BYTES), bpe.Codec(BYTES)
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_decode_odd_ids():
    own = bpe.Codec(BYTES)
    assert own.decode(None) == "" and own.decode(np.array([], int)) == ""
    assert "�" in own.decode(np.array([own.id_of_byte[0xE9]]))
    with pytest.raises(ValueError):
        own.decode(np.array([1 << 20]))


def test_columns(docs):
    rows = docs((1, "a b"), (1, "a b"), (None, None), (3, ""))
    encoded = bpe.decode(bpe.encode(rows, BYTES), BYTES).collect()
    assert sorted((str(r.doc_id), r.decoded, len(r.ids), r.score) for r in encoded) == [
        ("1", "a b", 2, "kept"), ("1", "a b", 2, "kept"), ("3", "", 0, "kept"), ("None", "", 0, "kept"),
    ]


def test_op1(spark, given):
    library = Tokenizer.from_file(BYTES)
    found = {r.doc_id: r for r in registry.op1_bpe(spark, FOLDER).collect()}
    texts = given("documents").select("doc_id", "text").collect()
    assert len(found) == len(texts)
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert found[doc_id].n_tokens == len(ids)
        assert found[doc_id].ids_sha256 == hashlib.sha256(packed).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert found[doc_id].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_words_like_the_library():
    library, own = Tokenizer.from_file(WORDS), packing.Tokens(WORDS)
    for text in mixed(4000, 2):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, text


def test_best_fit_takes_the_tightest_bin():
    bins, offsets = packing.best_fit(np.array([5, 7, 3, 5, 10]), 10)
    used = np.bincount(bins, [5, 7, 3, 5, 10])
    assert sorted(used) == [10, 10, 10] and offsets[4] == 0 and offsets[2] == 7


def whole(rows, expected, capacity):
    """Checks that pieces cover their documents and sequences have no gaps."""
    library = Tokenizer.from_file(WORDS)
    got = sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = []
    for doc_id, text in expected:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want.append((doc_id or -1, piece, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert got == sorted(want)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values(), default=0) <= capacity
    return len(ends), sum(ends.values())


def test_pack_odd_rows(docs):
    rows = [(1, "a " * 30), (1, "a " * 30), (None, None), (4, ""), (5, "word " * 500), (6, "b")]
    # One document a partition, so that bins are combined over several levels.
    packed = packing.pack(docs(*rows).repartition(12), WORDS, capacity=64, fan_in=2).collect()
    n, total = whole(packed, rows, 64)
    assert n <= -(-total // 64) + 2


def test_pack_keeps_what_fits_nowhere(docs):
    rows = [(i, "a " * 39) for i in range(30)]
    n, _ = whole(packing.pack(docs(*rows).repartition(8), WORDS, capacity=64, fan_in=2).collect(), rows, 64)
    assert n == 30


def test_a_node_passes_on_few_bins(docs, monkeypatch):
    monkeypatch.setattr(packing, "KEEP", 1)
    node = packing.Node(1, 0, 64, 0)
    rows = packing.pieces(
        packing.pa.array(range(9)), packing.pa.array(["a " * 39] * 9), packing.Tokens(WORDS), 64, 0
    )
    assert sum(node.pack(rows)["open"].to_pylist()) == 1


def test_pack_empty(docs):
    assert packing.pack(docs(), WORDS).count() == 0


def test_op4(spark, given):
    rows = registry.op4_best_fit(spark, FOLDER).collect()
    n, total = whole(rows, [tuple(r) for r in given("documents").select("doc_id", "text").collect()], 2048)
    assert n <= 1.03 * (-(-total // 2048)) + 1


def test_vocabularies_are_found():
    assert BYTES == public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("lengths", [(1030, 1018), (1100, 900)])
def test_partitions_of_one_length_each(spark, lengths):
    """Documents sorted by length pack as well as mixed ones."""
    rows = [(n * 1000 + i, " ".join(["a"] * (length - 1))) for n, length in enumerate(lengths) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(2, "doc_id")
    made = packing.pack(docs, WORDS).collect()
    assert {r.length for r in made} == set(lengths) and len(made) == 2000
    assert len({r.sequence_id for r in made}) <= 1020


def test_no_bin_is_closed_while_shorter_pieces_follow(spark):
    """In one task 210,000 bins wait for the pieces that fill them."""
    n = 210_000
    docs = spark.range(0, 2 * n, 1, 2).selectExpr("id AS doc_id", f"if(id < {n}, 'a', '') AS text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        made = packing.pack(docs, WORDS, capacity=3, slack=0)
        made = made.selectExpr("count(*) pieces", "count(DISTINCT sequence_id) sequences").first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tuple(made) == (2 * n, n)


@pytest.mark.parametrize("seed", range(6))
def test_bins_held_back_are_of_no_use(seed):
    """A tree that passes on few bins of each length ends with as many as one that passes on all."""
    choose = random.Random(seed)
    leaves = []
    for _ in range(choose.choice([9, 20, 27])):
        sizes = np.array([choose.choice([33, 33, 33, 40, 60, 7, 3, 1]) for _ in range(choose.randint(1, 60))])
        bins, _ = packing.best_fit(sizes, 64)
        leaves.append(np.bincount(bins, sizes).astype(np.int64))

    def climb(fan_in, keep):
        levels = 0
        while fan_in**levels < len(leaves):
            levels += 1
        nodes, done, named = {}, 0, 0
        for i, used in enumerate(leaves):
            goes_on = [size for size in set(used.tolist()) for _ in range(min((used == size).sum(), keep * levels))]
            done += len(used) - len(goes_on)
            nodes.setdefault(i // fan_in, []).extend(goes_on)
        for above in reversed(range(levels)):
            up = {}
            for i, used in nodes.items():
                names = np.arange(named, named + len(used))
                named += len(used)
                rows = packing.pa.table({"bin": names, "length": packing.pa.array(used, packing.pa.int64())})
                found = packing.Node(above, i, 64, 0, keep).pack(rows).to_pylist()
                goes_on = [r["used"] for r in found if r["open"]]
                done += len({r["into"] for r in found}) - len(goes_on)
                up.setdefault(i // fan_in, []).extend(goes_on)
            nodes = up
        return done

    for fan_in in (2, 3):
        assert climb(fan_in, fan_in) == climb(fan_in, 10**6)
