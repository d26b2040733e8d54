"""Byte-pair encoding and decoding with a public byte-level vocabulary.

Text is cut into pieces, each piece into bytes, and a short piece is merged on a
contiguous rank array: the boundaries of its parts, and beside them the rank of every
adjacent pair. The smallest rank is searched by a scan, its boundary deleted, and the
two neighbouring ranks looked up again. A scan costs time in the square of the
length, so a piece of more than ``LONG`` bytes keeps its ranks in a heap instead; the
merges, and so the ids, are the same.

Null text is encoded like empty text: no ids. Ids that the vocabulary lacks raise a
``ValueError``; null ids decode to empty text. Special tokens written out in a text
become their own ids, as the tokenizers library does by default. Rows are encoded each on its own, and an empty
table gives no rows. Columns go along; one of the name of the result is replaced by it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Longer pieces use a heap.
LONG = 96
# Words, and pieces, that a Python worker keeps encoded: twice as many at most.
CACHE = 1 << 18

# Fixed value: how byte-level vocabularies split text.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# A space that does not simply lead a word; only then do pieces depend on more than one word.
ODD_SPACE = r" (?:\p{White_Space}|\Z)"


def byte_of_letter() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others take the letters from U+0100 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Recent(dict):
    """A bounded memory: what was not asked for while it filled up once is dropped."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= LONG:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Codec:
    """One vocabulary, with the words it has met.

    Parts are held as ids. The merge of a pair of ids is one integer, rank before id,
    so that the least integer is the least rank.
    """

    SHIFT = 24
    NONE = 1 << 62

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = byte_of_letter()
        ids = content["model"]["vocab"]
        self.bytes_of = {number: bytes(letters[c] for c in token) for token, number in ids.items()}
        single = {token: number for number, token in self.bytes_of.items() if len(token) == 1}
        self.id_of_byte = [single[bytes([b])] for b in range(256)]
        self.merges = {}
        for rank, merge in enumerate(content["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = ids[left] << self.SHIFT | ids[right]
            self.merges[pair] = rank << self.SHIFT | ids[left + right]
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.special = {name: self._packed([number]) for name, number in special.items()}
        self.bytes_of |= {number: name.encode() for name, number in special.items()}
        self.pieces = regex.compile(PIECES)
        self.odd_space = regex.compile(ODD_SPACE)
        # The longest name first, as the leftmost longest one counts.
        names = sorted(special, key=lambda name: (-len(name), name))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.known_pieces = Recent(lambda piece: self._packed(self.merged(piece.encode("utf-8"))))
        self.known_words = Recent(self._word)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        parts = list(map(self.id_of_byte.__getitem__, piece))
        return self._scan(parts) if len(parts) <= LONG else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        """All merges of a short piece, by scans over the array of ranks."""
        shift, none, merge = self.SHIFT, self.NONE, self.merges.get
        low = (1 << shift) - 1
        # ranks[i] belongs to the boundary between parts[i] and parts[i + 1].
        ranks = [merge(a << shift | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            parts[i] = least & low
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = merge(parts[i - 1] << shift | parts[i], none)
            if i < len(ranks):
                ranks[i] = merge(parts[i] << shift | parts[i + 1], none)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        """The same for a long piece: the least rank comes from a heap, the leftmost first."""
        shift, merge = self.SHIFT, self.merges.get
        low = (1 << shift) - 1
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n:
                found = merge(parts[left] << shift | parts[right])
                if found is not None:
                    heapq.heappush(heap, (found, left, right, parts[left], parts[right]))

        for left in range(n - 1):
            offer(left, left + 1)
        while heap:
            found, left, right, *were = heapq.heappop(heap)
            if after[left] != right or [parts[left], parts[right]] != were:
                continue
            parts[left], parts[right] = found & low, -1
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [part for part in parts if part >= 0]

    def _word(self, word: str) -> bytes:
        """The ids of a word with the space before it."""
        if word.isalpha():
            return self._packed(self.merged(b" " + word.encode("utf-8")))
        return self._split(" " + word)

    def _split(self, text: str) -> bytes:
        words, pieces = self.known_words, self.known_pieces
        return b"".join(
            [words[p[1:]] if p[0] == " " and p[1:].isalpha() else pieces[p] for p in self.pieces.findall(text)]
        )

    def _plain(self, text: str) -> bytes:
        """The ids of text without special tokens."""
        if self.odd_space.search(text):
            return self._split(text)
        # A single space before something visible always starts a piece, so words are independent.
        first, *words = text.split(" ")
        return self._split(first) + b"".join(map(self.known_words.__getitem__, words))

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.specials is None or not any(name in text for name in self.special):
            return self._plain(text)
        parts = self.specials.split(text)
        return b"".join(self.special[p] if i % 2 else self._plain(p) for i, p in enumerate(parts) if p)

    def decode(self, ids: np.ndarray | None) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        if ids is None or not len(ids):
            return ""
        try:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        except KeyError as missing:
            raise ValueError(f"the vocabulary has no id {missing}") from None


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """The codec of a vocabulary file, read once by each Python worker."""
    return Codec(path)


def _text(value: object) -> str | None:
    return value if isinstance(value, str) else None


def encode(docs: DataFrame, vocabulary: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add a column of ids, ``array<int>``.

    ``vocabulary`` is the path of a byte-level tokenizer file that all executors have.
    """

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(vocabulary)
        for part in texts:
            yield pd.Series([np.frombuffer(own.encode(_text(t)), "<i4") for t in part], dtype=object)

    return docs.withColumn(into, ids(F.col(f"`{text}`")))


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add a column with the text of a column of ids."""

    @F.pandas_udf("string")
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(vocabulary)
        for part in parts:
            yield pd.Series([own.decode(None if i is None else np.asarray(i)) for i in part], dtype=object)

    return docs.withColumn(into, texts(F.col(f"`{ids}`")))


def round_trip(text: Column, vocabulary: str) -> Column:
    """Encode, decode again, and keep only ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    For the check of a whole corpus: ids and texts stay inside the Python worker.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(vocabulary)
        for part in texts:
            found = []
            for t in part:
                packed = own.encode(_text(t))
                decoded = own.decode(np.frombuffer(packed, "<u4"))
                found.append(
                    (
                        len(packed) // 4,
                        hashlib.sha256(packed).hexdigest(),
                        hashlib.sha256(decoded.encode("utf-8")).hexdigest(),
                    )
                )
            yield pd.DataFrame(found, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(text)
