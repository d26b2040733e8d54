"""Phrases whose words keep together, counted by multikey quicksort of suffix pointers.

Every word of a corpus begins a suffix: it and the words behind it in its piece, up to the
longest phrase. Tasks cut their texts into words, count equal suffixes, and send each to a
route by its language and two leading words. On a route the pointers to its suffixes are
sorted by a three-way quicksort, word by word: the pointers that are equal to the pivot are
one phrase, and how many occurrences they stand for is its count; they alone are sorted on
by the next word. Parts that stand for fewer occurrences than a phrase needs are given up,
so most of a corpus is never sorted to its end. Parts are cut all at once, round by round,
so that the work is on whole arrays.

The first pass over the texts counts the words of each language, and finds the leading
pairs and threes of words that are too common for a route. Suffixes with such a pair are
routed by their third word too, and with such a three by their fourth; what a pair or a
three counts on each of these routes is added up. At most ``HOT`` of each can be so common, so
the list that goes to the tasks is bounded, and only sends suffixes elsewhere.

Scores are whole numbers from exact decimals. Null text is empty, a null language ``und``.
Documents count each on their own, repeated ones too, and other columns are not read. A long text is
cut between words into parts, and each part sees the words behind it. Without a frequent phrase,
or any row, the result has no rows. All words that a score needs are at least as frequent as the phrase.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sluiceway.llm.common import saved

# The longest phrase, in words, how often a phrase must occur, and how many a language lists.
DEPTH = 4
LEAST = 30
TOP = 2000
# A phrase is dropped for a longer one with this share of its count, in hundredths.
COVERED = 80
SCALE = 2_000_000

# Bytes of text that a task takes up at once, suffixes that a route is meant to hold, and records in a row.
CHUNK = 6 << 20
ROUTE = 1_000_000
BLOCK = 1 << 16
# No more than so many pairs, and threes, can each begin more than this part of all suffixes.
HOT = 1 << 18
# Rows of which one window picks the best before they meet.
PICK = 1_000_000

BLANKS = b" \t"
BREAKS = b".,;:!?\n\x0b\x0c\r"
END = -1

_WORD, _BLANK, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = _BLANK
_KIND[list(BREAKS)] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_EDGE = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")


@dataclass(frozen=True)
class Part:
    """A text or a part of one; words that begin behind ``own`` bytes are only looked at."""

    lang: str
    text: bytes
    own: int


def parts_of(lang: str, text: bytes, size: int, depth: int) -> Iterator[Part]:
    """A text in parts of about ``size`` bytes, cut between words."""
    ahead = re.compile(rb"(?:[ \t]*[^ \t.,;:!?\n\x0b\x0c\r]+){0,%d}" % (depth - 1))
    at = 0
    while len(text) - at > size:
        edge = _EDGE.search(text, at + size)
        if not edge:
            break
        cut = edge.start()
        yield Part(lang, text[at : ahead.match(text, cut).end()], cut - at)
        at = cut
    yield Part(lang, text[at:], len(text) - at)


@dataclass(frozen=True)
class Words:
    """The words of some parts: their texts, and per word the number of its text, language and piece."""

    texts: pa.Array
    langs: list[str]
    text: np.ndarray
    lang: np.ndarray
    piece: np.ndarray
    own: np.ndarray

    def behind(self, steps: int) -> np.ndarray:
        """The text of the word so many words on in the same piece, or ``END``."""
        found = np.full(len(self.text), END, np.int64)
        if steps < len(self.text):
            same = self.piece[steps:] == self.piece[: len(self.text) - steps]
            found[: len(same)][same] = self.text[steps:][same]
        return found


def words_of(parts: list[Part]) -> Words:
    """Cut parts into words, in lower case, by whole arrays of bytes."""
    # A break between parts ends the piece.
    data = np.frombuffer(b"\n".join(p.text for p in parts), np.uint8)
    kind = _KIND[data]
    word = kind == _WORD
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    values = _LOWER[data[word]]
    texts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(values))
    coded = texts.dictionary_encode()
    piece = np.cumsum(kind == _BREAK, dtype=np.int32)[starts]
    begins = np.cumsum([0, *[len(p.text) + 1 for p in parts[:-1]]])
    part = np.repeat(np.arange(len(parts)), np.diff(np.append(np.searchsorted(starts, begins), len(starts))))
    langs = list(dict.fromkeys(p.lang for p in parts))
    number = {lang: i for i, lang in enumerate(langs)}
    return Words(
        coded.dictionary,
        langs,
        coded.indices.to_numpy().astype(np.int64),
        np.array([number[p.lang] for p in parts], np.int64)[part],
        piece,
        starts - begins[part] < np.array([p.own for p in parts])[part],
    )


def _chunks(batches: Iterator[pa.RecordBatch], size: int, depth: int) -> Iterator[Words]:
    """The words of about ``size`` bytes of text at a time."""
    parts, held = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            for part in parts_of(lang, text, size, depth):
                if held and held + len(part.text) > size:
                    yield words_of(parts)
                    parts, held = [], 0
                parts.append(part)
                held += len(part.text)
    if parts:
        yield words_of(parts)


def _mixed(seed: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Hashes of rows so far, with those of one more column."""
    mixed = (seed ^ value) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _hashes(texts: list[str]) -> np.ndarray:
    """The hash of each text, and behind them that of ``END``."""
    return np.array([*[xxhash.xxh64_intdigest(t) for t in texts], 0], np.uint64)


@dataclass(frozen=True)
class Suffixes:
    """Different suffixes with how often each occurs; the columns are the language and the words."""

    columns: list[np.ndarray]
    count: np.ndarray

    def hashes(self, words: Words) -> list[np.ndarray]:
        """Hashes of the language, of it and the first word, and so on."""
        of_lang, of_text = _hashes(words.langs), _hashes(words.texts.to_pylist())
        found = [of_lang[self.columns[0]]]
        for column in self.columns[1:]:
            found.append(_mixed(found[-1], of_text[column]))
        return found


def suffixes_of(words: Words, depth: int) -> Suffixes:
    """The suffixes that begin at the words of their own, equal ones once."""
    at = np.flatnonzero(words.own)
    columns = [words.lang[at], words.text[at], *[words.behind(n)[at] for n in range(1, depth)]]
    many = len(words.texts) + 1
    label = columns[0]
    for column in columns[1:]:
        # Labels stay below the number of words, so this fits 64 bits for any chunk that fits memory.
        label = np.unique(label * many + (column + 1), return_inverse=True)[1]
    _, first, count = np.unique(label, return_index=True, return_counts=True)
    return Suffixes([column[first] for column in columns], count.astype(np.int64))


# --- the first pass: words, and what is too common for one route -----------------------------

_COUNTED = "kind int, lang string, word string, hash bigint, n bigint"
_OF_WORD, _OF_PAIR, _OF_THREE = 1, 2, 3


def _counted(words: Words) -> Iterator[pa.RecordBatch]:
    own = words.own
    many = len(words.texts)
    key, n = np.unique(words.lang[own] * many + words.text[own], return_counts=True)
    yield _counts(_OF_WORD, words, key // max(many, 1), n, word=words.texts.take(pa.array(key % max(many, 1))))
    suffixes = suffixes_of(words, 3)
    hashes = suffixes.hashes(words)
    share = max(1, own.sum() // HOT)
    for kind in (_OF_PAIR, _OF_THREE):
        whole = suffixes.columns[kind] != END
        _, first, part = np.unique(hashes[kind][whole], return_index=True, return_inverse=True)
        n = np.bincount(part, suffixes.count[whole]).astype(np.int64)
        common = n > share
        yield _counts(
            kind, words, np.zeros(common.sum(), np.int64), n[common], hash=hashes[kind][whole][first][common].view(np.int64)
        )


def _counts(kind: int, words: Words, lang: np.ndarray, n: np.ndarray, word=None, hash=None) -> pa.RecordBatch:
    size = len(n)
    langs = pa.array(words.langs if word is not None else [None], pa.string()).take(pa.array(lang))
    return pa.RecordBatch.from_arrays(
        [
            pa.repeat(pa.scalar(kind, pa.int32()), size),
            langs,
            pa.nulls(size, pa.string()) if word is None else word.cast(pa.string()),
            pa.nulls(size, pa.int64()) if hash is None else pa.array(hash),
            pa.array(n, pa.int64()),
        ],
        names=["kind", "lang", "word", "hash", "n"],
    )


# --- the second pass: suffixes to routes ---------------------------------------------------------


def _routed(words: Words, depth: int, routes: int, hot: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Blocks of suffixes of one route and level: the texts they use, the suffixes as numbers of these, their counts."""
    suffixes = suffixes_of(words, depth)
    # A single word at the end of its piece begins no phrase.
    two = suffixes.columns[2] != END
    suffixes = Suffixes([c[two] for c in suffixes.columns], suffixes.count[two])
    if not len(suffixes.count):
        return
    hashes = suffixes.hashes(words)
    level = np.zeros(len(suffixes.count), np.int64)
    route = hashes[2].copy()
    for n in sorted(hot):
        if len(hot[n]) and n < depth:
            common = (level == n - 2) & np.isin(hashes[n], hot[n])
            level[common] = n - 1
            route[common] = hashes[n + 1][common]
    place = (level * routes + (route % np.uint64(routes)).astype(np.int64)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    place = place[order]
    # The language is one more text behind those of the words.
    texts = pa.concat_arrays([words.texts.cast(pa.large_string()), pa.array(words.langs, pa.large_string())])
    columns = [suffixes.columns[0] + len(words.texts), *suffixes.columns[1:]]
    columns = [c[order] for c in columns]
    count = suffixes.count[order]
    begins = np.flatnonzero(np.diff(place, prepend=-1))
    ends = np.append(begins[1:], len(place))
    number = np.full(len(texts) + 1, END, np.int32)
    for begin, end in zip(begins, ends):
        for low in range(begin, end, BLOCK):
            rows = slice(low, min(low + BLOCK, end))
            used = np.zeros(len(texts) + 1, bool)
            for column in columns:
                used[column[rows]] = True
            used = np.flatnonzero(used[:-1])
            number[used] = np.arange(len(used), dtype=np.int32)
            lists = [texts.take(pa.array(used)), *[pa.array(number[column[rows]]) for column in columns]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([place[low] % routes], pa.int32()),
                    pa.array([place[low] // routes], pa.int32()),
                    pa.array([_packed([*lists, pa.array(count[rows])])], pa.binary()),
                ],
                names=["route", "level", "block"],
            )


def _packed(lists: list[pa.Array]) -> bytes:
    """Lists as the columns of one row, compressed: numbers of texts take two bytes or less."""
    one = [pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values) for values in lists]
    batch = pa.RecordBatch.from_arrays(one, names=[str(i) for i in range(len(one))])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


# --- on a route ------------------------------------------------------------------------------------


def equal_parts(
    columns: list[np.ndarray], weight: np.ndarray, least: list[int]
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sort suffix pointers word by word and give the parts of equal ones.

    Multikey three-way quicksort: each part is cut at a pivot, by the word at its depth, into
    what is less, equal and greater; equal pointers are one phrase and go on to the next word. A
    part of less weight than ``least`` has for its depth is given up. Gives arrays of a pointer per
    part, of its depth in columns, and of its weight.
    """
    keys = np.stack(columns)
    pointers = np.arange(len(weight))
    sizes, depths = np.array([len(weight)]), np.array([0])
    floor = np.array(least)
    while len(pointers):
        ends = np.cumsum(sizes)
        part = np.repeat(np.arange(len(sizes)), sizes)
        words = keys[depths[part], pointers]
        first, middle, last = (words[at] for at in (ends - sizes, ends - sizes + sizes // 2, ends - 1))
        pivots = np.maximum(np.minimum(first, middle), np.minimum(np.maximum(first, middle), last))
        against = words - pivots[part]
        rest = []
        for chosen in (against < 0, against == 0, against > 0):
            at = np.flatnonzero(chosen)
            if not len(at):
                continue
            of, found = part[at], pointers[at]
            begins = np.flatnonzero(np.diff(of, prepend=-1))
            many = np.diff(np.append(begins, len(at)))
            depth, total = depths[of[begins]], np.add.reduceat(weight[found], begins)
            kept = total >= floor[depth]
            if against[at[0]] == 0:
                # The end of a suffix is no word.
                kept &= pivots[of[begins]] != END
                depth = depth + 1
                yield found[begins[kept]], depth[kept], total[kept]
                kept &= depth < len(keys)
            rest.append((found[np.repeat(kept, many)], many[kept], depth[kept]))
        pointers, sizes, depths = (np.concatenate(x) for x in zip(*rest))


_FOUND = "lang string, phrase string, words int, a bigint"


def _phrases(table: pa.Table, least: int) -> pa.Table:
    """The frequent phrases of a route; on a level above 0 also what its common leading words count here."""
    level = table.column("level")[0].as_py()
    batches = [pa.ipc.open_stream(block.as_buffer()).read_next_batch() for block in table.column("block")]
    blocks, *columns, counts = pa.Table.from_batches(batches).combine_chunks().columns
    coded = blocks.combine_chunks().flatten().dictionary_encode()
    texts, number = coded.dictionary, coded.indices.to_numpy()
    # Numbers of a block count its own texts; behind those of the blocks before they count all.
    before = np.concatenate(([0], np.cumsum(pc.list_value_length(blocks).to_numpy())[:-1]))
    base = np.repeat(before, pc.list_value_length(counts).to_numpy())
    keys = []
    for column in columns:
        own = column.combine_chunks().flatten().to_numpy()
        keys.append(np.where(own == END, END, number[np.where(own == END, 0, own + base)]).astype(np.int32))
    weight = counts.combine_chunks().flatten().to_numpy()
    # Leading words that other routes count too: here any count is part of theirs.
    floor = [1 if level and n < level + 2 else least for n in range(len(keys))]
    return _found(texts, keys, *[np.concatenate(x) for x in zip(*equal_parts(keys, weight, floor))])


def _found(
    texts: pa.Array, keys: list[np.ndarray], pointer: np.ndarray, depth: np.ndarray, total: np.ndarray
) -> pa.Table:
    phrase = depth > 2
    pointer, depth, total = pointer[phrase], depth[phrase], total[phrase]
    words = []
    for n, column in enumerate(keys[1:], start=2):
        words.append(texts.take(pa.array(column[pointer], mask=depth < n)).cast(pa.string()))
    joined = pc.binary_join_element_wise(*words, " ", null_handling="skip")
    return pa.table(
        {
            "lang": texts.take(pa.array(keys[0][pointer])).cast(pa.string()),
            "phrase": joined,
            "words": pa.array(depth - 1, pa.int32()),
            "a": pa.array(total, pa.int64()),
        }
    )


# --- all together --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Counts:
    """Frequent phrases (``lang``, ``phrase``, ``words``, ``a``), all words (``lang``, ``phrase``, ``a``)."""

    phrases: DataFrame
    words: DataFrame


def count_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", depth: int = DEPTH, least: int = LEAST, route: int = ROUTE
) -> Counts:
    """Count all words, and all phrases of 2 to ``depth`` words that occur ``least`` times or more, per language."""
    texts = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text")
    ).filter("text <> ''")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _chunks(batches, CHUNK, depth):
            yield from _counted(words)

    counts = saved(
        texts.mapInArrow(count, _COUNTED).groupBy("kind", "lang", "word", "hash").agg(F.sum("n").alias("n")), "words"
    )
    total = counts.filter(F.col("kind") == _OF_WORD).agg(F.sum("n")).first()[0] or 0
    common = F.col("n") >= max(total // HOT, route // 8, 1)
    hot = {}
    for kind in (_OF_PAIR, _OF_THREE):
        rows = counts.filter((F.col("kind") == kind) & common).select("hash").collect()
        hot[kind] = np.array([row.hash for row in rows], np.int64).view(np.uint64)
    routes = max(32, -(-total // route))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _chunks(batches, CHUNK, depth):
            yield from _routed(words, depth, routes, hot)

    blocks = texts.mapInArrow(send, "route int, level int, block binary")
    found = blocks.groupBy("route", "level").applyInArrow(lambda table: _phrases(table, least), _FOUND)
    # Only phrases with common leading words come from more than one route.
    phrases = found.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    words = counts.filter(F.col("kind") == _OF_WORD).select("lang", F.col("word").alias("phrase"), F.col("n").alias("a"))
    return Counts(saved(phrases, "phrases"), words)


def _exact(number: Column | str) -> Column:
    """A whole number with room for products beyond 64 bits."""
    return (F.col(number) if isinstance(number, str) else number).cast("decimal(28,0)")


def score_phrases(counts: Counts, least: int = LEAST, covered: int = COVERED) -> DataFrame:
    """Score each phrase at its worst cut, and leave out those that a longer one covers.

    Gives ``lang``, ``phrase``, ``a``, ``l``, ``r`` and ``score``.
    """
    phrases = counts.phrases
    known = phrases.select("lang", "phrase", "a").unionByName(counts.words.filter(F.col("a") >= least))
    own = F.split("phrase", " ")
    part = F.transform(
        F.sequence(F.lit(1), F.col("words") - 1),
        lambda k: F.struct(
            k.alias("k"),
            F.array_join(F.slice(own, F.lit(1), k), " ").alias("first"),
            F.array_join(F.slice(own, k + 1, F.col("words")), " ").alias("rest"),
        ),
    )
    cuts = phrases.select("lang", "phrase", "a", F.inline(part))
    left = known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    score = F.call_function("div", _exact("a") * F.lit(SCALE).cast("decimal(9,0)"), _exact("l") + _exact("r"))
    worst = (
        cuts.join(left, ["lang", "first"])
        .join(right, ["lang", "rest"])
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("worst"))
    )
    # What a longer phrase holds: every run of two words or more but itself.
    inside = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.col("words") - n + 1), lambda at: F.array_join(F.slice(own, at, n), " ")
            ),
        )
    )
    longer = (
        phrases.filter("words > 2")
        .select("lang", F.explode(inside).alias("phrase"), F.col("a").alias("longer"))
        .groupBy("lang", "phrase")
        .agg(F.max("longer").alias("longer"))
    )
    kept = F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * covered)
    return (
        worst.join(longer, ["lang", "phrase"], "left")
        .filter(kept)
        .select("lang", "phrase", "a", "worst.l", "worst.r", F.col("worst.score").cast("bigint").alias("score"))
    )


def top_phrases(scored: DataFrame, top: int = TOP, pick: int = PICK) -> DataFrame:
    """The best phrases of each language with their ``rank``, by score, then count, then phrase.

    Windows over parts of a language pick the best of each before these meet.
    """
    rows = saved(scored, "scored")
    parts = 64 + rows.count() // pick
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    first = rows.withColumn("_salt", salt).withColumn(
        "_rank", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*best))
    )
    met = first.filter(F.col("_rank") <= top).drop("_rank", "_salt")
    ranked = met.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("bigint"))
    return ranked.filter(F.col("rank") <= top)


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    depth: int = DEPTH,
    least: int = LEAST,
    covered: int = COVERED,
    top: int = TOP,
    route: int = ROUTE,
) -> DataFrame:
    """The phrases of each language whose words keep together most: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``,
    ``n`` (words of the language) and ``score``."""
    counts = count_phrases(docs, text, lang, depth, least, route)
    ranked = top_phrases(score_phrases(counts, least, covered), top)
    sizes = counts.words.groupBy("lang").agg(F.sum("a").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
