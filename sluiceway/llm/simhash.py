"""Near duplicates by SimHash fingerprints and a binary trie self-join.

A fingerprint holds 64 bits, by majority over the XXH64 hashes of the word shingles of
a text. Two fingerprints link if at most ``ERRORS`` bits differ; documents are near
duplicates if a chain of links joins them.

The self-join walks one binary trie of the distinct fingerprints, pairs of nodes
together: both go down by one bit at a time, bits that differ are added up, and a pair is
dropped as soon as they exceed the budget. To share the work out, the trie is cut at a depth
that the number of fingerprints gives, and every pair of nodes there within the budget is a
task, which goes on down with the errors it has already. With d bits above the cut a fingerprint
takes part in one task per set of at most ``ERRORS`` of them: 57 for 6 bits, 386 for 10.

A task with more than ``LIMIT`` fingerprints is cut by hash into chunks, and every pair of
chunks is a task of its own. A task gives no list of its pairs but a star of each set that it
finds connected, and leaves out node pairs that are connected already, so a dense group
of copies costs little and emits one row per member. The stars are joined into components
by alternating large and small stars, with a table written after each round.

Null and empty texts have fingerprint zero, which links like any other. Repeated rows, and
ids that occur twice, are rows of the result each. A null id gets the smallest id
of its component, which is null only if all its ids are. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import in_batches, saved

ERRORS = 4
SHINGLE = 4
SEED = 42
# The trie is cut below so many bits at least, and where nodes hold about so many fingerprints.
DEPTH = 6
PER_NODE = 1 << 16
# Fingerprints of a pair of nodes that a task takes at a time.
LIMIT = 1 << 18
# Pairs of fingerprints compared at a time.
COMPARED = 1 << 20
# Two nodes of so many pairs are compared directly.
SMALL = 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer; zero without words."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
    starts = [0, *[end + 1 for end in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    last = ends[shingle - 1 :] or ends[-1:]
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last)], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of each text as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def signed(texts: pd.Series) -> pd.Series:
        found = [fingerprint(t if isinstance(t, str) else None, shingle) for t in texts]
        return pd.Series(np.array(found, np.uint64).view(np.int64))

    return signed(text)


def depth_for(count: int) -> int:
    """How many bits of the trie lie above the cut."""
    return max(DEPTH, (max(count, 1) - 1).bit_length() - (PER_NODE.bit_length() - 1))


def node_pairs(node: Column, depth: int) -> Column:
    """The pairs of nodes at ``depth`` bits that ``node`` is part of, the smaller node in the higher bits."""
    others = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit((1 << depth) - 1)), lambda bits: F.bit_count(bits) <= ERRORS),
        lambda bits: node.bitwiseXOR(bits.cast("long")),
    )
    return F.transform(
        others, lambda other: F.shiftleft(F.least(node, other), depth).bitwiseOR(F.greatest(node, other))
    )


class Connected:
    """Sets of connected entries, each known by its smallest."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        while True:
            a, b = self.root[left], self.root[right]
            apart = a != b
            if not apart.any():
                return
            left, right = left[apart], right[apart]
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.root, high, low)
            while not np.array_equal(self.root, self.root[self.root]):
                self.root = self.root[self.root]

    def within(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each range of entries whether it is connected to itself."""
        changes = np.cumsum(np.diff(self.root, prepend=self.root[:1]) != 0)
        return changes[high - 1] == changes[low]


def _expand(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray):
    """All pairs of entries of pairs of ranges."""
    width = high2 - low2
    count = (high - low) * width
    pair = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
    return low[pair] + at // width[pair], low2[pair] + at % width[pair]


class Ones:
    """For each depth of the trie how many entries before a place have a one there."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.known: dict[int, np.ndarray] = {}

    def middle(self, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
        """Where the ones begin in ranges that agree in all bits above."""
        if depth not in self.known:
            bit = (self.values >> np.uint64(63 - depth)) & np.uint64(1)
            self.known[depth] = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
        before = self.known[depth]
        return high - (before[high] - before[low])


def trie_join(
    values: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int = 0, tally: dict[str, int] | None = None
) -> np.ndarray:
    """Connect the fingerprints of each range of ``values`` that differ in few bits.

    ``values`` is unsigned and sorted inside each range. A range holds all entries of one node at
    ``depth`` bits, or of a pair of such nodes, which are then joined with each other and not each with itself.
    A node of the trie is a range of entries that agree in their highest bits. The result has the smallest
    connected entry for each entry. ``tally`` counts node pairs that are walked, pruned and compared.
    """
    found = Connected(len(values))
    ones = Ones(values)
    first, last = values[starts], values[ends - 1]
    apart = (first ^ last) >> np.uint64(64 - depth) if depth else np.zeros(len(starts), np.uint64)
    whole = apart == 0
    # Where the second node of a pair begins: behind all entries that share the first one's bits.
    middle = starts.copy()
    for at in np.flatnonzero(~whole):
        edge = ((first[at] >> np.uint64(64 - depth)) + np.uint64(1)) << np.uint64(64 - depth)
        middle[at] += np.searchsorted(values[starts[at] : ends[at]], edge)
    low, high = starts, np.where(whole, ends, middle)
    low2, high2, errors = middle, ends, np.bitwise_count(apart).astype(np.int8)
    big = (high - low > 1) | ~whole
    # Pairs of nodes still to be walked: both ranges, errors, depth.
    todo = [(low[big], high[big], low2[big], high2[big], errors[big], depth)]
    while todo:
        low, high, low2, high2, errors, depth = todo.pop()
        # Leave out what is connected already.
        same = found.root[low] == found.root[low2]
        if same.any():
            same &= found.within(low, high) & found.within(low2, high2)
            low, high, low2, high2, errors = (x[~same] for x in (low, high, low2, high2, errors))
        count = (high - low) * (high2 - low2)
        small = (count <= SMALL) | (depth == 64)
        if tally is not None:
            tally["walked"] = tally.get("walked", 0) + len(count)
            tally["compared"] = tally.get("compared", 0) + int(count[small].sum())
        if small.any():
            compared = np.cumsum(count[small]) // COMPARED
            chosen = np.flatnonzero(small)
            for part in np.split(chosen, np.flatnonzero(np.diff(compared)) + 1):
                left, right = _expand(low[part], high[part], low2[part], high2[part])
                near = np.bitwise_count(values[left] ^ values[right]) <= ERRORS
                found.link(left[near], right[near])
        low, high, low2, high2, errors = (x[~small] for x in (low, high, low2, high2, errors))
        if not len(low):
            continue
        if len(low) > COMPARED // SMALL:
            half = len(low) // 2
            for part in (slice(half, None), slice(0, half)):
                todo.append((low[part], high[part], low2[part], high2[part], errors[part], depth))
            continue
        middle, middle2 = ones.middle(low, high, depth), ones.middle(low2, high2, depth)
        itself = low == low2
        children = [
            (low, middle, low2, middle2, errors),
            (middle, high, middle2, high2, errors),
            (low, middle, middle2, high2, errors + 1),
        ]
        cross = ~itself
        children.append(tuple(x[cross] for x in (middle, high, low2, middle2, errors + 1)))
        joined = [np.concatenate([child[i] for child in children]) for i in range(5)]
        alive = (joined[0] < joined[1]) & (joined[2] < joined[3])
        if tally is not None:
            tally["pruned"] = tally.get("pruned", 0) + int((alive & (joined[4] > ERRORS)).sum())
        alive &= joined[4] <= ERRORS
        # A single entry with itself has nothing to compare.
        alive &= ~((joined[0] == joined[2]) & (joined[1] - joined[0] == 1))
        if alive.any():
            todo.append((*(x[alive] for x in joined), depth + 1))
    return found.root


def _stars(depth: int):
    """Of rows sorted by task, the stars that connect the fingerprints of each pair of nodes at ``depth`` bits."""

    def joined(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((values, keys))
        keys, values = keys[order], values[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.append(starts[1:], len(keys))
        # A node without its partner has nothing to meet; its own pairs are another task.
        own = (keys[starts] >> depth) % (1 << depth) == keys[starts] % (1 << depth)
        met = own | ((values[starts] ^ values[ends - 1]) >> np.uint64(64 - depth) > 0)
        root = trie_join(values, starts[met], ends[met], depth)
        linked = np.flatnonzero(root != np.arange(len(root)))
        u, v = values[linked].view(np.int64), values[root[linked]].view(np.int64)
        return pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        task = None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            values = batch.column(1).to_numpy().view(np.uint64)
            # The last task may go on in the next batch.
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut or (len(keys) and keys[0] != task and held):
                held.append((keys[:cut], values[:cut]))
                yield joined(*map(np.concatenate, zip(*held)))
                held = []
            if len(keys):
                held.append((keys[cut:], values[cut:]))
                task = keys[-1]
        if held:
            yield joined(*map(np.concatenate, zip(*held)))

    return stars


def links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Stars ``u``, ``v`` that connect the distinct values of ``fingerprint``; zero rows where nothing is near."""
    depth = depth_for(prints.count())
    node = F.shiftrightunsigned("fingerprint", 64 - depth)
    pairs = prints.select("fingerprint", node.alias("node"))
    pairs = pairs.select(F.explode(node_pairs(F.col("node"), depth)).alias("pair"), "fingerprint")
    # The sizes of all nodes give those of the pairs.
    sizes = prints.groupBy(node.alias("node")).count()
    sizes = sizes.select(F.explode(node_pairs(F.col("node"), depth)).alias("pair"), "count")
    sizes = sizes.groupBy("pair").agg(F.sum("count").alias("count")).filter(F.col("count") > limit)
    large = saved(sizes.select("pair", F.ceil(F.col("count") / limit).alias("chunks")), "large-pairs")
    # Of a large pair every two chunks are a task, so a fingerprint goes to as many tasks as there are chunks.
    tasks = F.expr(
        f"""CASE WHEN chunks IS NULL THEN array(pair)
            ELSE transform(sequence(0L, chunks - 1), other -> shiftleft(
                1 + least(other, pmod(xxhash64(fingerprint), chunks)) * chunks
                + greatest(other, pmod(xxhash64(fingerprint), chunks)), {2 * depth}) | pair) END"""
    )
    pairs = pairs.join(large, "pair", "left").select(F.explode(tasks).alias("task"), "fingerprint")
    return pairs.repartition("task").sortWithinPartitions("task").mapInArrow(_stars(depth), "u long, v long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``component``, its smallest node, for every node of some edges ``u``, ``v``.

    Large and small stars in turn, until nothing changes.
    """
    now = saved(_downward(edges), f"{name}-0")
    mark = _mark(now)
    turn = 0
    while True:
        turn += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(least.select("u", F.col("m").alias("v")))
        now, before = saved(_downward(small), f"{name}-{turn}"), mark
        mark = _mark(now)
        if mark == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(centres)


def _downward(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return (
        edges.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Tells whether a set of edges has changed."""
    mixed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(mixed), F.sum(F.pmod(mixed, F.lit(1 << 31)))).first())


def _prints(docs: DataFrame, key: str, text: str, carry: bool) -> DataFrame:
    """``row`` (a number), ``key`` and ``fingerprint`` of each row; with ``carry`` also the whole row as ``doc``."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []
    prints = in_batches(docs).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{key}`").alias("key"),
        fingerprints(F.col(f"`{text}`")).alias("fingerprint"),
        *row,
    )
    return saved(prints, "fingerprints")


def _labels(prints: DataFrame) -> DataFrame:
    """For each distinct ``fingerprint`` its ``component`` (a fingerprint) and ``component_id``."""
    classes = saved(prints.groupBy("fingerprint").agg(F.min("key").alias("first")), "classes")
    linked = components(links(classes)).withColumnRenamed("node", "fingerprint")
    linked = linked.join(classes, "fingerprint")
    smallest = linked.groupBy("component").agg(F.min("first").alias("smallest"))
    linked = linked.join(smallest, "component").select("fingerprint", "component", "smallest")
    return classes.join(linked, "fingerprint", "left").select(
        "fingerprint",
        F.coalesce("component", "fingerprint").alias("component"),
        F.coalesce("smallest", "first").alias("component_id"),
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its ``key``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``."""
    prints = _prints(docs, key, text, carry=False)
    return prints.join(_labels(prints), "fingerprint").select(
        F.col("key").alias(key),
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that with the smallest key, null last; of several such rows any one."""
    prints = _prints(docs, key, text, carry=True)
    members = prints.select("row", "key", "fingerprint").join(_labels(prints), "fingerprint")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row"))
    kept = members.groupBy("component").agg(first.alias("first")).select("first.row")
    return prints.join(kept, "row", "left_semi").select("doc.*")
