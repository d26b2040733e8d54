"""Packing token ids into sequences of a fixed capacity by hierarchical residual packing.

Documents are cut into pieces, and the pieces, which are narrow rows, dealt out in turn, so that every task
has a mix of lengths however the table was sorted. Spark sorts those of a task, and the task packs them by best
fit, the longest first, as a stream: every bin with room left stays open to the end, and a task
holds no rows, only the numbers of its open bins. Then underfull bins, as a number and a length, move up a
tree as items of their own, a node taking those of ``FAN_IN`` children, where best fit combines them
again, until one node is left. What a bin holds stays where it is; the few bins that move are joined to it at the end.

No bin is closed to save room, though few need to travel. Of two bins that are half empty or more, best fit would
have put one into the other, so a node has one such bin at most, and two bins that are over half full fit
together nowhere. A node therefore puts at most ``FAN_IN`` bins, the half-empty ones of its children, into
others, and from any one length it uses at most so many. Bins of one length are as good as each other, so ``FAN_IN`` of each
length for every level above are all that those levels can ever use, and the result is that of passing on all.

Null text counts as empty: its piece is the separator alone. Repeated rows are packed
each on its own, null keys are kept, and an empty table gives no sequences. Other
columns are not read. A task names its bins after itself and writes them before anything is made of them,
so one that runs again replaces them all.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.llm.bpe import Recent, byte_of_letter
from sluiceway.llm.common import in_batches, saved

CAPACITY = 2048
# A bin with no more room than this is final.
SLACK = 0
FAN_IN = 8
# Bins of each length that a node passes on for every level above it: all that a node there can use.
KEEP = FAN_IN
# Ends a document.
SEPARATOR = 0
# A bin that a node has packed, and where one is that moved.
PACKED = "node long, bin long, into long, offset long, used long, open boolean"
MOVES = ("bin", "into", "moved_by")


class Tokens:
    """Ids by a public tokenizer that drops white space, with the words it has met.

    Such a tokenizer treats words between white space each on its own, so every new word is
    given to the tokenizers library once. In text of the first two Unicode blocks, lower case
    is the same everywhere and marks after a word are a piece of their own, so there words
    are told apart without capitals and marks; words of letters only need the merges.
    """

    MARKS = re.compile(r"(?<=[a-zß-öø-ÿ])([^\w\s]+)(?=[ \n]|\Z)")
    LETTERS = re.compile(r"[a-zß-öø-ÿ]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        letters = {b: letter for letter, b in byte_of_letter().items()}
        self.letters = {
            code: "".join(letters[b] for b in chr(code).encode("utf-8")) for code in range(192, 256)
        }
        self.words = Recent(self._word)

    def _word(self, word: str) -> bytes:
        if self.LETTERS.fullmatch(word):
            ids = [t.id for t in self.tokenizer.model.tokenize(word.translate(self.letters))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bool:
        """Whether all letters are of the first two Unicode blocks and nothing can be a special token."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        lower = text.lower()
        return not any(name in lower for name in self.special)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._plain(text):
            text = self.MARKS.sub(r" \1", text.lower())
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=4)
def tokens(path: str) -> Tokens:
    return Tokens(path)


class Bins:
    """Open bins by the room they have left, with one bit per room that occurs, so the tightest is found without a search."""

    def __init__(self, capacity: int, slack: int = 0):
        self.capacity, self.slack = capacity, slack
        self.by_room = [array("q") for _ in range(capacity + 1)]
        self.rooms, self.made = 0, 0

    def put(self, size: int) -> tuple[int, int]:
        """The bin of an item and its place there; a new bin if it fits into none."""
        fitting = self.rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = self.by_room[room].pop()
            if not self.by_room[room]:
                self.rooms &= ~(1 << room)
        else:
            room, at = self.capacity, self.made
            self.made += 1
        left = room - size
        if left > self.slack:
            self.by_room[left].append(at)
            self.rooms |= 1 << left
        return at, self.capacity - room


def best_fit(sizes: np.ndarray, capacity: int, bins: Bins | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and its place there, the longest items first; ``bins`` are those already open."""
    bins = bins or Bins(capacity)
    bin_of = np.zeros(len(sizes), np.int64)
    offset_of = np.zeros(len(sizes), np.int64)
    for item in np.argsort(-sizes, kind="stable").tolist():
        bin_of[item], offset_of[item] = bins.put(int(sizes[item]))
    return bin_of, offset_of


def _schema(key: T.DataType) -> T.StructType:
    fields = [("key", key), ("piece", T.IntegerType())]
    fields += [(name, T.LongType()) for name in ("start", "length", "ids_crc32", "bin", "offset")]
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


class Node:
    """Best fit of bins in one task, below ``above`` levels. A bin keeps the name of the first in it."""

    def __init__(self, above: int, node: int, capacity: int, slack: int, keep: int | None = None):
        self.node, self.capacity, self.slack = node, capacity, slack
        self.keep = above * (KEEP if keep is None else keep)

    def pack(self, rows: pa.Table) -> pa.Table:
        """Combine the bins of ``rows``, each of a ``bin`` and ``length``.

        ``into`` is the bin that each is in now, at ``offset``, ``used`` the length of that, and ``open`` marks
        the bins that go on, each once.
        """
        names, length = rows["bin"].to_numpy(), rows["length"].to_numpy()
        bin_of, offset_of = best_fit(length, self.capacity, Bins(self.capacity, self.slack))
        own = offset_of == 0
        n = int(own.sum())
        name = np.zeros(n, np.int64)
        name[bin_of[own]] = names[own]
        used = np.bincount(bin_of, length, n).astype(np.int64)
        by_length = np.argsort(used, kind="stable")
        ordered = used[by_length]
        goes_on = np.zeros(n, bool)
        goes_on[by_length] = np.arange(n) - np.searchsorted(ordered, ordered) < self.keep
        goes_on &= used < self.capacity - self.slack
        return pa.table(
            {
                "node": pa.array(np.full(len(rows), self.node)),
                "bin": pa.array(names),
                "into": pa.array(name[bin_of]),
                "offset": pa.array(offset_of),
                "used": pa.array(used[bin_of]),
                "open": pa.array(own & goes_on[bin_of]),
            }
        )


def pieces(key: pa.Array, texts: pa.Array, own: Tokens, capacity: int, first: int) -> pa.Table:
    """The pieces of some documents, each a bin of its own, numbered from ``first``."""
    index, piece, start, length, crc = [], [], [], [], []
    end = struct.pack("<I", SEPARATOR)
    for at, text in enumerate(texts.to_pylist()):
        packed = own.encode(text) + end
        n = len(packed) // 4
        for number, begin in enumerate(range(0, n, capacity)):
            part = packed[begin * 4 : (begin + capacity) * 4]
            index.append(at)
            piece.append(number)
            start.append(begin)
            length.append(len(part) // 4)
            crc.append(zlib.crc32(part))
    n = len(index)
    return pa.table(
        {
            "key": key.take(pa.array(index, pa.int64())),
            "piece": pa.array(piece, pa.int32()),
            "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()),
            "bin": pa.array(np.arange(first, first + n)),
            "offset": pa.array(np.zeros(n, np.int64)),
        }
    )


def pack(
    docs: DataFrame,
    vocabulary: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    slack: int = SLACK,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per piece: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    schema = _schema(docs.schema[key].dataType)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(vocabulary)
        for batch in batches:
            if batch.num_rows:
                yield from pieces(batch.column(0), batch.column(1), own, capacity, 0).to_batches()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        bins = Bins(capacity, slack)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            bin_of, offset_of = best_fit(rows["length"].to_numpy(), capacity, bins)
            for name, values in (("bin", base + bin_of), ("offset", offset_of)):
                rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(values))
            yield from rows.to_batches()

    def combiner(above: int):
        def combine(node: tuple, rows: pa.Table) -> pa.Table:
            return Node(above, node[0].as_py(), capacity, slack, fan_in).pack(rows)

        return combine

    rows = in_batches(docs).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    # Pieces are narrow; dealt out in turn, every task gets a mix of lengths, however the documents were sorted.
    spread = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.mapInArrow(cut, schema).repartition(spread).sortWithinPartitions(F.desc("length"))
    rows = saved(dealt.mapInArrow(local, schema), "pack-0")
    last, levels = (rows.agg(F.max("bin")).first()[0] or 0) >> 32, 0
    while last > 0:
        last, levels = last // fan_in, levels + 1
    # Bins with room, and of those of one task and length as many as all levels can use.
    bins = rows.groupBy("bin").agg(F.sum("length").alias("length")).filter(F.col("length") < capacity - slack)
    bins = bins.withColumn("node", F.shiftright("bin", 32))
    place = F.row_number().over(Window.partitionBy("node", "length").orderBy("bin"))
    bins = bins.withColumn("place", place).filter(F.col("place") <= fan_in * levels).drop("place")
    # Where bins have moved: at most one of each task, so this is a short list. A list given from Python would start
    # Python workers of another kind on every executor, even an empty one.
    moved = docs.sparkSession.range(0).select(*[F.col("id").alias(name) for name in MOVES])
    for above in reversed(range(levels)):
        items = bins.withColumn("node", F.expr(f"node div {fan_in}"))
        packed = saved(items.groupBy("node").applyInArrow(combiner(above), PACKED), f"pack-{levels - above}")
        moves = packed.filter("into <> bin").select("bin", "into", F.col("offset").alias("moved_by"))
        further = moves.select(F.col("bin").alias("into"), F.col("into").alias("then"), F.col("moved_by").alias("more"))
        moved = moved.join(F.broadcast(further), "into", "left").select(
            "bin", F.coalesce("then", "into").alias("into"), F.expr("moved_by + coalesce(more, 0)").alias("moved_by")
        )
        moved = moved.unionByName(moves)
        bins = packed.filter("open").select("node", "bin", F.col("used").alias("length"))
    found = rows.join(F.broadcast(moved), "bin", "left")
    return found.select(
        F.col("key").alias(key),
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("into", "bin").alias("sequence_id"),
        F.expr("offset + coalesce(moved_by, 0)").alias("offset"),
    )
