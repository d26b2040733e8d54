"""Nearest neighbours by a block matrix join over int8 tiles.

Queries and candidates are dealt into blocks of bounded size, and every pair of blocks is
a tile, worked on by one task call. In a tile vectors of length one are quantised to int8, and
one matrix product gives all cosines up to an error that is bounded from the lengths of what
rounding took away. A pair survives if its cosine can still be among the best of its query;
survivors are recomputed from the original vectors in double precision and kept in a heap for
each query, whose worst entry cuts the next block of candidates. Heaps and cuts count ids, not
vectors, so an id with many vectors takes one place. So the result
is exact. The tiles' heaps are merged by Spark, with a limit before the shuffle.

Vectors that are null, empty, zero or hold a null or a value that is not finite take no part,
nor do null ids. Rows that repeat an id and a vector count once, as do many equal vectors: a
tile keeps only as many of them as a query can return. Very large and very small values count
as they are: vectors are brought to one magnitude by a power of two before any product. If an id has several vectors, each is
a candidate, and as a query the id is as near as the nearest of them. Vectors of different
lengths are not compared. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import saved

NEAREST = 5
# Rows of a block.
QUERIES = 4096
CANDIDATES = 8192
# Queries and candidates of one matrix product.
STEP_QUERIES = 256
STEP_CANDIDATES = 2048
# Covers the rounding of single precision in products of int8 tiles, and of the errors themselves.
ROUNDING = 1e-5


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row dot products in double precision, added up from the first component on."""
    total = left[:, 0] * right[:, 0]
    for i in range(1, left.shape[1]):
        total += left[:, i] * right[:, i]
    return total


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that no product overflows or vanishes; cosines stay exactly the same."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    return np.ldexp(vectors + 0.0, -exponent)


class Nearest:
    """The nearest ids of a query, each with its best cosine."""

    def __init__(self, size: int):
        self.size = size
        self.heap: list[tuple[float, int]] = []
        self.best: dict[int, float] = {}

    @property
    def least(self) -> float:
        """What a cosine must reach to matter."""
        return self.heap[0][0] if len(self.heap) == self.size else -np.inf

    def add(self, score: float, number: int) -> None:
        entry = (score, -number)
        held = self.best.get(number)
        if held is not None:
            if score > held:
                self.heap[self.heap.index((held, -number))] = entry
                heapq.heapify(self.heap)
                self.best[number] = score
        elif len(self.heap) < self.size:
            heapq.heappush(self.heap, entry)
            self.best[number] = score
        elif entry > self.heap[0]:
            del self.best[-heapq.heapreplace(self.heap, entry)[1]]
            self.best[number] = score


class Quantised:
    """Vectors of length one as int8 with a scale each, and how far rounding has moved them."""

    def __init__(self, vectors: np.ndarray):
        # The largest component becomes 1 first, so that no square overflows or vanishes.
        unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        self.scale = np.abs(unit).max(axis=1) / 127
        self.values = np.rint(unit / self.scale[:, None]).astype(np.int8)
        near = self.values * self.scale[:, None]
        self.error = np.sqrt(((unit - near) ** 2).sum(axis=1))
        self.length = np.sqrt((near * near).sum(axis=1))


def _first_of_equal(ids: np.ndarray, vectors: np.ndarray, limit: int) -> np.ndarray:
    """Places of the candidates to keep: of equal vectors those with the smallest ids."""
    order = np.argsort(ids, kind="stable")
    rows = np.ascontiguousarray(vectors[order] + 0.0)  # no negative zero
    _, group = np.unique(rows.view(f"V{rows.itemsize * rows.shape[1]}").ravel(), return_inverse=True)
    by_group = np.lexsort((ids[order], group))
    same_group = np.diff(group[by_group], prepend=-1) == 0
    repeated = same_group & (np.diff(ids[order][by_group], prepend=ids.min() - 1) == 0)
    by_group = by_group[~repeated]
    start = np.flatnonzero(np.diff(group[by_group], prepend=-1) != 0)
    size = np.diff(np.append(start, len(by_group)))
    rank = np.arange(len(by_group)) - np.repeat(start, size)
    return order[by_group[rank < limit]]


def tile(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, nearest: int
) -> list[tuple[int, int, float]]:
    """For each query its nearest candidates of a tile: query, candidate and cosine."""
    # One more than a query returns, as it may find itself among equal vectors.
    kept = _first_of_equal(ids, candidates, nearest + 1)
    kept = kept[np.argsort(ids[kept], kind="stable")]
    ids, candidates = ids[kept], scaled(candidates[kept])
    queries = scaled(queries)
    q, c = Quantised(queries), Quantised(candidates)
    q_length, c_length = np.sqrt(products(queries, queries)), np.sqrt(products(candidates, candidates))
    found = []
    for first in range(0, len(queries), STEP_QUERIES):
        rows = slice(first, first + STEP_QUERIES)
        left = q.values[rows].astype(np.float32)
        heaps = [Nearest(nearest) for _ in range(len(left))]
        for begin in range(0, len(ids), STEP_CANDIDATES):
            columns = slice(begin, begin + STEP_CANDIDATES)
            # Products of int8 are exact here: single precision holds every integer up to 2 ** 24.
            near = (left @ c.values[columns].astype(np.float32).T) * (
                q.scale[rows, None] * c.scale[None, columns]
            )
            bound = c.error[columns] + q.error[rows, None] * c.length[columns] + ROUNDING
            own = query_ids[rows, None] == ids[None, columns]
            near[own] = -np.inf
            least = np.array([heap.least for heap in heaps])
            # Candidates stand by id: the best that each id is sure to reach.
            of_id = np.flatnonzero(np.diff(ids[columns], prepend=ids[begin] - 1) != 0)
            sure = np.maximum.reduceat(near - bound, of_id, axis=1)
            if len(of_id) > nearest:
                least = np.maximum(least, np.partition(sure, -nearest, axis=1)[:, -nearest])
            row, column = np.nonzero((near + bound >= least[:, None]) & ~own)
            for part in range(0, len(row), 1 << 16):
                r, at = row[part : part + (1 << 16)], column[part : part + (1 << 16)] + begin
                score = products(queries[first + r], candidates[at]) / (q_length[first + r] * c_length[at])
                for i, s, number in zip(r.tolist(), score.tolist(), ids[at].tolist()):
                    heaps[i].add(s, number)
        for query, heap in zip(query_ids[rows].tolist(), heaps):
            found += [(query, number, s) for number, s in heap.best.items()]
    return found


def dealt(blocks: int) -> Column:
    """A block for each row, by a hash of its number, so that no id, vector or partition can fill a block."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(blocks)), F.lit(blocks)).cast("int")


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    nearest: int = NEAREST,
) -> DataFrame:
    """For the rows where ``is_query`` holds their ``nearest`` others by cosine.

    Gives ``query_id``, ``rank`` from 1, ``key`` and ``score``; equal scores: the smaller id first.
    """
    rows = vectors.filter(is_query.isNotNull() & usable(F.col(f"`{vector}`")) & F.col(f"`{key}`").isNotNull())
    rows = rows.select(
        F.col(f"`{key}`").cast("long").alias("id"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
        is_query.alias("query"),
    )
    n = rows.agg(F.count("*").alias("all"), F.count_if("query").alias("queries")).first()
    blocks = -(-n["all"] // CANDIDATES) or 1
    query_blocks = -(-n["queries"] // QUERIES) or 1
    rows = saved(
        rows.withColumn("block", dealt(blocks)).withColumn("query_block", dealt(query_blocks)),
        "vectors",
    )

    def all_of(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    size = F.size("vector").alias("size")
    asked = rows.filter("query").select(
        "query_block", all_of(blocks).alias("block"), size, F.lit(True).alias("asks"), "id", "vector"
    )
    offered = rows.select(
        all_of(query_blocks).alias("query_block"), "block", size, F.lit(False).alias("asks"), "id", "vector"
    )

    def worked(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        asks = part["asks"].to_numpy()
        ids = part["id"].to_numpy()
        found = []
        if asks.any() and not asks.all():
            values = part["vector"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            found = tile(ids[asks], values[asks], ids[~asks], values[~asks], nearest)
        columns = list(zip(*found)) or [(), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("query_id", "id", "score"), columns, kinds)})

    tiles = asked.unionByName(offered).groupBy("query_block", "block", "size")
    found = tiles.applyInArrow(worked, "query_id long, id long, score double")
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)
    return found.select("query_id", "rank", F.col("id").alias(key), "score")
