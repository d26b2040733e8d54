"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms: words in lower case and their beginnings of four and five
letters, each hashed to 32 bits. The machine gives every learned term a weight and a
short vector, and every pair of terms in a text the product of their vectors, so that it
can learn that two terms matter together, such as an insult and the mention of a group.

The model is fitted on the driver from at most ``SAMPLE`` labelled documents, those with
the smallest hash of their id. Spark counts their terms; the model holds ``TERMS`` of them, those
that tell the classes apart best, and only these reach the driver. Its size is fixed and it is
sent to every task. Of rows with the same id one is learned from, and documents with the same
terms count once.

Null and empty texts have no terms and get the score of a text without any. Labels that
are null are left out; an id with several labels counts with each of them. Where there is
nothing to learn from, or one class only, every score is the share of toxic rows, as good as 0 if none.
Repeated rows are scored each, a very long text by all of its words. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.llm.bpe import Recent
from sluiceway.llm.common import held_out, in_batches, saved

SAMPLE = 10_000
TERMS = 2048
VECTOR = 8
# Steps of gradient descent, in whole passes.
STEPS = 500
BATCH = 256
# A term must occur in so many different documents of the sample.
LEAST = 4
BEGINNINGS = (4, 5)
# Pull of weights and vectors towards zero.
DECAY = 1e-3
SEED = 7

WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> tuple[int, ...]:
    """The hashed terms of one word; whole words and beginnings hash apart."""
    data = word.encode("utf-8", "surrogatepass")
    found = [zlib.crc32(data)]
    for n in BEGINNINGS:
        if len(word) >= n:
            found.append(zlib.crc32(word[:n].encode("utf-8", "surrogatepass"), n))
    return tuple(found)


def words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if isinstance(text, str) else set()


@F.pandas_udf(T.ArrayType(T.LongType()))
def hashed_terms(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known = Recent(word_terms)
    for part in texts:
        found = [set(chain.from_iterable(map(known.__getitem__, words(t)))) for t in part]
        yield pd.Series([np.fromiter(sorted(f), np.int64, len(f)) for f in found], dtype=object)


@dataclass
class Machine:
    """``terms`` are sorted; ``bias``, ``weights`` and ``vectors`` give the logit."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logit(self, at: np.ndarray) -> float:
        """``at``: the places in ``terms`` of the distinct terms of a text."""
        vectors = self.vectors[at]
        both = vectors.sum(axis=0) ** 2 - (vectors**2).sum(axis=0)
        return self.bias + float(self.weights[at].sum() + both.sum() / 2)


def _sigmoid(logit: np.ndarray | float):
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def constant(share: float) -> Machine:
    """A machine without terms."""
    kept = min(max(share, 1e-9), 1 - 1e-9)
    return Machine(np.zeros(0, np.int64), float(np.log(kept / (1 - kept))), np.zeros(0), np.zeros((0, VECTOR)))


def fit(terms: np.ndarray, found: list[np.ndarray], label: np.ndarray) -> Machine:
    """Fit a machine; ``found`` has the places in ``terms`` of each document's terms."""
    if not len(label) or label.min() == label.max():
        return constant(float(label.mean()) if len(label) else 0.0)
    rng = np.random.default_rng(SEED)
    k, size = len(terms), len(label)
    # Row 0 of the parameters holds the bias and no vector; the others weight and vector.
    values = np.zeros((k + 1, 1 + VECTOR), np.float32)
    values[1:, 1:] = rng.normal(0, 0.01, (k, VECTOR))
    values[0, 0] = np.log(label.mean() / (1 - label.mean()))
    first, second, step = np.zeros_like(values), np.zeros_like(values), 0
    while step < STEPS:
        order = rng.permutation(size)
        for at in range(0, size, BATCH):
            rows = order[at : at + BATCH]
            x = np.zeros((len(rows), k), np.float32)
            for i, row in enumerate(rows):
                x[i, found[row]] = 1
            weights, vectors = values[1:, 0], values[1:, 1:]
            sums = x @ vectors
            logit = values[0, 0] + x @ weights + ((sums**2).sum(1) - (x @ vectors**2).sum(1)) / 2
            off = ((_sigmoid(logit) - label[rows]) / len(rows)).astype(np.float32)
            slope = np.zeros_like(values)
            slope[0, 0] = off.sum()
            slope[1:, 0] = x.T @ off + DECAY * weights
            slope[1:, 1:] = x.T @ (off[:, None] * sums) - (x.T @ off)[:, None] * vectors + DECAY * vectors
            step += 1
            first = 0.9 * first + 0.1 * slope
            second = 0.999 * second + 0.001 * slope**2
            values -= 0.02 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Machine(terms, float(values[0, 0]), values[1:, 0].astype(float), values[1:, 1:].astype(float))


def best_terms(rows: DataFrame, share: float, size: int) -> np.ndarray:
    """The terms whose share of toxic documents is furthest from the overall one (chi-square), sorted."""
    counts = rows.select("y", F.explode("f").alias("term")).groupBy("term")
    counts = counts.agg(F.sum("y").alias("toxic"), F.count("*").alias("n")).filter(F.col("n") >= LEAST)
    off = F.pow(F.col("toxic") - F.col("n") * share, 2) / (share * (1 - share))
    # Documents with the term, and those without.
    score = off / F.col("n") + off / F.greatest(size - F.col("n"), F.lit(1))
    best = counts.filter(F.col("toxic") != F.col("n") * share).orderBy(F.desc(score), "term").limit(TERMS)
    return np.array(sorted(r["term"] for r in best.select("term").collect()), np.int64)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = SAMPLE,
) -> Machine:
    """Fit a machine to labelled documents that are not held out."""
    chosen = (
        labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y"))
        .filter(F.col("y").isNotNull() & F.col("k").isNotNull() & ~held_out(F.col("k")))
        .orderBy(F.xxhash64("k"), "k", "y")
        .limit(sample)
    )
    own = in_batches(docs).select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    # At most ``sample`` rows of two numbers, so the texts need not move.
    rows = own.join(F.broadcast(chosen), "k").select("k", "y", hashed_terms("t").alias("f"))
    # One text of each id, however many rows have it; then one document of those with equal terms.
    rows = rows.groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("f").alias("h"), "f")).alias("r"))
    rows = rows.select("y", "r.h", "r.f").groupBy("y", "h").agg(F.any_value("f").alias("f"))
    rows = saved(rows, "terms")
    counted = rows.agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).first()
    size, toxic = counted["n"], counted["toxic"] or 0
    if toxic in (0, size):
        return constant(toxic / size if size else 0.0)
    terms = best_terms(rows, toxic / size, size)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def places(parts: pd.Series) -> pd.Series:
        return pd.Series([np.flatnonzero(np.isin(terms, f, assume_unique=True)) for f in parts], dtype=object)

    table = rows.select("y", "h", places("f").alias("at")).orderBy("h", "y").toArrow()
    at = table["at"].combine_chunks()
    found = np.split(at.flatten().to_numpy(), np.cumsum(at.value_lengths().to_numpy())[:-1])
    return fit(terms, found, table["y"].to_numpy().astype(float))


def toxicity(text: Column, machine: Machine) -> Column:
    """The score of each text, 0 to 1."""

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        place = {term: at for at, term in enumerate(machine.terms.tolist())}
        known = Recent(lambda word: tuple(place[t] for t in word_terms(word) if t in place))
        for part in texts:
            logits = []
            for t in part:
                at = set(chain.from_iterable(map(known.__getitem__, words(t))))
                logits.append(machine.logit(np.fromiter(sorted(at), np.int64, len(at))))
            yield pd.Series(_sigmoid(np.array(logits, float)))

    return scores(text)


def score(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """``docs`` with the columns ``held_out``, ``score`` and ``predicted`` in place of any of these names."""
    machine = learn(docs, labels, key, text, label)
    scored = docs.withColumn("score", toxicity(F.col(f"`{text}`"), machine))
    scored = scored.withColumn("held_out", held_out(F.col(f"`{key}`")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
