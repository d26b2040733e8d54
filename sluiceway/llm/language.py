"""Language identification: known words first, shorter and shorter letter sequences for the rest.

A word that the model knows adds the logarithm of its frequency in each language. A word it
does not know is cut into sequences of five letters, word ends marked; if none of them
is known either, into sequences of four, and so on down to single letters. The known ones of that
length count as one word, by their mean. The language with the largest sum is predicted,
and its share of the summed likelihoods is the score.

The model is learned from at most ``SAMPLE`` documents with a language that are not held
out, those with the smallest hash of their id. Their words are counted by Spark, and the
``WORDS`` most frequent ones and the ``SEQUENCES`` most frequent letter sequences of each
length are kept, so its size is fixed and it is sent to every task.

Text that is null or holds no letter is ``und`` with score 0, as is all text where
nothing can be learned. Equally likely languages: the first by name. Of rows with the same id
one is learned from; each is predicted on its own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.bpe import Recent
from sluiceway.llm.common import held_out, saved

SAMPLE = 10_000
WORDS = 100_000
SEQUENCES = 20_000
LENGTHS = (5, 4, 3, 2, 1)
# Added to every count.
PRIOR = 0.5
UNKNOWN = "und"

WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """The words of a text in lower case; none if it holds no letter."""
    found = WORD.findall(text.lower()) if isinstance(text, str) else []
    return found if any(c.isalpha() for word in found for c in word) else []


def sequences(word: str, n: int) -> list[str]:
    """Sequences of ``n`` letters of a word with its ends marked; single ones without the marks."""
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """Known words and letter sequences; row i of each table has the log frequencies of entry i."""

    languages: list[str]
    words: list[str]
    word_table: np.ndarray
    sequences: list[str]
    sequence_table: np.ndarray

    def scorer(self) -> Callable[[str], bytes]:
        """Gives the log frequencies of a word as packed floats, in the order of ``languages``."""
        word_at = {word: i for i, word in enumerate(self.words)}
        at = {sequence: i for i, sequence in enumerate(self.sequences)}

        def score(word: str) -> bytes:
            known = word_at.get(word)
            if known is not None:
                return self.word_table[known].tobytes()
            for n in LENGTHS:
                found = [at[s] for s in sequences(word, n) if s in at]
                if found:
                    return self.sequence_table[found].mean(axis=0).tobytes()
            return bytes(4 * len(self.languages))

        return score


def _log_frequencies(counts: np.ndarray) -> np.ndarray:
    table = counts + PRIOR
    return np.log(table / table.sum(axis=0)).astype(np.float32)


def fit(names: list[str], languages: list[str], table: np.ndarray) -> Model:
    """A model from the counts of words (rows) by language (columns)."""
    kept: list[str] = []
    tables = [np.zeros((0, len(languages)), np.float32)]
    for n in LENGTHS:
        place: dict[str, int] = {}
        owner, found = [], []
        for i, word in enumerate(names):
            for s in sequences(word, n):
                owner.append(i)
                found.append(place.setdefault(s, len(place)))
        sums = np.zeros((len(place), len(languages)))
        for k in range(len(languages)):
            sums[:, k] = np.bincount(found, table[owner, k], len(place))
        by_name = list(place)
        best = sorted(range(len(place)), key=lambda s: (-sums[s].sum(), by_name[s]))[:SEQUENCES]
        kept += [by_name[s] for s in best]
        tables.append(_log_frequencies(sums[best]))
    return Model(languages, names, _log_frequencies(table), kept, np.concatenate(tables))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each language in a batch with their counts."""
    for batch in batches:
        counts: dict[str, Counter] = defaultdict(Counter)
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[language].update(words(text))
        for language, found in counts.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "language": pa.array([language] * len(found), pa.string()),
                    "word": pa.array(list(found), pa.string()),
                    "n": pa.array(list(found.values()), pa.int64()),
                }
            )


def learn(
    docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE
) -> Model:
    """A model from documents with a language that are not held out."""
    own = docs.select(
        F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{label}`").alias("l")
    ).filter(F.col("l").isNotNull() & ~held_out(F.col("k")))
    # At most ``sample`` ids, so the texts need not move.
    chosen = own.filter(F.col("k").isNotNull()).select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = own.join(F.broadcast(chosen), "k")
    # One row of each id, however many there are.
    rows = rows.groupBy("k").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "l", "t")).alias("r"))
    rows = rows.select("r.l", "r.t")
    counts = rows.mapInArrow(_count, "language string, word string, n long")
    counts = counts.groupBy("word", "language").agg(F.sum("n").alias("n"))
    by_word = counts.groupBy("word").agg(
        F.sum("n").alias("total"),
        F.collect_list(F.struct("language", "n")).alias("counts"),
    )
    best = by_word.orderBy(F.desc("total"), "word").limit(WORDS)
    found = saved(best, "words").orderBy("word").select("word", "counts").toArrow().combine_chunks()
    counted = found["counts"].combine_chunks()
    coded = counted.flatten().field("language").dictionary_encode()
    languages = sorted(coded.dictionary.to_pylist())
    column = np.array([languages.index(name) for name in coded.dictionary.to_pylist()], np.int64)
    table = np.zeros((len(found), len(languages)))
    if len(found):
        owner = np.repeat(np.arange(len(found)), counted.value_lengths().to_numpy())
        table[owner, column[coded.indices.to_numpy()]] = counted.flatten().field("n").to_numpy()
    return fit(found["word"].to_pylist(), languages, table)


def identify(text: Column, model: Model) -> Column:
    """``lang_pred`` and ``score`` of each text."""

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        n = len(model.languages)
        known = Recent(model.scorer())
        for part in texts:
            found = []
            for t in part:
                own = words(t)
                if not own or not n:
                    found.append((UNKNOWN, 0.0))
                    continue
                by_word = np.frombuffer(b"".join(map(known.__getitem__, own)), np.float32).reshape(-1, n)
                total = by_word.sum(axis=0, dtype=np.float64)
                best = int(total.argmax())
                found.append((model.languages[best], float(1 / np.exp(total - total[best]).sum())))
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return predicted(text)


def languages(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """For each row its ``key``, ``held_out``, ``lang_pred`` and ``score``."""
    model = learn(docs, key, text, label)
    found = identify(F.col(f"`{text}`"), model).alias("found")
    rows = docs.select(F.col(f"`{key}`").alias("key"), found)
    return rows.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "found.*")
