"""Fill-in-the-middle documents, cut at ranks that an indexable skip list finds.

A text is a row of units: a word with the white space before it, and white space at the
end. Two cuts at unit ranks make a prefix, a middle and a suffix, which are written out
in another order behind marks. The units of a text stand in a skip list: the lowest lane
links every unit to the next, each express lane some of those of the lane below, chosen
as by coin throws from the rank. A link carries its width in units and its width in code
points. A cut goes down from the highest lane, along each link that does not pass the
wanted rank, and what it has added up is the place of the cut in code points, exactly.

Null text is empty text: no units, written out as it is. A text that holds a mark is
written out as it is too, so that every output can be turned back. A null id counts as
an empty one. Rows are cut each on its own, so repeated rows give equal results, an empty
table gives no rows, and all other columns stay; columns of the names ``n``, ``form``,
``prefix_chars``, ``middle_chars`` and ``output`` are replaced. A text takes memory in
proportion to its own length, in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A unit of one lane in so many stands on the next lane too.
EXPRESS = 4
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Recipe:
    """How documents are cut: the seed, how many in a hundred, how many of these suffix first, the marks."""

    seed: int = 42
    rate: int = 50
    suffix_first: int = 80
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")


def unit_ends(text: str) -> np.ndarray:
    """The place behind each unit, in code points."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    space = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    before_space = np.append(space[1:], True)
    ends = np.flatnonzero(~space & before_space[: len(space)]) + 1
    return np.append(ends, len(codes)) if len(codes) and space[-1] else ends


@dataclass(frozen=True)
class Lane:
    """The links of a lane, from its nodes in order; ``below`` is where a node stands on the lane below."""

    units: np.ndarray
    points: np.ndarray
    below: np.ndarray


class SkipList:
    """The units of a text, found by rank."""

    def __init__(self, ends: np.ndarray) -> None:
        self.size = len(ends)
        places = np.concatenate(([0], ends))
        coins = _coins(self.size)
        # The head stands on every lane, before the first unit.
        ranks = np.arange(self.size, dtype=np.int64)
        below = ranks
        self.lanes: list[Lane] = []
        while True:
            to = np.append(ranks[1:], self.size)
            self.lanes.append(Lane(to - ranks, places[to] - places[ranks], below))
            up = coins[ranks] % EXPRESS == 0
            up[:1] = True
            if up.sum() <= 1 or up.all():
                break
            coins = coins // EXPRESS
            below = np.flatnonzero(up)
            ranks = ranks[below]

    def seek(self, rank: int) -> int:
        """The code points of the first ``rank`` units."""
        at, units, points = 0, 0, 0
        for lane in reversed(self.lanes):
            while at < len(lane.units) and units + lane.units[at] <= rank:
                units += int(lane.units[at])
                points += int(lane.points[at])
                at += 1
            if at == len(lane.units):
                # Behind the last unit; nothing further down.
                break
            at = int(lane.below[at])
        return points


def _coins(size: int) -> np.ndarray:
    """A row of mixed numbers, one per rank, the same for every text."""
    mixed = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))) >> np.uint64(4)


@dataclass(frozen=True)
class Cut:
    """One document written out; the lengths are None where it is plain."""

    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def cut(key: str, text: str, recipe: Recipe) -> Cut:
    """Cut and write out one text."""
    digest = hashlib.sha256(f"{recipe.seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[at : at + 8], 16) for at in range(0, 32, 8))
    units = SkipList(unit_ends(text))
    if not text or h3 % 100 >= recipe.rate or any(mark in text for mark in recipe.marks):
        return Cut(units.size, PLAIN, None, None, text)
    low, high = sorted((h1 % (units.size + 1), h2 % (units.size + 1)))
    first, second = units.seek(low), units.seek(high)
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    of_prefix, of_suffix, of_middle = recipe.marks
    if h4 % 100 < recipe.suffix_first:
        form, output = SPM, f"{of_suffix}{suffix}{of_prefix}{prefix}{of_middle}{middle}"
    else:
        form, output = PSM, f"{of_prefix}{prefix}{of_suffix}{suffix}{of_middle}{middle}"
    return Cut(units.size, form, len(prefix), len(middle), output)


def joined(output: str, form: str, recipe: Recipe) -> str:
    """The text that was written out as ``output``.

    The text holds no mark, and no mark begins as another ends, so the first one found is the one written.
    """
    if form == PLAIN:
        return output
    of_prefix, of_suffix, of_middle = recipe.marks
    one, two = (of_prefix, of_suffix) if form == PSM else (of_suffix, of_prefix)
    first, rest = output.removeprefix(one).split(two, 1)
    second, middle = rest.split(of_middle, 1)
    return f"{first}{middle}{second}" if form == PSM else f"{second}{middle}{first}"


_CUT = "n long, form string, prefix_chars long, middle_chars long"


def _cuts(keys: pd.Series, texts: pd.Series, recipe: Recipe) -> Iterator[Cut]:
    for key, text in zip(keys, texts):
        yield cut(key if isinstance(key, str) else "", text if isinstance(text, str) else "", recipe)


def _frame(rows: list[tuple], last: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", *last])
    return frame.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})


def fill_in_middle(
    docs: DataFrame, recipe: Recipe = Recipe(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Add ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and the whole ``output`` to each row."""

    @F.pandas_udf(f"{_CUT}, output string")
    def written(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, texts in parts:
            rows = [(c.n, c.form, c.prefix_chars, c.middle_chars, c.output) for c in _cuts(keys, texts, recipe)]
            yield _frame(rows, ["output"])

    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    made = written(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`"))
    return docs.select(*kept, made.alias("_cut")).select(*kept, *[F.col(f"_cut.{c}") for c in names])


def restore(output: Column, form: Column, recipe: Recipe = Recipe()) -> Column:
    """The text behind an output; null where either is null."""

    @F.pandas_udf("string")
    def texts(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in parts:
            both = [isinstance(o, str) and isinstance(f, str) for o, f in zip(outputs, forms)]
            yield pd.Series(
                [joined(o, f, recipe) if ok else None for o, f, ok in zip(outputs, forms, both)], dtype=object
            )

    return texts(output, form)


def round_trip(key: Column, text: Column, recipe: Recipe = Recipe()) -> Column:
    """Cut, write out and join again, keeping the figures and the digests of output and restored text.

    For the check of a whole corpus: the texts stay inside the Python worker.
    """

    @F.pandas_udf(f"{_CUT}, output_sha256 string, restored_sha256 string")
    def digests(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, texts in parts:
            rows = []
            for c in _cuts(keys, texts, recipe):
                back = joined(c.output, c.form, recipe)
                both = [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in (c.output, back)]
                rows.append((c.n, c.form, c.prefix_chars, c.middle_chars, *both))
            yield _frame(rows, ["output_sha256", "restored_sha256"])

    return digests(key.cast("string"), text)
