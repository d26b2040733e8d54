"""Document fingerprints by winnowing, by SQL functions alone.

A text is lower-cased and cut into words; what is no letter, mark or digit only parts
words, unless there is nothing else. Scripts written without spaces count every letter as
a word. A rolling window of ``K`` words gives one hash per place, a text of fewer words
one hash of them all. Of every ``WINDOW`` hashes in a row the least is chosen, of equal
ones the rightmost, and each choice is kept once, with the place of its first word. So two
texts that share ``K + WINDOW - 1`` words in a row share a choice, wherever the words
stand, and texts that share no ``K`` words in a row share none but by a chance of 64 bits.

Null text is empty text and has no choice. Equal texts have equal fingerprints. Rows count
each on their own, repeated ones too, and an empty table gives no rows. A text takes memory
in proportion to its own length, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

K = 3
WINDOW = 4
# Rows that are put in order by one window, about; and at most so many windows.
ROWS = 500
MAX_RANGES = 1 << 16

# Scripts without spaces between words: of South-East Asia, kana, and ideographs.
UNSPACED = (
    r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}"
    r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]"
)
IN_WORDS = r"\p{L}\p{M}\p{N}"


def with_fingerprint(
    docs: DataFrame, text: str = "text", into: str = "fingerprint", k: int = K, window: int = WINDOW
) -> DataFrame:
    """Add the chosen hashes and their places, ``array<struct<hash bigint, position int>>`` by position.

    A column of the name ``into`` is replaced; the others stay.
    """
    if k < 1 or window < 1:
        raise ValueError("a window, and what it slides over, hold one or more")
    kept = [F.col(f"`{c}`") for c in docs.columns if c != into]
    # Steps in columns of their own: each is computed once, outside the lambdas that read it.
    low = F.lower(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    step = docs.select(*kept, low.alias("_low")).withColumn("_words", _words(F.col("_low"))).drop("_low")
    rolling = ", ".join(f"get(_words, i + {j})" for j in range(k))
    step = step.withColumn(
        "_hashes",
        F.expr(
            f"""CASE WHEN size(_words) = 0 THEN cast(array() AS array<bigint>)
            ELSE transform(sequence(0, greatest(size(_words) - {k}, 0)), i -> xxhash64({rolling})) END"""
        ),
    ).drop("_words")
    # Behind the last hash ``get`` gives null, which ``least`` and the comparison skip.
    inside = [f"get(_hashes, i + {j})" for j in range(window)]
    least = f"least({', '.join(inside)})" if window > 1 else inside[0]
    rightmost = " ".join(f"WHEN get(_hashes, s.i + {j}) = s.low THEN s.i + {j}" for j in reversed(range(window)))
    step = step.withColumn(
        "_chosen",
        F.expr(
            f"""CASE WHEN size(_hashes) = 0 THEN cast(array() AS array<int>)
            ELSE array_distinct(transform(
                transform(sequence(0, greatest(size(_hashes) - {window}, 0)), i -> struct(i AS i, {least} AS low)),
                s -> CASE {rightmost} END)) END"""
        ),
    )
    chosen = F.expr("transform(_chosen, at -> struct(get(_hashes, at) AS hash, at AS position))")
    return step.select(*kept, chosen.alias(into))


def _words(low: Column) -> Column:
    """The words of a text in lower case."""
    # Plain ASCII, told by its length in bytes, has none of these scripts.
    unspaced = (F.octet_length(low) > F.length(low)) & low.rlike(UNSPACED)
    spaced = F.when(unspaced, F.regexp_replace(low, f"({UNSPACED})", " $1 ")).otherwise(low)
    # A text of nothing but signs: runs between white space count as words.
    parts = F.when(low.rlike(f"[{IN_WORDS}]"), F.split(spaced, f"[^{IN_WORDS}]+")).otherwise(
        F.split(low, r"[\x20\x09-\x0D]+")
    )
    return F.array_remove(parts, "")


def digest(fingerprint: Column) -> Column:
    """A fingerprint as 32 hexadecimal digits, of its hashes and their places."""
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(seed), fingerprint)), 16, "0") for seed in (1, 2)]
    return F.lower(F.concat(*halves))


def likeness(one: Column, other: Column) -> Column:
    """Twice the shared hashes over the hashes of both, each hash counted once; 1 for two without any."""
    both = F.size(F.array_distinct(one["hash"])) + F.size(F.array_distinct(other["hash"]))
    shared = F.size(F.array_intersect(one["hash"], other["hash"]))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.lit(2.0) * shared / both)


def shared_places(one: Column, other: Column) -> Column:
    """Where two fingerprints meet: each shared hash with its places in the one and in the other."""

    def places(found: Column, of: Column) -> Column:
        return F.transform(F.filter(of, lambda f: f["hash"] == found), lambda f: f["position"])

    return F.transform(
        F.array_intersect(one["hash"], other["hash"]),
        lambda found: F.struct(
            found.alias("hash"), places(found, one).alias("positions"), places(found, other).alias("other_positions")
        ),
    )


def dealt_by_order(docs: DataFrame, key: str, rows: int = ROWS) -> DataFrame:
    """Rows dealt to ranges of a long key, for ``with_next``, by one shuffle.

    Ranges are cut at quantiles and hold about ``rows`` rows each, more where there would be over
    ``MAX_RANGES``. Each range also gets the first rows of the range behind it, the last one those of the
    first. A null key counts as the least one; the rows of one key stay together.
    """
    value = F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(-(2**63)))
    ranges = max(1, min(MAX_RANGES, docs.count() // rows))
    cuts: list[int] = []
    if ranges > 1:
        steps = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(docs.select(F.percentile_approx(value, steps, 20 * ranges)).first()[0]))
    ranged = docs.withColumn("_key", value).withColumn("_range", _cuts_below(F.col("_key"), cuts))
    # One row per range: its greatest key, which comes first by descending order.
    heads = sorted(ranged.groupBy("_range").agg(F.max("_key")).collect(), reverse=True)
    into = [heads[i - 1][0] for i in range(len(heads))]
    first = docs.sparkSession.createDataFrame(
        [(head[1], also) for head, also in zip(heads, into)], "_head bigint, _also int"
    )
    places = F.array(
        F.struct(F.col("_range").alias("_in"), F.lit(False).alias("_copy")),
        F.struct(F.col("_also").alias("_in"), F.lit(True).alias("_copy")),
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return (
        ranged.join(F.broadcast(first), F.col("_key") == F.col("_head"), "left")
        .select(*columns, "_key", F.inline(places))
        .filter("_in IS NOT NULL")
        .repartition("_in")
    )


def _cuts_below(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are less than a value, in two steps of the root of their number."""
    if not cuts:
        return F.lit(0)
    width = max(1, round(len(cuts) ** 0.5))
    blocks = F.size(F.filter(F.lit(cuts[::width]), lambda cut: cut < value))
    # All but the last of the blocks that begin below the value are below it.
    rest = F.slice(F.lit(cuts), F.greatest(blocks - 1, F.lit(0)) * width + 1, F.lit(width))
    return F.greatest(blocks - 1, F.lit(0)) * width + F.size(F.filter(rest, lambda cut: cut < value))


def with_next(dealt: DataFrame, carry: list[str]) -> DataFrame:
    """Add ``next``, a struct of the ``carry`` columns of the row behind by descending key, after the last the first.

    Takes rows of ``dealt_by_order``; columns may have been added in between. Rows of one key are in the order of the
    ``carry`` columns.
    """
    names = [F.col(f"`{c}`") for c in carry]
    order = W.partitionBy("_in").orderBy("_copy", F.desc("_key"), *names)
    behind = dealt.withColumn("_next", F.lead(F.struct(*names)).over(order))
    return behind.filter(~F.col("_copy")).drop("_in", "_copy", "_key").withColumnRenamed("_next", "next")
