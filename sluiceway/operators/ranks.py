"""Position and predecessor within a key, without putting a whole hot key in one task.

Both work on a long ``order`` column; rows that are equal in it are told apart by ``ties``.
A key of up to ``limit`` rows is one window. The rows of a larger key are cut into as many
ranges as it has ``limit`` rows, at quantiles of order and ties together, so that a range holds
about ``limit`` rows however the values lie; one window each, and what crosses a boundary is
carried by one summary row per range. Rows that are equal in ``order`` and in all ``ties`` stay in one range.

The quantiles come from counts of the different values: all that are frequent, and of the others those that a hash
chooses, ``SAMPLE`` or so of either. So they are the same whenever a lost task is run again.

A key is cut into at most ``CUTS`` ranges, enough for four billion rows at the usual limit; ranges of
a larger key grow with it, in the sort that Spark spills.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LIMIT = 1 << 22
CUTS = 1024
SAMPLE = 1 << 16


def _large_keys(
    df: DataFrame, keys: Sequence[str], order: str, limit: int, ties: Sequence[str] = ()
) -> DataFrame:
    """The large keys and ``_cuts``: the last values of their ranges, but for the last range."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > limit)
    counted = (
        df.join(sizes, list(keys))
        .groupBy(*keys, F.struct(order, *ties).alias("_value"))
        .agg(F.count("*").alias("_count"), F.first("_rows").alias("_rows"))
    )
    # One in so many of the rare values stands for all of them.
    share = F.ceil(F.col("_rows") / F.lit(SAMPLE))
    frequent = F.col("_count") >= share
    chosen = counted.filter(frequent | (F.pmod(F.xxhash64("_value"), share) == 0)).withColumn(
        "_weight", F.col("_count") * F.when(frequent, 1).otherwise(share)
    )
    key = W.partitionBy(*keys)
    up_to = F.sum("_weight").over(key.orderBy("_value").rowsBetween(W.unboundedPreceding, 0))
    chosen = chosen.withColumn("_up_to", up_to).withColumn("_all", F.sum("_weight").over(key))
    ranges = F.least(F.ceil(F.col("_rows") / F.lit(limit)), F.lit(CUTS))

    def range_of(weight: Column) -> Column:
        return F.floor(weight * ranges / F.col("_all"))

    here = range_of(F.col("_up_to"))
    ends = chosen.filter((here > range_of(F.col("_up_to") - F.col("_weight"))) & (here < ranges))
    return ends.groupBy(*keys).agg(F.sort_array(F.collect_list("_value")).alias("_cuts"))


def _cut(
    df: DataFrame, large: DataFrame, keys: Sequence[str], order: str, how: str, ties: Sequence[str] = ()
) -> DataFrame:
    """Rows with their range: 0 for all rows of a key that is not large."""
    value = F.struct(order, *ties)
    into = F.size(F.filter(F.col("_cuts"), lambda cut: cut < value))
    return (
        df.join(large, list(keys), how)
        .withColumn("_range", F.when(F.col("_cuts").isNull(), 0).otherwise(into).cast("bigint"))
        .drop("_cuts")
    )


def position(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str = "round_no",
    limit: int = LIMIT,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Add the 1-based position of each row within its keys."""
    by_range = [*keys, "_range"]
    slim = df.select(*keys, order, *ties)
    large = _large_keys(slim, keys, order, limit, ties)
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        _cut(slim, large, keys, order, "inner", ties)
        .groupBy(*by_range)
        .agg(F.count("*").alias("_rows"))
        .withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .select(*by_range, "_base")
    )
    within = F.row_number().over(W.partitionBy(*by_range).orderBy(order, *ties)).cast("bigint")
    return (
        _cut(df, large, keys, order, "left", ties)
        .withColumn("_within", within)
        .join(bases, by_range, "left")
        .withColumn(name, F.col("_within") + F.coalesce(F.col("_base"), F.lit(0)))
        .select(*df.columns, name)
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "previous", limit: int = LIMIT
) -> DataFrame:
    """Rows that follow another within their keys, with the order value before theirs.

    Rows without an order value follow nothing and are left out.
    """
    by_range = [*keys, "_range"]
    slim = df.select(*keys, order)
    large = _large_keys(slim, keys, order, limit)
    inside = _cut(slim, large, keys, order, "left").withColumn(
        name, F.lag(order).over(W.partitionBy(*by_range).orderBy(order))
    )
    # The first row of a range follows the last one of the range before it.
    across = (
        _cut(slim, large, keys, order, "inner")
        .groupBy(*by_range)
        .agg(F.min(order).alias(order), F.max(order).alias("_last"))
        .withColumn(name, F.lag("_last").over(W.partitionBy(*keys).orderBy("_range")))
    )
    columns = [*keys, order, name]
    return (
        inside.select(*columns)
        .unionByName(across.select(*columns))
        .filter(F.col(name).isNotNull())
    )
