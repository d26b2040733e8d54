"""Table-wide jobs over text, number and time columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.text import SHAPES, has_shape


def field_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column how many values there are, and how many have each text shape.

    All counts are taken in one pass and leave one row per task for the shuffle.
    """
    counts = []
    for name in columns:
        value = F.col(name).cast("string")
        counts.append(
            F.struct(
                F.lit(name).alias("field"),
                F.count(name).alias("n_values"),
                *[F.count_if(has_shape(value, shape)).alias(f"n_{shape}") for shape in SHAPES],
            )
        )
    return df.agg(F.array(*counts).alias("_counts")).select(F.inline("_counts"))
