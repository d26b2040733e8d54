"""Lines out of tables that hold one file per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.arrays import bind, exclusive_sums


def _terminated(text: Column) -> Column:
    """The parts that end in a newline. What follows the last newline is no line yet."""
    parts = F.split(text, "\n", -1)
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def split_lines(files: DataFrame, text: str = "text", keys: Sequence[str] = ()) -> DataFrame:
    """One row per line: the key columns, ``line_no`` from 1, and ``line``."""
    out = files.select(*keys, F.posexplode(_terminated(F.col(text))).alias("_pos", "line"))
    return out.select(*keys, (F.col("_pos") + 1).cast("bigint").alias("line_no"), "line")


def scan_lines(
    files: DataFrame, text: str = "text", keys: Sequence[str] = (), start: str | None = None
) -> DataFrame:
    """As ``split_lines``, with the ``byte_offset`` at which each line starts.

    The offsets are summed inside the row, so the scan needs no shuffle. With ``start``,
    a column of byte offsets, only what stands behind it is split, and line numbers
    count from there.
    """
    body, base = F.col(text), F.lit(0)
    if start is not None:
        base = F.col(start)
        rest = F.substr(body.cast("binary"), (base + 1).cast("int")).cast("string")
        body = F.when(base > 0, rest).otherwise(body)

    def located(parts: Column) -> Column:
        starts = exclusive_sums(F.transform(parts, lambda s: F.octet_length(s) + 1))
        return F.arrays_zip(starts.alias("byte_offset"), parts.alias("line"))

    found = bind(_terminated(body), located)
    out = files.select(*keys, F.posexplode(found).alias("_pos", "_l"))
    return out.select(
        *keys,
        (F.col("_pos") + 1).cast("bigint").alias("line_no"),
        (F.col("_l")["byte_offset"] + base).alias("byte_offset"),
        F.col("_l")["line"].alias("line"),
    )
