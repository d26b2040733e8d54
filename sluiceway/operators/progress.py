"""How far each log file has been read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checkpoint_key(path: Column) -> Column:
    """The name under which a file's progress is kept: ``log_`` and the SHA-1 of its path."""
    return F.concat(F.lit("log_"), F.sha1(path))


def checkpoints(lines: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Per file the end of its last line, as ``checkpoint_key``, ``inode``, ``offset``.

    Lines need ``path``, ``inode``, ``byte_offset`` and either ``byte_length``
    (without the newline) or ``line``. Files whose checkpoint in ``previous`` says
    the same are left out.
    """
    length = F.col("byte_length") if "byte_length" in lines.columns else F.octet_length("line")
    latest = (
        lines.select("path", "inode", (F.col("byte_offset") + length + 1).alias("_end"))
        .groupBy("path", "inode")
        .agg(F.max("_end").alias("offset"))
        .select(checkpoint_key(F.col("path")).alias("checkpoint_key"), "inode", "offset")
    )
    if previous is None:
        return latest
    return latest.join(previous, ["checkpoint_key", "inode", "offset"], "left_anti")


def resume_offsets(files: DataFrame, saved: DataFrame) -> DataFrame:
    """Add ``start`` to files (``path``, ``inode``, ``size``): where reading goes on.

    That is the saved offset if the inode is still the same and the file is no
    shorter, and 0 otherwise: after a rotation or truncation all is read again.
    """
    known = saved.select(
        "checkpoint_key", F.col("inode").alias("_inode"), F.col("offset").alias("_offset")
    )
    valid = (F.col("inode") == F.col("_inode")) & (F.col("size") >= F.col("_offset"))
    return (
        files.withColumn("checkpoint_key", checkpoint_key(F.col("path")))
        .join(known, "checkpoint_key", "left")
        .withColumn("start", F.when(valid, F.col("_offset")).otherwise(F.lit(0)).cast("bigint"))
        .drop("checkpoint_key", "_inode", "_offset")
    )


def behind(checkpoints: DataFrame, files: DataFrame) -> DataFrame:
    """Add to checkpoints the ``size`` of their file and its ``lag``, the bytes still to be read.

    A file that was rotated or truncated lags by all of its bytes. Bytes of a line that has no end yet
    count as well. Checkpoints of files that are gone are left out.
    """
    now = files.select(
        checkpoint_key(F.col("path")).alias("checkpoint_key"), F.col("inode").alias("_inode"), "size"
    )
    goes_on = (F.col("inode") == F.col("_inode")) & (F.col("size") >= F.col("offset"))
    found = checkpoints.join(now, "checkpoint_key")
    lag = F.when(goes_on, F.col("size") - F.col("offset")).otherwise(F.col("size"))
    return found.withColumn("lag", lag.cast("bigint")).drop("_inode")
