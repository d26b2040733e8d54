"""Severity of log events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.config import ConfigError

# The levels from least to most severe; their rank is the place, from 1.
LEVELS = (
    "TRACE",
    "DEBUG",
    "INFO",
    "NOTICE",
    "WARNING",
    "ERROR",
    "CRITICAL",
    "ALERT",
    "EMERGENCY",
    "FATAL",
)


def rank_of(level: Column) -> Column:
    """The rank of a level name, null for a name that is no level."""
    return F.nullif(F.array_position(F.lit(list(LEVELS)), level), F.lit(0)).cast("int")


def severity_filter(events: DataFrame, minimum: str, level: str = "level") -> DataFrame:
    """Events at or above a level, with their ``severity_rank``."""
    if minimum not in LEVELS:
        raise ConfigError("EINVAL", f"unknown level {minimum}")
    ranked = events.withColumn("severity_rank", rank_of(F.col(level)))
    return ranked.filter(F.col("severity_rank") >= LEVELS.index(minimum) + 1)


def unknown_severity(events: DataFrame, level: str = "level") -> DataFrame:
    """The quarantine: events whose level is unknown or missing."""
    return events.filter(rank_of(F.col(level)).isNull())
