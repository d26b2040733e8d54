"""Several bindings as one table, and several sources as one event."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.json_text import check_last_win, overlay
from sluiceway.operators.ranks import LIMIT, position


def union_bindings(*events: DataFrame) -> DataFrame:
    """All bindings on one delivery path; duplicates stay."""
    return reduce(DataFrame.unionByName, events)


def round_zip(
    records: DataFrame,
    event: Sequence[str],
    sources: Sequence[str],
    *,
    source: str = "source",
    order: str = "byte_offset",
    record: str = "record",
    round_no: str | None = None,
    sensors: Mapping[str, Column] | None = None,
    ticks: DataFrame | None = None,
    limit: int = LIMIT,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Line up the records of an event's sources round by round.

    Round n takes the n-th record of every source; a source that has run out
    gives ``''``. Rounds go on while any source has records. A sensor has a fresh
    record in every round, so it is a column expression over the event keys
    rather than rows. Events listed in ``ticks`` get at least one round.

    ``order`` is a long; where it is not unique per event and source, as offsets of
    several files are, name in ``ties`` what tells such records apart, the path. Where the
    records carry their dense position already, name it as ``round_no`` and nothing is
    ranked. Gives the event keys, ``round_no`` and one column per source and
    sensor.
    """
    used = records.filter(F.col(source).isin(list(sources)))
    if round_no is None:
        narrow = used.select(*event, source, order, *ties, record)
        used = position(narrow, [*event, source], order, limit=limit, ties=ties)
    else:
        used = used.withColumn("round_no", F.col(round_no).cast("bigint"))
    used = used.select(*event, "round_no", source, record)
    if ticks is not None:
        first = ticks.select(
            *event,
            F.lit(1).cast("bigint").alias("round_no"),
            F.lit(None).cast("string").alias(source),
            F.lit(None).cast("string").alias(record),
        )
        used = used.unionByName(first)
    taken = [
        F.coalesce(F.max(F.when(F.col(source) == s, F.col(record))), F.lit("")).alias(s)
        for s in sources
    ]
    # A round is a handful of rows from different tasks: combining before the shuffle
    # would only sort them once more.
    zipped = used.repartition(*event, "round_no").groupBy(*event, "round_no").agg(*taken)
    return zipped.withColumns(dict(sensors)) if sensors else zipped


def merge_last(zipped: DataFrame, order: Sequence[str], payload: str = "event_data") -> DataFrame:
    """One payload per round: that of the last source as configured.

    An empty last record yields no event, whatever the sources before it hold.
    """
    kept = [c for c in zipped.columns if c not in order]
    return zipped.select(*kept, F.col(order[-1]).alias(payload)).filter(F.col(payload) != "")


def last_source(
    records: DataFrame,
    event: Sequence[str],
    last: str,
    *,
    source: str = "source",
    order: str = "byte_offset",
    record: str = "record",
    payload: str = "event_data",
    limit: int = LIMIT,
    ties: Sequence[str] = (),
) -> DataFrame:
    """What ``merge_last`` gives after ``round_zip``, read from the last source alone."""
    only = records.filter(F.col(source) == last).select(*event, order, *ties, record)
    ranked = position(only, list(event), order, limit=limit, ties=ties)
    return ranked.select(*event, "round_no", F.col(record).alias(payload)).filter(
        F.col(payload) != ""
    )


def merge_overlay(
    zipped: DataFrame, order: Sequence[str], payload: str = "event_data"
) -> DataFrame:
    """One payload per round: the sources' objects laid over each other in order.

    A round with a record that is no object gives its last record, as ``merge_last``
    does; no round with a record is lost.
    """
    check_last_win(zipped.sparkSession)
    kept = [c for c in zipped.columns if c not in order]
    merged = overlay(*[F.col(name) for name in order])
    return zipped.select(*kept, merged.alias(payload)).filter(F.col(payload) != "")
