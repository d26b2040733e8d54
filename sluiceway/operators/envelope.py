"""Events: a time, a name and a payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.operators.ranks import LIMIT, with_previous


def micros(time: Column) -> Column:
    """Microseconds since the epoch, of a timestamp with or without a zone (read as UTC)."""
    return F.unix_micros(time.cast("timestamp"))


def whole(dividend: Column, divisor: int) -> Column:
    """The whole part of a division of longs."""
    return F.call_function("div", dividend, F.lit(divisor))


def tick_of(time_us: Column, start_us: int, interval_us: int) -> Column:
    """The tick at which a record that arrived at ``time_us`` is emitted.

    The first tick comes one interval after the start; a record goes out at the
    first tick at or after its arrival.
    """
    since = time_us - F.lit(start_us)
    # Rounded up in integers: a double cannot hold every microsecond.
    count = whole(since + F.lit(interval_us - 1), interval_us)
    return F.lit(start_us) + F.greatest(F.lit(1), count) * interval_us


def to_event(
    df: DataFrame, name: Column | str, payload: Column | str, time: Column | None = None
) -> DataFrame:
    """The envelope: ``time``, ``event_name``, ``event_data``.

    Without ``time`` all rows of one batch or micro-batch share the current time.
    """
    as_name = F.lit(name) if isinstance(name, str) else name
    as_payload = F.col(payload) if isinstance(payload, str) else payload
    as_time = F.current_timestamp() if time is None else time
    return df.select(
        as_time.alias("time"), as_name.alias("event_name"), as_payload.alias("event_data")
    )


def tick_assign(
    events: DataFrame, start_us: int, interval_us: int, time_us: str = "time_us", tick: str = "tick_us"
) -> DataFrame:
    """Add the tick of each record; all records of a tick share its time."""
    return events.withColumn(tick, tick_of(F.col(time_us), start_us, interval_us))


def missed_ticks(
    ticked: DataFrame,
    start_us: int,
    interval_us: int,
    event: str = "event_name",
    tick: str = "tick_us",
    limit: int = LIMIT,
) -> DataFrame:
    """Gaps in the emitted ticks: the tick after each gap, and how many were skipped.

    Missed ticks are reported, not made up.
    """
    number = whole(F.col(tick) - start_us, interval_us)
    numbered = ticked.select(event, number.alias("_no")).distinct()
    steps = with_previous(numbered, [event], "_no", "_before", limit)
    return steps.select(
        event,
        (F.col("_no") * interval_us + start_us).alias(tick),
        (F.col("_no") - F.col("_before") - 1).alias("missed"),
    ).filter(F.col("missed") > 0)
