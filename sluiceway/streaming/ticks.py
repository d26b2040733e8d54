"""Ticks of many events in one stream, and the gaps between them, with state and timers.

Both keep state per event under ``transformWithState``, in RocksDB, so the state of many events
need not fit memory, and a query that is started again goes on with it.

``on_ticks`` holds each record until the next tick of its event: every event has an interval of its own,
and one streaming query serves them all. A timer per event wakes it at its tick; what is pending then
goes out with the time of the tick. The records of a hot event are dealt to ``shards`` states, as they
wait for the same ticks and for nothing else.

``gaps`` keeps the last tick of each event, one number. A tick that comes after missing ones
reports them, as ``missed_ticks`` does over a table; while an event is silent, a timer per interval
reports how many ticks it lacks so far.

A processing-time timer needs a batch to fire in. Spark starts batches without data for it as long
as the query runs, also under ``availableNow``, so a query with timers is one that is stopped and does not
end by itself. ``gaps`` can do without: ``watch=False`` drains like any other stream.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sluiceway.config import ConfigError

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

TICKED = T.StructType(
    [
        T.StructField("event_name", T.StringType()),
        T.StructField("event_data", T.StringType()),
        T.StructField("time_us", T.LongType()),
        T.StructField("tick_us", T.LongType()),
    ]
)
GAPS = T.StructType(
    [
        T.StructField("event_name", T.StringType()),
        T.StructField("tick_us", T.LongType()),
        T.StructField("missed", T.LongType()),
        T.StructField("lasting", T.BooleanType()),
    ]
)
# Records that one batch of rows hands on.
BATCH = 10_000


def use_state(spark: SparkSession) -> None:
    """Have the streams that are started from now on keep their state in RocksDB, which timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _tick_after(time_us: int, start_us: int, interval_us: int) -> int:
    """The first tick at or after a time, and no earlier than one interval after the start."""
    count = -(-(time_us - start_us) // interval_us)
    return start_us + max(1, count) * interval_us


def _checked(intervals: Mapping[str, int]) -> dict[str, int]:
    for name, interval in intervals.items():
        if interval < 1000:
            raise ConfigError("EINVAL", f"event {name}: a stream ticks in whole milliseconds")
    return dict(intervals)


class Ticker(StatefulProcessor):
    """Pending records of one event, and of one shard of it; see ``on_ticks``."""

    def __init__(self, intervals: Mapping[str, int], start_us: int) -> None:
        self.intervals, self.start_us = dict(intervals), start_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "event_data string, time_us bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        now_us = timerValues.getCurrentProcessingTimeInMs() * 1000
        for part in rows:
            self.pending.appendList([(data, now_us) for data in part["event_data"]])
        tick = _tick_after(now_us, self.start_us, self.intervals[key[0]])
        # A tick in the middle of a millisecond is due at its end.
        self.handle.registerTimer(-(-tick // 1000))
        yield pd.DataFrame(columns=TICKED.names)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        interval = self.intervals[key[0]]
        due_us = expiredTimerInfo.getExpiryTimeInMs() * 1000
        late, rows = [], []
        for data, time_us in self.pending.get():
            tick = _tick_after(time_us, self.start_us, interval)
            (rows if tick <= due_us else late).append((key[0], data, time_us, tick))
        # What has come since waits for its own timer.
        self.pending.clear()
        if late:
            self.pending.put([(data, time_us) for _, data, time_us, _ in late])
        for at in range(0, len(rows), BATCH):
            yield pd.DataFrame(rows[at : at + BATCH], columns=TICKED.names)

    def close(self) -> None:
        pass


def on_ticks(
    records: DataFrame, intervals: Mapping[str, int], start_us: int = 0, shards: int = 1
) -> DataFrame:
    """A stream of ``event_name`` and ``event_data``, each record held until the next tick of its event.

    Gives ``time_us``, when the record was taken in, and ``tick_us``, the tick it went out at: the one that
    ``tick_assign`` gives for that time. Intervals are in microseconds by event name, from one millisecond; records of
    other events, or without a name, go nowhere. Call ``use_state`` before the stream is started.
    """
    known = _checked(intervals)
    named = records.select("event_name", "event_data").filter(F.col("event_name").isin(list(known)))
    # Dealt by content: a batch that runs again deals alike.
    sharded = named.withColumn("shard", F.pmod(F.xxhash64("event_data"), F.lit(shards)).cast("int"))
    return sharded.groupBy("event_name", "shard").transformWithStateInPandas(
        Ticker(known, start_us), TICKED, "Append", "ProcessingTime"
    )


class GapFinder(StatefulProcessor):
    """The last tick of one event; see ``gaps``."""

    def __init__(self, intervals: Mapping[str, int], start_us: int, grace_us: int, watch: bool) -> None:
        self.intervals, self.start_us, self.grace_us, self.watch = dict(intervals), start_us, grace_us, watch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "number bigint")

    def _watch(self, number: int, interval: int) -> None:
        """Wake up when the tick ``number`` is overdue; one timer per event at most."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((self.start_us + number * interval + self.grace_us) // 1000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        interval = self.intervals[key[0]]
        numbers: set[int] = set()
        for part in rows:
            numbers.update(((part["tick_us"] - self.start_us) // interval).astype("int64"))
        last = self.last.get()[0] if self.last.exists() else None
        found = []
        for number in sorted(numbers):
            if last is not None and number <= last:
                continue
            if last is not None and number > last + 1:
                found.append((key[0], self.start_us + number * interval, number - last - 1, False))
            last = number
        self.last.update((int(last),))
        if self.watch:
            now_us = timerValues.getCurrentProcessingTimeInMs() * 1000
            # Of ticks that lie long behind, only those that are still to come are watched for.
            ahead = (now_us - self.start_us - self.grace_us) // interval + 1
            self._watch(max(int(last) + 1, ahead), interval)
        yield pd.DataFrame(found, columns=GAPS.names)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        interval = self.intervals[key[0]]
        last = self.last.get()[0]
        now_us = timerValues.getCurrentProcessingTimeInMs() * 1000
        due = (now_us - self.start_us - self.grace_us) // interval
        if due > last:
            yield pd.DataFrame([(key[0], self.start_us + due * interval, due - last, True)], columns=GAPS.names)
        self._watch(max(due, last) + 1, interval)

    def close(self) -> None:
        pass


def gaps(
    ticked: DataFrame, intervals: Mapping[str, int], start_us: int = 0, grace_us: int = 0, watch: bool = True
) -> DataFrame:
    """The gaps in a stream of ``event_name`` and ``tick_us``.

    A gap that has ended gives the tick after it and how many were skipped, as ``missed_ticks`` does, with
    ``lasting`` false. While one lasts, each interval gives the latest tick that is overdue by ``grace_us`` and how many are
    missing so far, with ``lasting`` true. Ticks that come after a later one of their event change nothing. The
    state is one number and one timer per event. Without ``watch`` there are no timers and no lasting gaps; a query that
    began one way cannot go on the other.
    """
    known = _checked(intervals)
    ticks = ticked.select("event_name", "tick_us").filter(F.col("event_name").isin(list(known)))
    return ticks.groupBy("event_name").transformWithStateInPandas(
        GapFinder(known, start_us, grace_us, watch), GAPS, "Append", "ProcessingTime" if watch else "None"
    )
