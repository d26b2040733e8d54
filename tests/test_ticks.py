import json
import time
from collections import Counter

import pytest

from sluiceway.config import ConfigError
from sluiceway.operators import envelope
from sluiceway.streaming import ticks

SCHEMA = "event_name string, event_data string"


@pytest.fixture(autouse=True)
def state(spark):
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ticks.use_state(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


def _drop(folder, name, rows):
    """A file of rows, there all at once."""
    folder.mkdir(exist_ok=True)
    part = folder / f".{name}"
    part.write_text("".join(json.dumps(r) + "\n" for r in rows))
    part.rename(folder / name)


class Kept:
    """What a stream gives, batch by batch, with the time it came."""

    def __init__(self):
        self.rows, self.batches = [], {}

    def __call__(self, batch, number):
        self.batches[number] = [(r, time.time()) for r in batch.collect()]
        self.rows = [x for rows in self.batches.values() for x in rows]


def _until(stream, done, seconds=60):
    end = time.time() + seconds
    while not done() and time.time() < end:
        if stream.exception():
            raise stream.exception()
        time.sleep(0.2)
    assert done()


def test_events_of_different_intervals_in_one_stream(spark, tmp_path):
    intervals = {"fast": 1_000_000, "slow": 3_000_000, "odd": 1_234_567}
    start_us = 1_700_000_000_000_000
    (tmp_path / "in").mkdir()
    records = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    kept = Kept()

    def begin():
        stream = ticks.on_ticks(records, intervals, start_us, shards=3)
        out = stream.writeStream.foreachBatch(kept).option("checkpointLocation", str(tmp_path / "c"))
        return out.trigger(processingTime="300 milliseconds").start()

    sent = Counter()
    running = begin()
    try:
        for i in range(3):
            rows = [{"event_name": n, "event_data": f"{n}{i}.{j}"} for n in [*intervals, "other"] for j in range(20)]
            rows.append({"event_name": None, "event_data": "none"})
            _drop(tmp_path / "in", f"f{i}.json", rows)
            sent.update((r["event_name"], r["event_data"]) for r in rows if r["event_name"] in intervals)
            time.sleep(1.5)
            if i == 1:
                # Stopped while records wait, and started again.
                running.stop()
                running = begin()
        _until(running, lambda: len(kept.rows) >= sum(sent.values()))
    finally:
        running.stop()
    assert Counter((r.event_name, r.event_data) for r, _ in kept.rows) == sent
    for name, interval in intervals.items():
        own = [r for r, _ in kept.rows if r.event_name == name]
        frame = spark.createDataFrame(own).select("time_us", "tick_us")
        again = envelope.tick_assign(frame, start_us, interval, tick="wanted")
        assert again.filter("tick_us <> wanted").count() == 0
        assert all(came * 1e6 >= r.tick_us for r, came in kept.rows)


def test_gaps_are_those_of_the_table(spark, tmp_path):
    interval, start_us = 60_000_000, 1_704_067_200_000_000
    numbers = {"a": [1, 2, 5, 5, 6, 10], "b": [3, 4], "c": [7, 100, 101, 250]}
    rows = [(n, start_us + i * interval) for n, of in numbers.items() for i in of]
    wanted = envelope.missed_ticks(
        spark.createDataFrame(rows, "event_name string, tick_us bigint"), start_us, interval
    ).collect()
    folder = tmp_path / "in"
    kept = Kept()
    # In order, over several files, each a batch of its own and each run a new query on the same state.
    ordered = sorted(rows, key=lambda r: r[1])
    for i in range(0, len(ordered), 5):
        _drop(folder, f"f{i:03}.json", [dict(zip(("event_name", "tick_us"), r)) for r in ordered[i : i + 5]])
        ticked = spark.readStream.schema("event_name string, tick_us bigint").json(str(folder))
        stream = ticks.gaps(ticked, {n: interval for n in numbers}, start_us, watch=False)
        out = stream.writeStream.foreachBatch(kept).option("checkpointLocation", str(tmp_path / "c"))
        assert out.trigger(availableNow=True).start().awaitTermination(60)
    found = [r for r, _ in kept.rows if not r.lasting]
    assert sorted((r.event_name, r.tick_us, r.missed) for r in found) == sorted(
        (r.event_name, r.tick_us, r.missed) for r in wanted
    )


def test_a_gap_that_lasts_is_reported(spark, tmp_path):
    """An event that falls silent is reported each interval, with more ticks missing each time."""
    interval = 1_000_000
    now = int(time.time()) * 1_000_000
    _drop(tmp_path / "in", "f.json", [{"event_name": "a", "tick_us": now - interval}, {"event_name": "a", "tick_us": now}])
    ticked = spark.readStream.schema("event_name string, tick_us bigint").json(str(tmp_path / "in"))
    kept = Kept()
    stream = ticks.gaps(ticked, {"a": interval}, 0, grace_us=200_000)
    out = stream.writeStream.foreachBatch(kept).option("checkpointLocation", str(tmp_path / "c"))
    running = out.trigger(processingTime="300 milliseconds").start()
    try:
        _until(running, lambda: len(kept.rows) >= 2)
    finally:
        running.stop()
    missed = [r.missed for r, _ in kept.rows]
    assert missed == sorted(set(missed)) and all(r.lasting for r, _ in kept.rows)
    assert all(r.tick_us == now + r.missed * interval for r, _ in kept.rows)


def test_intervals_below_a_millisecond(spark):
    with pytest.raises(ConfigError):
        ticks.on_ticks(spark.readStream.format("rate").load(), {"a": 999})
