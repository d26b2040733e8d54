"""Starting streams."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluiceway.config import Binding, ConfigError, Output, Property
from sluiceway.operators.envelope import to_event
from sluiceway.operators.extract import extract_payload, wrap_raw
from sluiceway.sources.registry import Registry, default_registry
from sluiceway.sources.tail import tail_logs
from sluiceway.streaming.spool import Spool
from sluiceway.streaming.ticks import on_ticks, use_state
from sluiceway.streaming.writers import TICK, Offer, Writer, zip_writer


def start(
    events: DataFrame,
    write: Writer,
    checkpoint: str,
    interval_us: int | None = None,
    drain: bool = False,
) -> StreamingQuery:
    """Run a stream into a writer.

    With an interval one micro-batch is a tick: it takes all that is pending. A
    batch that takes longer than the interval is followed by the next one at once,
    and the ticks in between are skipped. Without one events go out as they are
    written. ``drain`` runs until nothing is pending and ends.
    """
    stream = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if drain:
        stream = stream.trigger(availableNow=True)
    elif interval_us is not None:
        if interval_us < 1000:
            raise ConfigError("EINVAL", "a stream ticks in whole milliseconds")
        stream = stream.trigger(processingTime=f"{interval_us // 1000} milliseconds")
    return stream.start()


def every_tick(records: DataFrame) -> DataFrame:
    """The records, with an empty row in every micro-batch, so that each tick has a batch.

    For the round zip: its sensors give a record at every tick, also when no log
    has a new line.
    """
    ticks = records.sparkSession.readStream.format("rate-micro-batch")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in records.schema]
    return records.unionByName(ticks.option("rowsPerBatch", 1).load().select(*empty))


def marked_ticks(events: DataFrame) -> DataFrame:
    """The events, with a row marked in ``_tick`` in every micro-batch, so that an output that is back need not wait for news."""
    return every_tick(events.withColumn(TICK, F.lit(None).cast("boolean"))).withColumn(
        TICK, F.when(F.col("event_name").isNull() & F.col("event_data").isNull(), F.lit(True))
    )


def log_events(
    spark: SparkSession, path: str, event_name: str, pattern: str | None = None, **options: object
) -> DataFrame:
    """A log file as a stream of events: fields of the pattern, or the raw line."""
    lines = tail_logs(spark, path, **options)
    payloads = wrap_raw(lines) if pattern is None else extract_payload(lines, pattern)
    return to_event(payloads, event_name, "event_data")


def monitor(events: DataFrame, name: str | None = None) -> StreamingQuery:
    """Show all events as they are emitted: on the console, or for tests as an in-memory table."""
    if name is None:
        return events.writeStream.foreachBatch(print_batch).start()
    return events.writeStream.format("memory").queryName(name).start()


def print_batch(batch: DataFrame, batch_id: int) -> None:
    """Print every row of a batch as JSON, one partition at a time."""
    fields = F.struct(*[F.col(f"`{c}`") for c in batch.columns])
    for row in batch.select(F.to_json(fields).alias("event")).toLocalIterator():
        print(row.event, flush=True)


def binding_events(
    spark: SparkSession, binding: Binding, registry: Registry, write: Writer, overlay: bool = False
) -> tuple[DataFrame, Writer]:
    """The stream of a binding, and the writer that turns its batches into events for ``write``.

    Events of one source go straight on. The sources of any other are lined up round by round:
    a round takes the next record of every source that has one, and a sensor's of the moment.
    """
    if len(binding.sources) == 1:
        records = registry.source(spark, binding.sources[0])
        return to_event(records, binding.event_name, "event_data"), write
    streams, sensors, order = [], {}, []
    for number, source in enumerate(binding.sources, start=1):
        name = f"{number}:{source.plugin}"
        order.append(name)
        sensor = registry.sensor(source)
        if sensor is not None:
            sensors[name] = sensor
        else:
            streams.append(registry.records(spark, source).select(F.lit(name).alias("source"), "*"))
    if streams:
        records = every_tick(reduce(DataFrame.unionByName, streams))
    else:
        ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
        kinds = {"source": "string", "path": "string", "byte_offset": "bigint", "record": "string"}
        records = ticks.select(*[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()])
    sources = [name for name in order if name not in sensors]
    return records, zip_writer(binding.event_name, sources, write, sensors, order, overlay)


def run(
    spark: SparkSession,
    bindings: Sequence[Binding],
    outputs: Sequence[Output],
    checkpoint: str,
    registry: Registry | None = None,
    overlay: bool = False,
    drain: bool = False,
) -> list[StreamingQuery]:
    """Run a configuration: every event at its interval, from all its sources to all outputs.

    A failing output stops no other, and gets what it missed when it is back; see ``Offer``. What waits for
    it is kept under ``checkpoint``. One streaming query per event, named after it; ``run_together`` has one for all.
    Outputs that keep files get a folder per event. ``drain`` ends with what is pending now.
    """
    registry = registry or default_registry()
    ordered = sorted(outputs, key=lambda o: o.output_no)
    queries = []
    for binding in bindings:
        # Batches of different events have the same numbers, so each event writes to a folder of its own.
        write = Offer(
            [(o.output_name, registry.output(_for_event(o, binding.event_name))) for o in ordered],
            Spool(f"{checkpoint}/_spool/{binding.event_name}"),
        )
        events, combined = binding_events(spark, binding, registry, write, overlay)
        if len(binding.sources) == 1 and not drain:
            # The batches of several sources come at every tick anyway.
            events = marked_ticks(events)
        queries.append(
            start(events, combined, f"{checkpoint}/{binding.event_name}", binding.interval_micros, drain)
        )
    return queries


def run_together(
    spark: SparkSession,
    bindings: Sequence[Binding],
    outputs: Sequence[Output],
    checkpoint: str,
    registry: Registry | None = None,
    start_us: int = 0,
    shards: int = 1,
    poll_ms: int = 500,
) -> StreamingQuery:
    """Run events of one source each, every one at its own interval, as a single query.

    Their records are one stream; each waits in state for the next tick of its event, see ``on_ticks``. All
    events go to the same folders of an output, so tell them apart by their routes. The query ends when it is stopped.
    """
    registry = registry or default_registry()
    for binding in bindings:
        if len(binding.sources) != 1:
            raise ConfigError("EINVAL", f"event {binding.event_name} has several sources, which need a stream of their own")
    use_state(spark)
    records = [
        to_event(registry.source(spark, b.sources[0]), b.event_name, "event_data").select("event_name", "event_data")
        for b in bindings
    ]
    intervals = {b.event_name: b.interval_micros for b in bindings}
    ticked = on_ticks(reduce(DataFrame.unionByName, records), intervals, start_us, shards)
    events = ticked.select(F.timestamp_micros("tick_us").alias("time"), "event_name", "event_data")
    ordered = sorted(outputs, key=lambda o: o.output_no)
    write = Offer([(o.output_name, registry.output(o)) for o in ordered], Spool(f"{checkpoint}/_spool"))
    return start(events, write, f"{checkpoint}/together", poll_ms * 1000)


def _for_event(output: Output, event_name: str) -> Output:
    """The output with the event's name behind each folder it names."""
    folders = ("path", "unrouted")
    properties = tuple(
        Property(p.key, tuple(f"{v}/{event_name}" for v in p.values)) if p.key in folders else p
        for p in output.properties
    )
    return replace(output, properties=properties)
