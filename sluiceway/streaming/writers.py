"""Functions for ``foreachBatch``.

Spark may run a micro-batch again after a failure. Each writer keeps a batch under
its own id and replaces what an earlier run of the same batch left, so a replay
changes nothing.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.config import Route
from sluiceway.operators.combine import merge_last, merge_overlay, round_zip
from sluiceway.operators.delivery import dead_letters, insert_payload, kafka_shape, redeliver
from sluiceway.operators.routing import reads_twice, route, unrouted
from sluiceway.operators.sinks import write_kafka, write_tables
from sluiceway.streaming.spool import Spool

log = logging.getLogger(__name__)

Writer = Callable[[DataFrame, int], None]
# Sends request bodies and answers with an HTTP status each, None for no answer.
Send = Callable[[Sequence[str]], Sequence["int | None"]]

_SENT = "database string, table string, event_data string, attempt int, http_status int"


def batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


@contextmanager
def _kept(batch: DataFrame) -> Iterator[None]:
    """Keep a batch that is gone over more than once, so that its source is read once.

    A batch that is kept already stays so; whoever kept it lets go of it.
    """
    level = batch.storageLevel
    if level.useMemory or level.useDisk:
        yield
        return
    batch.persist()
    try:
        yield
    finally:
        batch.unpersist()


def table_writer(path: str, routes: Sequence[Route] | DataFrame, unrouted_path: str | None = None) -> Writer:
    """Write events under ``batch_id=/database=/table=``, one row per route.

    Routes go by names or patterns, from a list or a table. Events without a route are dropped, or with ``unrouted_path``
    kept there as Parquet.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if not unrouted_path and not reads_twice(routes):
            write_tables(route(batch, routes), batch_path(path, batch_id), mode="overwrite")
            return
        with _kept(batch):
            write_tables(route(batch, routes), batch_path(path, batch_id), mode="overwrite")
            if unrouted_path:
                lost = unrouted(batch, routes)
                lost.write.mode("overwrite").parquet(batch_path(unrouted_path, batch_id))

    return write


# A column that marks the empty row of a batch that only keeps the ticks going.
TICK = "_tick"


class Offer:
    """Offers each batch to every output in turn, reading its source once.

    An output that fails stops no other. The failure is logged, and ``last_error`` has the name and
    the error of the last output that has not taken the latest batch, or None. With a ``spool`` the batch is kept
    for that output, and goes out behind all that waits for it once the output is back; without one it is
    lost to that output. Rows marked in a column ``_tick`` are no events; a batch of them alone only has the
    outputs take up what waits.
    """

    def __init__(self, writers: Sequence[tuple[str, Writer]], spool: Spool | None = None) -> None:
        self.writers, self.spool = list(writers), spool
        self.last_error: tuple[str, Exception] | None = None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        with _kept(batch):
            events, idle = batch, False
            if TICK in batch.columns:
                events = batch.filter(F.col(TICK).isNull()).drop(TICK)
                idle = events.isEmpty()
            self.last_error = None
            for name, write in self.writers:
                failure = self._give(batch.sparkSession, name, write, None if idle else events, batch_id)
                if failure is not None:
                    log.error("output %s failed on batch %s: %s", name, batch_id, failure)
                    self.last_error = (name, failure)

    def _give(
        self, spark: SparkSession, name: str, write: Writer, events: DataFrame | None, batch_id: int
    ) -> Exception | None:
        if self.spool and events is not None:
            return self.spool.offer(name, write, events, batch_id)
        if self.spool:
            return self.spool.take_up(spark, name, write)
        try:
            if events is not None:
                write(events, batch_id)
        except Exception as failure:
            return failure
        return None

    def retry(self, spark: SparkSession) -> None:
        """Have every output take up what waits for it, without a new batch."""
        for name, write in self.writers:
            failure = self.spool.take_up(spark, name, write) if self.spool else None
            if failure is not None:
                self.last_error = (name, failure)


def line_writer(path: str) -> Writer:
    """Write payloads to text files, one event per line."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch.select(F.col("event_data").alias("value")).write.mode("overwrite")
        out.text(batch_path(path, batch_id))

    return write


def kafka_writer(servers: str) -> Writer:
    """Send events to the Kafka topics of their names; at least once, as Kafka takes them."""
    return lambda batch, batch_id: write_kafka(kafka_shape(batch), servers)


def _send_all(rows: DataFrame, send: Send) -> DataFrame:
    def attempts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            try:
                answers = list(send(part["body"].tolist()))
            except OSError:
                # No connection, or no answer in time. Any other error is a fault of ``send``.
                answers = []
            # What got no answer counts as failed; failing here would send all again.
            answers = (answers + [None] * len(part))[: len(part)]
            part["http_status"] = pd.array(answers, dtype="Int32")
            yield part.drop(columns="body")

    bodies = insert_payload(rows.select("database", "table", "event_data", "attempt"))
    return bodies.mapInPandas(attempts, _SENT)


def delivery_writer(path: str, routes: Sequence[Route], send: Send, max_attempts: int = 3) -> Writer:
    """Send each routed event and keep every attempt with its answer.

    A batch first takes up what failed in the one before it and is worth another
    attempt; ``finish_deliveries`` does that for the last batch of all. The attempts are
    written before anything is read from them: asking for the outcome must not send again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        todo = route(batch, routes).select("database", "table", "event_data")
        if batch_id == 0:
            todo = todo.withColumn("attempt", F.lit(1))
        else:
            before = _stored(spark, f"{path}/{RETRIED}={batch_id - 1}")
            if before is None:
                before = spark.read.parquet(batch_path(path, batch_id - 1))
            todo = redeliver(dead_letters(before), todo, max_attempts)
        _send_all(todo, send).write.mode("overwrite").parquet(batch_path(path, batch_id))

    return write


RETRIED = "retried_batch_id"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def finish_deliveries(spark: SparkSession, path: str, batch_id: int, send: Send, max_attempts: int = 3) -> DataFrame:
    """Send again what failed in batch ``batch_id``, the last of a stream, until it went out or is worth no more.

    Gives all attempts made here. A stream that goes on later takes up from them.
    """
    failed = dead_letters(spark.read.parquet(batch_path(path, batch_id)))
    out = f"{path}/{RETRIED}={batch_id}"
    none = spark.createDataFrame([], "database string, table string, event_data string")
    turns = []
    for turn in range(max_attempts):
        todo = redeliver(failed, none, max_attempts)
        if todo.isEmpty():
            break
        _send_all(todo, send).write.mode("overwrite").parquet(f"{path}/_retry={batch_id}/{turn}")
        turns.append(spark.read.parquet(f"{path}/_retry={batch_id}/{turn}"))
        failed = dead_letters(turns[-1])
    made = spark.createDataFrame([], _SENT)
    for done in turns:
        made = made.unionByName(done)
    # What the next batch has to take up: only what is still worth an attempt, so nothing.
    (turns[-1] if turns else made).write.mode("overwrite").parquet(out)
    return made


def zip_writer(
    event_name: str,
    sources: Sequence[str],
    write: Writer,
    sensors: Mapping[str, Column] | None = None,
    order: Sequence[str] | None = None,
    overlay: bool = False,
) -> Writer:
    """Combine the records of several sources round by round, one tick per batch.

    Takes rows of ``source``, ``byte_offset`` and ``record``, and ``path`` where a source has
    several files; a line that yields no
    record is ``''`` and keeps its round. ``order`` names sources and sensors as
    configured, which decides the merge. Hands events on to ``write``.
    """
    order = list(order or [*sources, *(sensors or {})])

    def combined(batch: DataFrame, batch_id: int) -> None:
        tick = batch.sparkSession.range(0, 1, 1, 1).select(F.lit(event_name).alias("event_name"))
        with _kept(batch):
            named = batch.withColumn("event_name", F.lit(event_name))
            ties = ["path"] if "path" in batch.columns else []
            zipped = round_zip(
                named, ["event_name"], sources, sensors=sensors, ticks=tick, ties=ties
            )
            merged = merge_overlay(zipped, order) if overlay else merge_last(zipped, order)
            events = merged.select(F.current_timestamp().alias("time"), "event_name", "event_data")
            write(events, batch_id)

    return combined
