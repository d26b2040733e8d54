"""Batches that an output could not take, kept until it does.

Each output has a folder with one entry per batch it lacks, as Parquet under the batch's id, and a
small file with the number of attempts in a row that failed and the time of the next one. Entries are taken
up oldest first, and a later batch goes behind them, so an output gets its batches in order
and all of them. Nothing is given up. Many entries are put together into one, which goes out under the id of the
oldest.

A batch that runs again replaces its entry. An entry goes when the output has taken it; if the driver is
lost in between, the output gets it again under the same id.
"""

from __future__ import annotations

import json
import logging
import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway import storage

log = logging.getLogger(__name__)

# Seconds before the second attempt; twice as long before each further one, up to the most.
FIRST_PAUSE = 1.0
LONGEST_PAUSE = 300.0
# So many entries become one.
MANY = 16

_ENTRY = re.compile(r"entry=(\d+)-(\d+)$")


@dataclass(frozen=True)
class Entry:
    """Batches from ``first`` to ``last`` that wait together."""

    first: int
    last: int

    @property
    def name(self) -> str:
        return f"entry={self.first:020}-{self.last:020}"


@dataclass(frozen=True)
class State:
    """Attempts that failed in a row, and when the next one is due, in seconds since the epoch."""

    attempts: int = 0
    next_try: float = 0.0
    error: str = ""


class Spool:
    """What waits for the outputs, in a folder that the driver and all executors reach."""

    def __init__(
        self,
        path: str,
        first_pause: float = FIRST_PAUSE,
        longest_pause: float = LONGEST_PAUSE,
        many: int = MANY,
        clock: Callable[[], float] = time.time,
    ) -> None:
        self.path = path.rstrip("/")
        self.first_pause, self.longest_pause, self.many, self.clock = first_pause, longest_pause, max(2, many), clock

    def _folder(self, output: str) -> str:
        return f"{self.path}/output={re.sub(r'[^A-Za-z0-9._-]', lambda m: f'%{ord(m[0]):X}', output)}"

    def waiting(self, spark: SparkSession, output: str) -> list[Entry]:
        """The entries of an output, oldest first; what is inside a larger one is left out."""
        found = []
        for name in storage.names(spark, self._folder(output)):
            match = _ENTRY.match(name)
            # Spark marks a folder that is written whole.
            if match and storage.exists(spark, f"{self._folder(output)}/{name}/_SUCCESS"):
                found.append(Entry(int(match[1]), int(match[2])))
        found.sort(key=lambda e: (e.first, -e.last))
        kept: list[Entry] = []
        for entry in found:
            if kept and entry.last <= kept[-1].last:
                storage.remove(spark, f"{self._folder(output)}/{entry.name}")
            else:
                kept.append(entry)
        return kept

    def state(self, spark: SparkSession, output: str) -> State:
        text = storage.read_text(spark, f"{self._folder(output)}/_state.json")
        return State(**json.loads(text)) if text else State()

    def _failed(self, spark: SparkSession, output: str, failure: Exception) -> None:
        attempts = self.state(spark, output).attempts + 1
        pause = min(self.longest_pause, self.first_pause * 2 ** min(attempts - 1, 60))
        state = State(attempts, self.clock() + pause, f"{type(failure).__name__}: {failure}"[:1000])
        storage.write_text(spark, f"{self._folder(output)}/_state.json", json.dumps(state.__dict__))

    def _keep(self, output: str, batch: DataFrame, entry: Entry) -> None:
        batch.write.mode("overwrite").parquet(f"{self._folder(output)}/{entry.name}")

    def _read(self, spark: SparkSession, output: str, entry: Entry) -> DataFrame:
        return spark.read.parquet(f"{self._folder(output)}/{entry.name}")

    def _compact(self, spark: SparkSession, output: str, entries: list[Entry]) -> list[Entry]:
        """Many entries as one, with the batch of each row beside it."""
        if len(entries) < self.many:
            return entries
        whole = Entry(entries[0].first, entries[-1].last)
        parts = [self._read(spark, output, e) for e in entries]
        merged = parts[0]
        for part in parts[1:]:
            merged = merged.unionByName(part, allowMissingColumns=True)
        self._keep(output, merged, whole)
        for entry in entries:
            storage.remove(spark, f"{self._folder(output)}/{entry.name}")
        return [whole]

    def take_up(self, spark: SparkSession, output: str, write: Callable[[DataFrame, int], None]) -> Exception | None:
        """Give an output what waits for it, as far as it takes it; None if nothing waits any more.

        Before the next attempt is due, the answer is the failure of the last one.
        """
        entries = self.waiting(spark, output)
        if not entries:
            return None
        state = self.state(spark, output)
        if self.clock() < state.next_try:
            return RuntimeError(state.error)
        for entry in entries:
            rows = self._read(spark, output, entry)
            rows = rows.orderBy("_batch").drop("_batch") if entry.last > entry.first else rows.drop("_batch")
            try:
                write(rows, entry.first)
            except Exception as failure:
                self._failed(spark, output, failure)
                return failure
            storage.remove(spark, f"{self._folder(output)}/{entry.name}")
        storage.remove(spark, f"{self._folder(output)}/_state.json")
        return None

    def offer(
        self, output: str, write: Callable[[DataFrame, int], None], batch: DataFrame, batch_id: int
    ) -> Exception | None:
        """Give an output a batch behind all that waits for it, or keep it; the failure if it was not taken."""
        spark = batch.sparkSession
        known = any(e.first <= batch_id <= e.last for e in self.waiting(spark, output))
        failure = self.take_up(spark, output, write)
        if failure is None and known:
            # This batch runs again, and has just gone out of the spool.
            return None
        if failure is None:
            try:
                write(batch, batch_id)
                return None
            except Exception as found:
                failure = found
                self._failed(spark, output, found)
        self._keep(output, batch.withColumn("_batch", F.lit(batch_id).cast("bigint")), Entry(batch_id, batch_id))
        self._compact(spark, output, self.waiting(spark, output))
        return failure
