"""How far running streams are, as a table.

``ProgressListener`` keeps one small file per query, put in place anew with every batch: what
the last batch said of each source, how many rows have come from it over all runs, and when
it last moved. So the folder does not grow with time. ``read_progress`` gives the files as a table,
``log_checkpoints`` the positions of followed logs in it, and ``stalled`` the
sources that have something to read and do not read it.

A batch that is repeated after a restart counts once. A query that was ended by force
stays as its last batch left it.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from sluiceway import storage
from sluiceway.operators.progress import behind, checkpoint_key

SCHEMA = """query string, query_id string, run_id string, state string, error string, batch bigint, at timestamp,
    sources array<struct<source_no: int, source: string, rows: bigint, advanced_at: timestamp,
        end_offset: string, latest_offset: string>>"""
# Where the log source keeps its positions in an offset: path -> [inode, end of the last line taken].
POSITIONS = "`end` map<string, array<bigint>>"


class ProgressListener(StreamingQueryListener):
    """Writes the progress of every query of a session below ``folder``; add it with ``spark.streams.addListener``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self.known: dict[str, dict] = {}

    def _of(self, query_id: str) -> dict:
        """What is known of a query, also from the runs before."""
        if query_id not in self.known:
            text = storage.read_text(self.spark, f"{self.folder}/{query_id}.json")
            self.known[query_id] = json.loads(text) if text else {"query_id": query_id, "batch": -1, "sources": []}
        return self.known[query_id]

    def _keep(self, query_id: str, **said: object) -> None:
        now = self._of(query_id)
        now.update(said)
        storage.write_text(self.spark, f"{self.folder}/{query_id}.json", json.dumps(now))

    def onQueryStarted(self, event) -> None:
        self._keep(
            str(event.id), query=event.name, run_id=str(event.runId), state="running", error=None, at=event.timestamp
        )

    def onQueryProgress(self, event) -> None:
        said = event.progress
        before = self._of(str(said.id))
        # A batch without rows has the number of the next one.
        counts = said.batchId > before["batch"] and any(s.numInputRows > 0 for s in said.sources)
        sources = []
        for number, source in enumerate(said.sources):
            old = before["sources"][number] if number < len(before["sources"]) else {}
            moved = old.get("end_offset") != source.endOffset
            sources.append(
                {
                    "source_no": number + 1,
                    "source": source.description,
                    "rows": old.get("rows", 0) + (source.numInputRows if counts else 0),
                    "advanced_at": said.timestamp if moved else old["advanced_at"],
                    "end_offset": source.endOffset,
                    "latest_offset": source.latestOffset,
                }
            )
        self._keep(
            str(said.id),
            query=said.name,
            run_id=str(said.runId),
            state="running",
            batch=said.batchId if counts else before["batch"],
            at=said.timestamp,
            sources=sources,
        )

    def onQueryIdle(self, event) -> None:
        self._keep(str(event.id), run_id=str(event.runId), state="idle", at=event.timestamp)

    def onQueryTerminated(self, event) -> None:
        state = "failed" if event.exception else "ended"
        self._keep(str(event.id), run_id=str(event.runId), state=state, error=event.exception)
        # The next run may be watched by another listener.
        self.known.pop(str(event.id), None)


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    """A row per query and source: state, last batch, rows, when it last moved, and its offsets as JSON.

    ``batch`` is -1 before the first rows. A query that has not had a batch yet gives one row without a source.
    """
    queries = spark.read.schema(SCHEMA).json(f"{folder}/*.json")
    return queries.select("*", F.explode_outer("sources").alias("_source")).select(
        *[c for c in queries.columns if c != "sources"], "_source.*"
    )


def log_checkpoints(progress: DataFrame) -> DataFrame:
    """Per query, source and followed log ``path``, ``checkpoint_key``, ``inode`` and ``offset``; no rows for other sources."""
    positions = F.from_json("end_offset", POSITIONS)["end"]
    each = progress.select("query_id", "source_no", "advanced_at", F.explode(positions).alias("path", "_position"))
    return each.select(
        "query_id",
        "source_no",
        "advanced_at",
        "path",
        checkpoint_key(F.col("path")).alias("checkpoint_key"),
        F.col("_position")[0].alias("inode"),
        F.col("_position")[1].alias("offset"),
    )


def stalled(progress: DataFrame, files: DataFrame, now: datetime, patience: timedelta) -> DataFrame:
    """The sources that lag behind their ``files`` (``path``, ``inode``, ``size``) and have not moved for ``patience``.

    Gives ``query_id``, ``source_no``, ``advanced_at``, how many ``files`` lag and their ``lag`` in bytes.
    """
    lagging = behind(log_checkpoints(progress), files).filter("lag > 0")
    waiting = lagging.filter(F.col("advanced_at") <= F.lit(now - patience))
    return waiting.groupBy("query_id", "source_no", "advanced_at").agg(
        F.count("*").alias("files"), F.sum("lag").alias("lag")
    )
