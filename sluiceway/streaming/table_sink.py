"""Event tables that a stream commits batch by batch, so that readers see whole batches only.

Registered as ``event_tables``. Tasks write Parquet files under names of their own, which nobody
reads yet. When all tasks of a batch are done, one file in ``commits`` lists what they wrote; it appears
under the batch's number at once, and from then on the batch is there. A task that is killed leaves files
that no commit lists, and a batch that runs again after its commit finds it and withdraws its files. ``read_committed``
reads what is listed, and ``vacuum`` removes what is not.

    path/data/<database>/<table>/<name>.parquet
    path/commits/<batch>.json          the files of a batch
    path/commits/<batch>.compact.json  the files of all batches up to it, every ``compactEvery`` (10) batches

``path`` is a folder or a URI that pyarrow has a file system for, and is the same on all
machines. The rows need string columns ``database`` and ``table``. This module is sent to the
executors by value, so it imports nothing from the package where the sink runs.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
import urllib.parse
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage

# A task keeps so many files open; what it has to write beyond goes to further files.
MOST_OPEN = 64
COMPACT_EVERY = 10

_COMMIT = re.compile(r"(\d+)(\.compact)?\.json$")


def _system(path: str) -> tuple[pf.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pf.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _folder(name: str | None) -> str:
    """A name as the name of a folder; an empty or odd one too."""
    return "=" + urllib.parse.quote(name or "", safe="")


@dataclass
class Written(WriterCommitMessage):
    """The files a task has written: name below the path, database, table, rows."""

    files: list[tuple[str, str | None, str | None, int]]


class _Files:
    """The open files of a task, one per table."""

    def __init__(self, path: str) -> None:
        self.system, self.root = _system(path)
        self.open: dict[tuple, tuple[str, pq.ParquetWriter, list[int]]] = {}
        self.done: list[tuple[str, str | None, str | None, int]] = []

    def write(self, key: tuple[str | None, str | None], rows: pa.Table) -> None:
        if key not in self.open:
            if len(self.open) >= MOST_OPEN:
                self._close(next(iter(self.open)))
            name = f"data/{_folder(key[0])}/{_folder(key[1])}/{uuid.uuid4().hex}.parquet"
            self.system.create_dir(os.path.dirname(f"{self.root}/{name}"))
            writer = pq.ParquetWriter(f"{self.root}/{name}", rows.schema, filesystem=self.system)
            self.open[key] = (name, writer, [0])
        # The table written last is at the end, so the one that waits longest is closed first.
        name, writer, count = self.open[key] = self.open.pop(key)
        writer.write_table(rows)
        count[0] += len(rows)

    def _close(self, key: tuple) -> None:
        name, writer, count = self.open.pop(key)
        writer.close()
        self.done.append((name, *key, count[0]))

    def close(self) -> list[tuple[str, str | None, str | None, int]]:
        for key in list(self.open):
            self._close(key)
        return self.done


def _remove(path: str, names: list[str]) -> None:
    system, root = _system(path)
    for name in names:
        try:
            system.delete_file(f"{root}/{name}")
        except FileNotFoundError:
            pass


class TableWriter(DataSourceStreamArrowWriter):
    def __init__(self, schema: T.StructType, options: Mapping[str, str]) -> None:
        if not {"database", "table"} <= set(schema.names):
            raise ValueError("event tables need the columns database and table")
        self.path, self.schema = options["path"].rstrip("/"), schema.json()
        self.every = int(options.get("compactEvery", COMPACT_EVERY))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files = _Files(self.path)
        for batch in iterator:
            rows = pa.Table.from_batches([batch])
            names = rows.select(["database", "table"]).group_by(["database", "table"]).aggregate([])
            for database, table in zip(names["database"].to_pylist(), names["table"].to_pylist()):
                own = pc.and_(_is(rows["database"], database), _is(rows["table"], table))
                files.write((database, table), rows.filter(own))
        return Written(files.close())

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        files = [list(f) for m in messages if m for f in m.files]
        system, root = _system(self.path)
        system.create_dir(f"{root}/commits")
        name = f"{root}/commits/{batchId:020}.json"
        if system.get_file_info(name).type != pf.FileType.NotFound:
            # This batch runs again and is there already.
            _remove(self.path, [f[0] for f in files])
            return
        _put(system, name, {"schema": self.schema, "files": files})
        if self.every and (batchId + 1) % self.every == 0:
            listed = _listed(system, root, batchId)
            compact = {"schema": self.schema, "files": listed[1]}
            _put(system, f"{root}/commits/{batchId:020}.compact.json", compact)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        _remove(self.path, [f[0] for m in messages if m for f in m.files])


def _is(column: pa.ChunkedArray, value: str | None) -> pa.ChunkedArray:
    return pc.is_null(column) if value is None else pc.fill_null(pc.equal(column, value), False)


def _put(system: pf.FileSystem, name: str, content: dict) -> None:
    """A file that is whole under its name, or not there."""
    draft = f"{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(json.dumps(content).encode())
    system.move(draft, name)


def _listed(system: pf.FileSystem, root: str, until: int | None = None) -> tuple[str | None, list[list]]:
    """The schema and the files of all commits, up to a batch: of the last compact one and those behind it."""
    found = system.get_file_info(pf.FileSelector(f"{root}/commits", allow_not_found=True))
    commits, compact = {}, -1
    for info in found:
        match = _COMMIT.match(info.base_name)
        if match and (until is None or int(match[1]) <= until):
            commits[int(match[1]), bool(match[2])] = info.path
            compact = max(compact, int(match[1])) if match[2] else compact
    chosen = sorted(k for k in commits if (k == (compact, True)) or (k[0] > compact and not k[1]))
    schema, files = None, []
    for key in chosen:
        with system.open_input_stream(commits[key]) as stream:
            content = json.loads(stream.read())
        schema = content["schema"]
        files += content["files"]
    return schema, files


class EventTables(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_tables"

    def schema(self) -> str:
        raise NotImplementedError("read_committed reads event tables")

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> TableWriter:  # noqa: N802
        return TableWriter(schema, self.options)


def register(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(EventTables)


def read_committed(
    spark: SparkSession, path: str, database: str | None = None, table: str | None = None
) -> DataFrame:
    """The rows of all committed batches, of one database or table only where one is named.

    Files of other tables are not opened. Without a commit there is no schema and a ``FileNotFoundError``.
    """
    system, root = _system(path)
    schema, files = _listed(system, root)
    if schema is None:
        raise FileNotFoundError(f"{path} has no committed batch")
    columns = T.StructType.fromJson(json.loads(schema))
    wanted = [f for f in files if database in (None, f[1]) and table in (None, f[2])]
    if not wanted:
        return spark.createDataFrame([], columns)
    return spark.read.schema(columns).parquet(*[f"{path.rstrip('/')}/{f[0]}" for f in wanted])


def vacuum(path: str, older_than_s: float = 7 * 24 * 3600.0) -> list[str]:
    """Remove files that no commit lists, if they are older than any batch that may still run; gives their names."""
    system, root = _system(path)
    listed = {f[0] for f in _listed(system, root)[1]}
    found = system.get_file_info(pf.FileSelector(f"{root}/data", recursive=True, allow_not_found=True))
    gone = []
    for info in found:
        name = info.path[len(root) + 1 :]
        old = info.mtime is not None and time.time() - info.mtime.timestamp() >= older_than_s
        if info.is_file and name not in listed and old:
            gone.append(name)
    _remove(path, gone)
    return sorted(gone)
