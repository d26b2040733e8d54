"""Log files as a data source: read once, or followed while they grow and rotate.

Registered as ``log_tail``. A record is a line that ends in a newline; the newline
is cut off and nothing else. An unfinished last line is left for later. Files are
found by path or glob pattern and must be reachable under the same path by the
driver and all executors.

A position is an inode and a byte offset per path. A file with another inode, or
shorter than the offset, was rotated or truncated and is read from its start; a
missing file keeps its position until it comes back, or loses it with ``forgetMissing``. What
was not read of a file before it was rotated away is an error with ``failOnDataLoss``, and
else lost, with a line in the log and a record in ``lossPath``. Small files share a task.

Options:

``path``              file or glob pattern
``splitBytes``        size of the byte ranges one task reads (128 MiB)
``maxBytesPerBatch``  how much one micro-batch reads, cut at line ends; leave it
                      out under ``availableNow``, which runs a single batch
``progressPath``      folder in which the planned position is kept; needed with
                      ``maxBytesPerBatch``, and where a new query starts
``failOnDataLoss``    fail when planned bytes are gone: true in a batch, false in a stream
``lossPath``          folder in which a stream that goes on keeps one JSON file per lost range
``forgetMissing``     drop the position of a file that is gone (false)
``startOffsets``      batch only: positions as JSON to read from
``endOffsets``        batch only: positions as JSON to read to

``onlyPaths``         batch only: JSON list of paths; the other files are not looked at
``onlyInodes``        batch only: JSON list of inodes; the other files are not opened
``fromOffset``        batch only: ranges whose lines all start before it are left out
``toOffset``          batch only: ranges whose lines all start at it or behind it are left out

These four are options and no pushed filters, as Spark 4.1 keeps what one query has pushed for the
next one over the same table, and mixes it up where a query reads the table twice.

This module is sent to the executors by value, so it imports nothing from the
package.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
import stat
import sys
from collections.abc import Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

SCHEMA = "path string, inode bigint, byte_offset bigint, byte_length bigint, line string"
SPLIT_BYTES = 128 << 20
BLOCK = 1 << 20
# Files looked at at once; a poll mostly waits for the file system.
_PARALLEL = 32

# Opening a file takes about as long as reading some of it.
_FILES_PER_TASK = 1000

# path -> [inode, end of the last line taken]
Positions = dict[str, list[int]]


def _paths(pattern: str) -> list[str]:
    pattern = pattern.removeprefix("file://").removeprefix("file:")
    if "://" in pattern:
        raise ValueError(f"{pattern}: log files are followed by inode, which needs a mounted folder")
    if glob.has_magic(pattern) and not os.path.exists(pattern):
        return sorted(glob.glob(pattern, recursive=True))
    return [pattern]


def _after_last_newline(fd: int, low: int, high: int) -> int:
    """The end of the last line in [low, high), or ``low`` if none ends there."""
    while high > low:
        at = max(low, high - BLOCK)
        found = os.pread(fd, high - at, at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        high = at
    return low


def _after_first_newline(fd: int, low: int, high: int) -> int:
    """The end of the first line that ends in [low, high), or ``high``."""
    while low < high:
        block = os.pread(fd, min(BLOCK, high - low), low)
        if not block:
            break
        found = block.find(b"\n")
        if found >= 0:
            return low + found + 1
        low += len(block)
    return high


def _start(known: list[int] | None, inode: int, size: int) -> int:
    return known[1] if known and known[0] == inode and size >= known[1] else 0


@dataclass(frozen=True)
class Wanted:
    """What a batch reads of the files: paths and inodes, if only some, and a span of offsets."""

    paths: frozenset[str] | None = None
    inodes: frozenset[int] | None = None
    low: int = 0
    high: int | None = None

    @staticmethod
    def of(options: Mapping[str, str]) -> Wanted:
        paths, inodes, high = options.get("onlyPaths"), options.get("onlyInodes"), options.get("toOffset")
        return Wanted(
            frozenset(json.loads(paths)) if paths else None,
            frozenset(json.loads(inodes)) if inodes else None,
            int(options.get("fromOffset") or 0),
            int(high) if high else None,
        )

    def path(self, path: str) -> bool:
        return self.paths is None or path in self.paths

    def inode(self, inode: int) -> bool:
        return self.inodes is None or inode in self.inodes

    def range(self, low: int, high: int) -> bool:
        """Whether a line that starts in [low, high) may have a wanted offset."""
        return high > self.low and (self.high is None or low < self.high)


def find_end(
    pattern: str,
    known: Mapping[str, list[int]],
    limit: int | None = None,
    forget: bool = False,
    wanted: Wanted | None = None,
) -> Positions:
    """Where the complete lines of all files end now, or of those that are wanted.

    With ``limit`` no more than about so many bytes lie between ``known`` and the
    result, shared among the files that have some; a file always gets at least one
    line.
    """
    paths = sorted({*_paths(pattern), *known})
    if wanted:
        paths = [path for path in paths if wanted.path(path)]
    with ThreadPoolExecutor(_PARALLEL) as pool:
        grown = [g for g in pool.map(lambda p: _grown(p, known.get(p)), paths) if g]
        if wanted:
            grown = [g for g in grown if wanted.inode(g[1])]
        share = None if limit is None else max(1, limit // max(1, len(grown)))
        ends = pool.map(lambda g: _end(*g, share), grown)
        found = {g[0]: [g[1], end] for g, end in zip(grown, ends) if end is not None}
        if forget:
            there = dict(zip(paths, pool.map(os.path.exists, paths)))
            paths = [p for p in paths if there[p]]
    # Paths keep their order, so that equal positions are equal as text.
    return {p: found.get(p) or list(known[p]) for p in paths if p in found or p in known}


def _grown(path: str, known: list[int] | None) -> tuple[str, int, int, int] | None:
    """Path, inode, start and size of a file that has changed since ``known``."""
    try:
        info = os.stat(path)
    except OSError:
        return None
    if not stat.S_ISREG(info.st_mode):
        return None
    start = _start(known, info.st_ino, info.st_size)
    if [info.st_ino, start] == known and info.st_size == start:
        return None
    return path, info.st_ino, start, info.st_size


def _end(path: str, inode: int, start: int, size: int, share: int | None) -> int | None:
    """The end of the last line of a file, or of as many lines as fit the share."""
    try:
        fd = os.open(path, os.O_RDONLY)
    except OSError:
        return None
    try:
        if os.fstat(fd).st_ino != inode:
            return None
        end = _after_last_newline(fd, start, size)
        if share is not None and end - start > share:
            cut = _after_last_newline(fd, start, start + share)
            end = cut if cut > start else _after_first_newline(fd, start + share, end)
        return end
    finally:
        os.close(fd)


def _ranges(
    begin: Mapping[str, list[int]], end: Mapping[str, list[int]], split_bytes: int, wanted: Wanted | None = None
) -> list[InputPartition]:
    """Byte ranges between two positions, as many to a task as make up ``split_bytes``.

    Cuts need not be at line ends.
    """
    tasks: list[list[tuple]] = []
    room = 0
    for path, (inode, stop) in end.items():
        if wanted and not (wanted.path(path) and wanted.inode(inode)):
            continue
        known = begin.get(path)
        start = known[1] if known and known[0] == inode and known[1] <= stop else 0
        for low in range(start, stop, split_bytes):
            high = min(low + split_bytes, stop)
            if wanted and not wanted.range(low, high):
                continue
            if high - low > room or len(tasks[-1]) == _FILES_PER_TASK:
                tasks.append([])
                room = split_bytes
            tasks[-1].append((path, inode, low, high, start, stop))
            room -= high - low
    return [InputPartition(tuple(task)) for task in tasks]


def _line_batch(path: str, inode: int, offset: int, chunk: bytes) -> pa.RecordBatch:
    """The lines of a chunk that starts and ends at line ends."""
    data = np.frombuffer(chunk, dtype=np.uint8)
    is_end = data == 10
    ends = np.flatnonzero(is_end)
    starts = np.concatenate(([0], ends[:-1] + 1))
    lengths = ends - starts
    try:
        chunk.decode("utf-8")
        cuts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        lines = pa.StringArray.from_buffers(
            len(ends), pa.py_buffer(cuts.tobytes()), pa.py_buffer(data[~is_end].tobytes())
        )
    except UnicodeDecodeError:
        texts = [part.decode("utf-8", "replace") for part in chunk.split(b"\n")[:-1]]
        lines = pa.array(texts, pa.string())
    return pa.RecordBatch.from_arrays(
        [
            pa.repeat(path, len(ends)),
            pa.repeat(pa.scalar(inode, pa.int64()), len(ends)),
            pa.array(starts + offset, pa.int64()),
            pa.array(lengths, pa.int64()),
            lines,
        ],
        names=["path", "inode", "byte_offset", "byte_length", "line"],
    )


def _lost(value: tuple, at: int, fail_on_loss: bool, folder: str | None) -> None:
    """Planned bytes from ``at`` on are gone: an error, or a record of them."""
    path, inode, _, high, _, _ = value
    if fail_on_loss:
        raise RuntimeError(f"{path} was rotated, truncated or removed before it was read")
    print(f"log_tail: lost {path} inode {inode} bytes {at} to {high}", file=sys.stderr, flush=True)
    if folder:
        os.makedirs(folder, exist_ok=True)
        record = {"path": path, "inode": inode, "from": at, "to": high}
        # A task that runs again writes the same file again.
        name = hashlib.sha1(json.dumps([path, inode, high]).encode()).hexdigest()
        with open(os.path.join(folder, f"lost_{name}.json"), "w") as file:
            json.dump(record, file)


def _read_range(value: tuple, fail_on_loss: bool, folder: str | None = None) -> Iterator[pa.RecordBatch]:
    """The lines that start in a range; the last one may end behind it."""
    path, inode, low, high, start, stop = value
    try:
        fd = os.open(path, os.O_RDONLY)
    except OSError:
        fd = -1
    try:
        info = os.fstat(fd) if fd >= 0 else None
        if info is None or info.st_ino != inode or info.st_size < stop:
            _lost(value, low, fail_on_loss, folder)
            return
        at = low if low == start else _after_first_newline(fd, low - 1, stop)
        # The beginning of a line so far; joined once, when its end is found.
        pending, pending_at = [], at
        while at < stop and (at < high or pending):
            # Behind the range only the rest of the line that began in it is wanted.
            until = high if at < high else _after_first_newline(fd, at, stop)
            block = os.pread(fd, min(BLOCK, until - at), at)
            if not block:
                # Cut while it was read.
                _lost(value, pending_at, fail_on_loss, folder)
                return
            at += len(block)
            whole = block.rfind(b"\n") + 1
            if whole:
                yield _line_batch(path, inode, pending_at, b"".join([*pending, block[:whole]]))
                pending, pending_at = [block[whole:]] if whole < len(block) else [], at - len(block) + whole
            else:
                pending.append(block)
    finally:
        if fd >= 0:
            os.close(fd)


def progress_file(folder: str, pattern: str) -> str:
    """The file that keeps the positions of a path or pattern."""
    return os.path.join(folder, "log_" + hashlib.sha1(pattern.encode()).hexdigest())


def load_progress(folder: str | None, pattern: str) -> Positions:
    """The kept positions; none if there are none or they cannot be read."""
    if not folder:
        return {}
    try:
        with open(progress_file(folder, pattern)) as file:
            return json.load(file)
    except (OSError, ValueError):
        return {}


def save_progress(folder: str, pattern: str, positions: Positions) -> None:
    """Keep positions, unless the kept ones are the same."""
    if load_progress(folder, pattern) == positions:
        return
    os.makedirs(folder, exist_ok=True)
    name = progress_file(folder, pattern)
    with open(f"{name}.{os.getpid()}", "w") as file:
        json.dump(positions, file)
        file.flush()
        os.fsync(file.fileno())
    os.replace(file.name, name)


def _flag(options: Mapping[str, str], name: str, default: str = "false") -> bool:
    return options.get(name, default).lower() == "true"


class LogTailReader(DataSourceReader):
    """Everything between two positions, the second one being now unless given."""

    def __init__(self, options: Mapping[str, str]) -> None:
        self.pattern = options["path"]
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.fail_on_loss = _flag(options, "failOnDataLoss", "true")
        self.loss_folder = options.get("lossPath")
        begin = options.get("startOffsets")
        end = options.get("endOffsets")
        self.begin = (
            json.loads(begin) if begin else load_progress(options.get("progressPath"), self.pattern)
        )
        self.end = json.loads(end) if end else None
        self.wanted = Wanted.of(options)

    def partitions(self) -> list[InputPartition]:
        end = find_end(self.pattern, self.begin, wanted=self.wanted) if self.end is None else self.end
        return _ranges(self.begin, end, self.split_bytes, self.wanted)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            for value in partition.value:
                yield from _read_range(value, self.fail_on_loss, self.loss_folder)


class LogTailStreamReader(DataSourceStreamReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.pattern = options["path"]
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.fail_on_loss = _flag(options, "failOnDataLoss")
        self.loss_folder = options.get("lossPath")
        self.forget = _flag(options, "forgetMissing")
        self.folder = options.get("progressPath")
        limit = options.get("maxBytesPerBatch")
        self.limit = int(limit) if limit else None
        if self.limit is not None and not self.folder:
            raise ValueError("maxBytesPerBatch needs progressPath, to go on from after a restart")
        # The last planned end, which the next one is measured from, and where the
        # query began.
        self.known = load_progress(self.folder, self.pattern)
        self.began = self.known

    def initialOffset(self) -> dict:
        # Spark asks again when it repeats the first batch, and progress has moved
        # by then. So this says nothing, and every offset carries where it all began.
        return {}

    def latestOffset(self) -> dict:
        return {"began": self.began, "end": find_end(self.pattern, self.known, self.limit, self.forget)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.began = end.get("began", {})
        self.known = dict(end.get("end", {})) if self.forget else {**self.known, **end.get("end", {})}
        if self.folder:
            save_progress(self.folder, self.pattern, self.known)
        return _ranges(start.get("end", self.began), end.get("end", {}), self.split_bytes)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            for value in partition.value:
                yield from _read_range(value, self.fail_on_loss, self.loss_folder)

    def commit(self, end: Positions) -> None:
        """Nothing to do: Spark keeps committed offsets, ``partitions`` the planned one."""


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogTailReader:
        return LogTailReader(self.options)

    def streamReader(self, schema) -> LogTailStreamReader:
        return LogTailStreamReader(self.options)


def register(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(LogTail)


def read_logs(
    spark: SparkSession,
    path: str,
    paths: Iterable[str] | None = None,
    inodes: Iterable[int] | None = None,
    from_offset: int | None = None,
    to_offset: int | None = None,
    **options: object,
) -> DataFrame:
    """All complete lines of the files now, or of some of them, or from one offset to before another.

    What is left out this way is not read; a filter on the lines gives the same rows, but reads all.
    """
    register(spark)
    found = spark.read.format("log_tail").options(**options)
    if paths is not None:
        found = found.option("onlyPaths", json.dumps(sorted(paths)))
    if inodes is not None:
        found = found.option("onlyInodes", json.dumps(sorted(inodes)))
    # A range holds lines before and behind the wanted ones too.
    if from_offset is not None:
        found = found.option("fromOffset", from_offset)
    if to_offset is not None:
        found = found.option("toOffset", to_offset)
    lines = found.load(path)
    if from_offset is not None:
        lines = lines.filter(lines["byte_offset"] >= from_offset)
    return lines if to_offset is None else lines.filter(lines["byte_offset"] < to_offset)


def list_logs(spark: SparkSession, path: str) -> DataFrame:
    """The files that a path or glob means now, with ``path``, ``inode`` and ``size``."""
    with ThreadPoolExecutor(_PARALLEL) as pool:
        found = [f for f in pool.map(lambda p: _grown(p, None), _paths(path)) if f]
    return spark.createDataFrame([(p, inode, size) for p, inode, _, size in found], "path string, inode bigint, size bigint")


def tail_logs(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The lines of the files as they are written."""
    register(spark)
    return spark.readStream.format("log_tail").options(**options).load(path)


@dataclass(frozen=True)
class Slice:
    """What a batch job reads: the lines added since the last one that was committed."""

    pattern: str
    folder: str
    begin: Positions
    end: Positions

    def read(self, spark: SparkSession, **options: object) -> DataFrame:
        positions = {"startOffsets": json.dumps(self.begin), "endOffsets": json.dumps(self.end)}
        return read_logs(spark, self.pattern, **positions, **options)

    def commit(self) -> None:
        """To be called when the job is done; without it the next one reads the same again."""
        save_progress(self.folder, self.pattern, self.end)


def next_slice(path: str, progress_path: str, limit: int | None = None) -> Slice:
    begin = load_progress(progress_path, path)
    return Slice(path, progress_path, begin, find_end(path, begin, limit))
