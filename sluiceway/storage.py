"""Small files in whatever storage Spark reaches, by its own file systems; for the driver."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple[Any, Any, Any]:
    """The JVM, the file system of a path, and the path in it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, sorted; nothing where there is no folder."""
    _, system, place = _at(spark, path)
    if not system.exists(place):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(place))


def exists(spark: SparkSession, path: str) -> bool:
    _, system, place = _at(spark, path)
    return system.exists(place)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None if there is none."""
    jvm, system, place = _at(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in place of any there is; it is whole under its name or not there."""
    _, system, place = _at(spark, path)
    _, _, draft = _at(spark, f"{path}.{uuid.uuid4().hex}")
    stream = system.create(draft, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if not system.rename(draft, place):
        # Some file systems do not rename onto a file.
        system.delete(place, False)
        if not system.rename(draft, place):
            raise OSError(f"cannot write {path}")


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or a whole folder; nothing happens where there is none."""
    _, system, place = _at(spark, path)
    system.delete(place, True)
