"""Writing events to tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_tables(routed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write routed rows as Parquet under ``database=.../table=...``.

    The rebalance hint lets AQE cut a table that holds much of the data into
    several files and put small ones into few, so neither a hot table nor many
    small ones make the write slow.
    """
    spread = routed.hint("rebalance", F.col("database"), F.col("table"))
    spread.write.mode(mode).partitionBy("database", "table").parquet(path)


def read_tables(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows back, with ``database`` and ``table`` from the folder names, as text.

    An empty name is stored as a null partition and read as empty again. Where no row
    was routed there are no files to take the columns from, so give the ``schema`` that
    was written.
    """
    names = ["database", "table"]
    if schema is not None:
        first = [f for f in schema.fields if f.name not in names]
        columns = T.StructType([*first, *[T.StructField(n, T.StringType()) for n in names]])
        return spark.read.schema(columns).parquet(path).fillna("", subset=names)
    stored = spark.read.parquet(path)
    if any(stored.schema[name].dataType != T.StringType() for name in names):
        # All names of one kind look like numbers; read them as they are written.
        fields = [
            T.StructField(f.name, T.StringType()) if f.name in names else f for f in stored.schema
        ]
        stored = spark.read.schema(T.StructType(fields)).parquet(path)
    return stored.fillna("", subset=names)


def write_lines(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write payloads to text files, one event per line."""
    events.select(F.col("event_data").alias("value")).write.mode(mode).text(path)


def write_json(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write whole events to JSON-lines files."""
    events.write.mode(mode).json(path)


def write_kafka(records: DataFrame, servers: str) -> None:
    """Send topic, key and value columns to Kafka; needs Spark's Kafka connector."""
    records.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
