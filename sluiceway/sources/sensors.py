"""JSON sensors: programs that print one object per interval into files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a system statistics sensor reports.
SYSTEM_STATS = T.StructType(
    [
        T.StructField("hostname", T.StringType()),
        T.StructField("cpu_user", T.DoubleType()),
        T.StructField("cpu_system", T.DoubleType()),
        T.StructField("load_1m", T.DoubleType()),
        T.StructField("memory_used", T.LongType()),
        T.StructField("memory_free", T.LongType()),
        T.StructField(
            "disks",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("mount", T.StringType()),
                        T.StructField("used", T.LongType()),
                        T.StructField("free", T.LongType()),
                    ]
                )
            ),
        ),
    ]
)


def parse_records(df: DataFrame, schema: T.StructType | str, record: str = "event_data") -> DataFrame:
    """Add the fields of a JSON record as columns; a field it lacks is null."""
    return df.withColumn("_fields", F.from_json(F.col(record), schema)).select(
        *df.columns, "_fields.*"
    )


def read_records(spark: SparkSession, path: str, event_name: str) -> DataFrame:
    """Sensor output files, one record per line, as events of this batch's time."""
    return _as_events(spark.read.text(path), event_name)


def stream_records(spark: SparkSession, path: str, event_name: str) -> DataFrame:
    """The same for files that keep arriving in a folder."""
    return _as_events(spark.readStream.text(path), event_name)


def _as_events(lines: DataFrame, event_name: str) -> DataFrame:
    return lines.filter(F.col("value") != "").select(
        F.current_timestamp().alias("time"),
        F.lit(event_name).alias("event_name"),
        F.col("value").alias("event_data"),
    )
