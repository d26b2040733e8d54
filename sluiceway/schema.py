"""Schemas of the tables that pass between operators."""

from __future__ import annotations

from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("event_data", T.StringType()),
    ]
)

LINES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("inode", T.LongType()),
        T.StructField("byte_offset", T.LongType()),
        T.StructField("byte_length", T.LongType()),
        T.StructField("line", T.StringType()),
    ]
)

PROPERTIES = T.ArrayType(
    T.StructType(
        [
            T.StructField("key", T.StringType()),
            T.StructField("values", T.ArrayType(T.StringType())),
        ]
    )
)

ROUTES = T.StructType(
    [
        T.StructField("route_no", T.IntegerType()),
        T.StructField("event_name_match", T.StringType()),
        T.StructField("target", T.StringType()),
    ]
)

BINDINGS = T.StructType(
    [
        T.StructField("event_name", T.StringType()),
        T.StructField("interval_micros", T.LongType()),
        T.StructField("source_no", T.IntegerType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("properties", PROPERTIES),
    ]
)

OUTPUTS = T.StructType(
    [
        T.StructField("output_no", T.IntegerType()),
        T.StructField("output_name", T.StringType()),
        T.StructField("plugin", T.StringType()),
        T.StructField("properties", PROPERTIES),
    ]
)

CHECKPOINTS = T.StructType(
    [
        T.StructField("checkpoint_key", T.StringType()),
        T.StructField("inode", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)

DELIVERIES = T.StructType(
    [
        T.StructField("database", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("attempt", T.IntegerType()),
    ]
)
