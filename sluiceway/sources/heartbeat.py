"""The heartbeat sensor: one record per host and tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.functions.json_text import json_escape

# Ticks one row expands to at once. A longer horizon is cut into chunks that are
# spread over the cluster before they expand.
CHUNK = 3600


def host_record(hostname: Column, fqdn: Column) -> Column:
    """The sensor's payload; a name that cannot be looked up is ``""``."""
    # The two keys and the spacing of the record.
    return F.concat(
        F.lit('{ "hostname": "'),
        json_escape(hostname),
        F.lit('", "hostname_fqdn": "'),
        json_escape(F.coalesce(fqdn, F.lit(""))),
        F.lit('" }'),
    )


def heartbeat(
    hosts: DataFrame,
    start_us: int,
    interval_us: int,
    ticks: int,
    hostname: str = "hostname",
    fqdn: str = "hostname_fqdn",
    event_name: str = "sys.alive",
    chunk: int = CHUNK,
) -> DataFrame:
    """``tick_us``, ``event_name`` and ``event_data`` for each host at each of the ticks.

    The first tick comes one interval after the start. Each host row expands to
    its own ticks, so nothing is joined.
    """
    named = hosts.select(host_record(F.col(hostname), F.col(fqdn)).alias("event_data"))
    first = F.lit(1).cast("bigint")
    if ticks > chunk:
        named = named.select(
            "event_data", F.explode(F.sequence(first, F.lit(ticks), F.lit(chunk))).alias("_from")
        )
        named = named.repartition("event_data", "_from")
        first = F.col("_from")
    last = F.least(first + (chunk - 1), F.lit(ticks))
    return named.select(
        F.explode(F.sequence(first, last)).alias("_no"), "event_data"
    ).select(
        (F.lit(start_us) + F.col("_no") * interval_us).alias("tick_us"),
        F.lit(event_name).alias("event_name"),
        "event_data",
    )


def heartbeat_stream(
    spark: SparkSession, hostname: str, fqdn: str = "", event_name: str = "sys.alive"
) -> DataFrame:
    """The sensor of one host as a stream of events: one in every micro-batch.

    To be run with an interval, so that a micro-batch is a tick.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    return ticks.select(
        F.current_timestamp().alias("time"),
        F.lit(event_name).alias("event_name"),
        host_record(F.lit(hostname), F.lit(fqdn)).alias("event_data"),
    )
