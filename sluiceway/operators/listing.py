"""What is configured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_bindings(bindings: DataFrame, routes: DataFrame) -> DataFrame:
    """Every event with the sources it is made from and the targets it goes to.

    One row per event and source or target, ``item_kind`` telling which; an event
    of any number of sources stays spread over rows instead of one long list.
    """
    sources = bindings.select(
        "event_name",
        F.lit("source").alias("item_kind"),
        F.col("source_no").cast("bigint").alias("item_no"),
        F.col("source_name").alias("item_name"),
    )
    targets = routes.select(
        F.col("event_name_match").alias("event_name"),
        F.lit("target").alias("item_kind"),
        F.col("route_no").cast("bigint").alias("item_no"),
        F.col("target").alias("item_name"),
    )
    return sources.unionByName(targets).distinct()


def count_bindings(listed: DataFrame) -> DataFrame:
    """Per event, how many sources and targets it has."""
    return listed.groupBy("event_name").agg(
        F.count_if(F.col("item_kind") == "source").alias("n_sources"),
        F.count_if(F.col("item_kind") == "target").alias("n_targets"),
    )
