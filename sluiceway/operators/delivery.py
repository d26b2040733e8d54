"""What is sent to a target, and what became of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.json_text import json_quote

# The error name of each answer. 201 is success, and whatever is
# not listed, no answer included, is EIO.
SUCCESS = 201
STATUS_ERRORS = {400: "EINVAL", 401: "EACCESS", 403: "EACCESS"}
OTHER_ERROR = "EIO"


def insert_payload(routed: DataFrame, data: str = "event_data", body: str = "body") -> DataFrame:
    """The body of an insert request: a list with one row, the payload nested as an object.

    The payload is JSON text already and goes in as it is.
    """
    text = F.concat(
        F.lit('[{"database":'),
        json_quote(F.col("database")),
        F.lit(',"table":'),
        json_quote(F.col("table")),
        F.lit(',"data":'),
        F.col(data),
        F.lit("}]"),
    )
    return routed.withColumn(body, text)


def kafka_shape(events: DataFrame, topic: Column | None = None, key: Column | None = None) -> DataFrame:
    """Events as a Kafka sink takes them; the topic is the event name unless given."""
    return events.select(
        (F.col("event_name") if topic is None else topic).alias("topic"),
        (F.lit(None) if key is None else key).cast("string").alias("key"),
        F.col("event_data").alias("value"),
    )


def outcome_of(http_status: Column) -> Column:
    """The outcome of one delivery attempt; a null status is a request without answer."""
    outcome = F.when(http_status == SUCCESS, F.lit("OK"))
    for status, error in STATUS_ERRORS.items():
        outcome = outcome.when(http_status == status, F.lit(error))
    return outcome.otherwise(F.lit(OTHER_ERROR))


def with_outcome(deliveries: DataFrame, status: str = "http_status") -> DataFrame:
    return deliveries.withColumn("outcome", outcome_of(F.col(status)))


def delivery_outcome(deliveries: DataFrame) -> DataFrame:
    """Attempts per database, table and outcome."""
    return (
        with_outcome(deliveries)
        .groupBy("database", "table", "outcome")
        .agg(F.count("*").alias("attempts"))
    )


def dead_letters(deliveries: DataFrame) -> DataFrame:
    """Attempts that failed, kept instead of dropped."""
    return with_outcome(deliveries).filter(F.col("outcome") != "OK")


def redeliver(failed: DataFrame, fresh: DataFrame, max_attempts: int) -> DataFrame:
    """The next batch to send: fresh rows, and failed ones worth another attempt.

    Only a failure that may pass (EIO) is tried again, up to ``max_attempts``.
    ``fresh`` has the columns of the dead letters but ``outcome`` and
    ``http_status``; its rows start at attempt 1.
    """
    again = (
        failed.filter((F.col("outcome") == OTHER_ERROR) & (F.col("attempt") < max_attempts))
        .withColumn("attempt", F.col("attempt") + 1)
        .drop("outcome", "http_status")
    )
    return again.unionByName(fresh.withColumn("attempt", F.lit(1)))
