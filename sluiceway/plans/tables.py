"""The given tables in the terms of event collection, and the configuration the jobs use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.config import Output, Route
from sluiceway.operators.envelope import micros

START_US = 1_704_067_200_000_000  # 2024-01-01 00:00:00 UTC
MINUTE_US = 60_000_000
SECOND_US = 1_000_000

# The configuration of the log job: a line is a first word and a sentence; others do not match.
LINE_PATTERN = r"^(?<word>[A-Za-z]+) (?<rest>.*)\.$"
LOG_ROUTES = [
    Route(1, "text.lines", "text/lines"),
    Route(2, "host.alive", "hosts/alive"),
    Route(3, "host.alive", "hosts/history"),
]

URL_PATTERN = r"^(?<scheme>https?)://(?<host>[^/?#]+)(?<path>/[^?#]*)?(\?(?<query>[^#]*))?"

# signup has no route; error stops at a bad target before its second one.
ROUTES = [
    Route(1, "click", "web/click"),
    Route(2, "view", "web/view"),
    Route(3, "purchase", "shop/purchase"),
    Route(4, "purchase", "shop/purchase.rollup"),
    Route(5, "error", "ops"),
    Route(6, "error", "ops/err"),
]

# Events that number their routes alike; the bad target of click stops no other event.
SHARED_ROUTES = [
    Route(1, "click", "web"),
    Route(2, "click", "web/click"),
    Route(1, "view", "web/view"),
    Route(2, "view", "web/all"),
    Route(1, "error", "ops/errors"),
    Route(2, "error", "ops"),
    Route(3, "error", "ops/late"),
]

# A long list: for every letter one pattern each for names that begin with it, hold it and end in it.
MANY_ROUTES = [
    Route(3 * i + n + 1, pattern.format(letter), f"{kind}/{letter}.%E")
    for i, letter in enumerate("abcdefghijklmnopqrstuvwxyz")
    for n, (kind, pattern) in enumerate((("begin", "{}*"), ("hold", "*{}*"), ("end", "*{}")))
]

ORDER_ROUTES = [
    Route(1, "order.O", "orders/open"),
    Route(2, "order.F", "orders/done"),
    Route(3, "order.F", "orders/all"),
]

WILDCARD_ROUTES = [
    Route(1, "*", "mydb/%E"),
    Route(2, "p*", "shop/%E.rollup"),
    Route(3, "*ck", "web/%E"),
    Route(4, "s*n*p", "%E"),
    Route(5, "signup", "late/%E"),
    Route(6, "*rr*", "%E/all"),
]

OUTPUTS = [Output(1, "warehouse"), Output(2, "stream"), Output(3, "archive")]

# Fixed severity per event type; LOUD is no level.
LEVEL_OF = {"click": "DEBUG", "view": "INFO", "purchase": "NOTICE", "error": "ERROR", "signup": "LOUD"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as envelopes, with their id, user and value beside them."""
    return table(spark, folder, "events").select(
        "event_id",
        "user_id",
        "value",
        micros(F.col("ts")).alias("time_us"),
        F.col("event_type").alias("event_name"),
        F.col("props").alias("event_data"),
    )


def hosts(spark: SparkSession, folder: str) -> DataFrame:
    """``supplier`` as an inventory of hosts; some have no full name."""
    known = F.col("s_nationkey") < 20
    return table(spark, folder, "supplier").select(
        F.col("s_name").alias("hostname"),
        F.when(known, F.concat("s_name", F.lit(".nation"), "s_nationkey")).alias("hostname_fqdn"),
    )


def log_files(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as log files, one per row."""
    return table(spark, folder, "documents").select(
        F.concat(F.lit("/logs/"), "source", F.lit("/"), "doc_id").alias("path"),
        (F.col("doc_id") + 100).alias("inode"),
        F.octet_length("text").cast("bigint").alias("size"),
        "doc_id",
        "lang",
        "text",
    )


def level_of(event_name: Column) -> Column:
    level = F.lit(None).cast("string")
    for name, value in LEVEL_OF.items():
        level = F.when(event_name == name, F.lit(value)).otherwise(level)
    return level


def http_status(event_id: Column) -> Column:
    """A made-up answer per event: success, the error answers, and none."""
    kind = F.pmod(event_id, F.lit(7))
    status = F.lit(201)
    for number, value in ((1, 400), (2, 401), (3, 403), (4, 500), (5, None)):
        status = F.when(kind == number, F.lit(value)).otherwise(status)
    return status.cast("int")


def attempt(event_id: Column) -> Column:
    return (F.pmod(event_id, F.lit(3)) + 1).cast("int")
