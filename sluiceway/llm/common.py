"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.session import fresh_path

# One document in this many is held out from learning.
FOLDS = 5
# Bytes of a batch that goes to Python; Spark's bound is 10,000 rows, which whole texts make any size.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def in_batches(rows: DataFrame) -> DataFrame:
    """``rows``, which go to Python in batches of few bytes however long their texts are.

    A session setting, as Spark reads it when a query runs; one that the user has given stays.
    """
    conf = rows.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, BATCH_BYTES)
    return rows


def saved(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, written once to the shared folder and read back.

    Cuts the lineage: what is read later survives the loss of executors and is not
    computed anew.
    """
    spark = rows.sparkSession
    path = fresh_path(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def fold(key: Column) -> Column:
    """The fold of a document, 0 to 4, from its id as text; a null id counts as empty."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS


def held_out(key: Column) -> Column:
    return fold(key) == 0
