"""Folders for written tables, and joins whose small side is counted before it is broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dictionaries (specs, labels, charts) of up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Rows that a task gets on average where a table is dealt by its size.
TASK_ROWS = 200_000


def scratch_path(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; a local one only on a local master without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base or tempfile.mkdtemp(prefix='ledgerlake-')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in a new scratch folder, read back: computed once however often it is used, lost executors or not."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys into as many parts as its rows ask for: what windows by the keys sort in a task stays the same for any
    size of df, whatever the session's number of partitions."""
    return df.repartition(max(1, -(-df.count() // TASK_ROWS)), *keys)


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
