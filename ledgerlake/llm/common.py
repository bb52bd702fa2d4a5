"""Helpers shared by the training-data operators: table access and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of the corpus contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="ledgerlake-")


def scratch_path(spark: SparkSession) -> str:
    """A new folder in the shared folder that spark.checkpoint.dir names; a local one only where that is unset and Spark local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base or _own_folder()}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read back: lineage is cut, and lost executors lose nothing."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """df (a written table) marked for broadcast if it has at most max_rows rows; else unmarked, and the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def uniform(*key: Column) -> Column:
    """A double strictly between 0 and 1 that only the key decides."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: Copies of a row are dealt out in arrays of at most this length.
_COPIES = 4096


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row of df as often as its column times says (0 or null: not at all), without that column."""
    whole = F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(_COPIES).cast("long")))
    parts = df.filter(F.col(times) > 0).withColumn("_from", whole)
    return parts.withColumn("_copy", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + _COPIES, F.col(times)) - 1))).drop("_from", "_copy", times)


def numbered(df: DataFrame, groups: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """df, its rows numbered from 0 within their group (null is a group) by order (nulls first), in a long column _place.

    Rows are dealt by ranges of groups and order, so that a group or a run of equal rows of any size is spread over many
    tasks; a narrow row per task and group moves the tasks' own numbers up. df must not have columns _place, _tie, _task
    or _row.
    """
    keys = [*groups, *order, "_tie"]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    dealt = written(dealt.withColumn("_task", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    runs = dealt.groupBy("_task", *groups).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    runs = written(runs.select(F.col("_task").alias("_of"), *(F.col(g).alias(f"_of_{g}") for g in groups), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_up")))
    same = F.col("_task") == F.col("_of")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    placed = dealt.join(small_side(runs, 1_000_000), same).withColumn("_place", F.col("_row") + F.col("_up"))
    return placed.drop("_task", "_row", "_up", "_of", *(f"_of_{g}" for g in groups))
