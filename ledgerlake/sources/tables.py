"""Files in and out: company lists, charts of accounts, candidates, statements, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.evaluate import require_columns


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """A company list with a header; every column is text, so that symbols keep their zeros, and a byte order mark is dropped."""
    raw = spark.read.option("header", True).csv(path)
    return raw.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in raw.columns})


def chart_of_accounts(grid: DataFrame) -> DataFrame:
    """Accounts below the header row (Field Code, Field Name, within ten rows) of each sheet (sheet, row_no, code, name), in order."""
    head = grid.filter((F.col("row_no") <= 10) & (F.trim("code") == "Field Code") & (F.trim("name") == "Field Name")).groupBy("sheet").agg(F.min("row_no").alias("head"))
    rows = grid.join(head, "sheet").filter((F.col("row_no") > F.col("head")) & (F.trim("code") != ""))
    return rows.select("sheet", F.row_number().over(Window.partitionBy("sheet").orderBy("row_no")).alias("ordinal"), F.trim("code").alias("item_code"), F.trim("name").alias("item_name_std"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """The candidate pool with its text for quoting; a pool without the needed columns is an error."""
    pool = require_columns(spark.read.parquet(path), ["filing_id", "stmt", "field", "candidate_rank", "score"])
    return pool.withColumn("raw_text", F.concat_ws(" ", *(c for c in ("tag", "value_raw", "unit_ref", "context_ref") if c in pool.columns)))


def write_statements(rows: DataFrame, path: str) -> None:
    """Rows by market and fiscal_year. Only the partitions that rows hold are replaced, whole; all others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("market", "fiscal_year").parquet(path)


def written_partitions(spark: SparkSession, path: str) -> DataFrame:
    """market and fiscal_year of what write_statements has written, from the folders' names; files aren't read for it."""
    return spark.read.parquet(path).select(F.col("market").cast("string").alias("market"), F.col("fiscal_year").cast("int").alias("fiscal_year")).distinct()


def write_observed(rows: DataFrame, path: str, metrics: dict[str, Column]) -> DataFrame:
    """Writes rows as write_statements does and returns one row of metrics (aggregates by name), observed by the writing job
    itself: nothing is read or computed a second time."""
    seen = Observation()
    write_statements(rows.observe(seen, *(c.alias(n) for n, c in metrics.items())), path)
    return rows.sparkSession.createDataFrame([seen.get])


def write_report(rows: DataFrame, path: str) -> None:
    """A metrics report of a few rows as one CSV file."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_anomalies(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def list_files(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """path and length of all files below a folder whose names fit the pattern; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path).select("path", "length")
