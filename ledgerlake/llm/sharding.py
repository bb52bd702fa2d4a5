"""Jump consistent hashing: stable keys to shards without a ring table.

Lamping and Veach's jump sequence, with xxhash64(key, step) as its random numbers: a key's shard is the last jump below
the shard count, so appending a shard moves only the keys whose next jump is exactly the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, utf8_size, written

#: Shards and tasks up to this many pairs (narrow rows) are broadcast; more are joined by shuffle.
BROADCAST_RUNS = 1_000_000
FACTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def jump_shards(key: Column, n_shards: int) -> Column:
    """struct(shard, grown): the key's shard among n_shards, and among n_shards + 1.

    A null key hashes like any other value. Each jump rises by one at least, so n_shards + 1 steps always suffice.
    """

    def step(acc: Column, i: Column) -> Column:
        draw = (F.shiftrightunsigned(F.xxhash64(key, i), 33) + 1) / F.lit(float(1 << 31))
        return F.struct(
            F.when(acc.j <= n_shards, F.floor((acc.j + 1) / draw)).otherwise(acc.j).cast("long").alias("j"),
            F.when(acc.j < n_shards, acc.j).otherwise(acc.shard).alias("shard"),
            F.when(acc.j <= n_shards, acc.j).otherwise(acc.grown).alias("grown"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("j"), zero.alias("shard"), zero.alias("grown"))
    steps = F.transform(F.sequence(F.lit(1), F.lit(n_shards + 1)), lambda i: i.cast("long"))
    return F.aggregate(steps, start, step, lambda acc: F.struct(acc.shard.cast("int").alias("shard"), acc.grown.cast("int").alias("grown")))


def _placed(docs: DataFrame, kept: Column, n_shards: int) -> DataFrame:
    """One row per document: row (kept) and FACTS.

    Rows stay in their tasks: each task sorts its own by shard, so that a shard's rows stand together, and writes them; a
    shard's rows before a task (one narrow row each) move the numbers up. Nothing depends on how often a key occurs.
    """
    facts = docs.select(
        kept.alias("row"), (utf8_size(F.col("text")) + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        jump_shards(F.col("doc_id"), n_shards).alias("jump"),
    )
    rows = facts.select("row", "size", "text_crc32", "jump.shard", F.col("jump.grown").alias("grown_shard")).sortWithinPartitions("shard")
    rows = written(rows.withColumn("task", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))
    runs = rows.groupBy("shard", "task").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    runs = written(runs.select("shard", "task", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("up")))
    placed = rows.join(small_side(runs, BROADCAST_RUNS), ["shard", "task"])
    return placed.select("row", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("place") + F.col("up")).alias("slot"), "grown_shard")


def shard_table(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the whole text (null: none) plus 1. Null and empty texts have checksum 0. A null doc_id is a key
    like any other. Rows that share a doc_id, whole repeats too, go to one shard and have a slot each; which of them comes
    first is open. Other columns of docs are ignored; an empty table gives an empty result.
    """
    return _placed(docs, F.struct("doc_id"), n_shards).select("row.doc_id", *FACTS)


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Every row of docs with its columns, then those of shard_table; one whose name docs has already (in any case) has
    shard_ put before it, as often as it takes to be the only one."""
    taken, named = {c.lower() for c in docs.columns}, []
    for c in FACTS:
        name = c
        while name in taken:
            name = f"shard_{name}"
        taken.add(name)
        named.append(F.col(c).alias(name))
    return _placed(docs, F.struct("*"), n_shards).select("row.*", *named)
