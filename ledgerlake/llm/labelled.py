"""Labelled samples for the classifiers: folds by checksum of doc_id, and a bounded training sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))

#: Longer texts (UTF-8 bytes) aren't learned from, so that a sample's size is bounded in bytes too; they are scored like all others.
MOST_BYTES = 1 << 16


def training_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, per_class: int) -> DataFrame:
    """doc_id, text and y of up to per_class documents of either label, those of the lowest hash, outside the held-out fold.

    Ties of the hash go by doc_id; a doc_id with both labels counts as 1. Where docs repeats a doc_id, its least text is learned.
    """
    known = labels.filter(F.col(label).isin(0, 1) & (fold(F.col("doc_id"), parts) != held_out)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64(F.lit(label), "doc_id")
    chosen = [known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * per_class rows of two numbers
    return docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= MOST_BYTES).join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
