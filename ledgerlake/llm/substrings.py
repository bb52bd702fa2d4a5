"""Substring deduplication by content-defined chunking with a gear rolling hash.

A text is cut behind a white-space byte where the gear hash of the bytes before it falls under a bound, and in a stretch
without white space before a character where it falls under a lower one, so cuts depend on nearby content only and find
themselves again after an insertion. Chunks are compared in runs: from every chunk on, and up
to every chunk, as few consecutive ones as hold MIN_BYTES, so that a run repeats only as a whole passage. Equal runs (by
128-bit digest) beyond the first occurrence in the corpus are repeats; overlapping or touching repeats of a document form one span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .common import written

#: One word end in so many is a cut; behind a whole hash window without white space, one character in so many.
CUT_ONE_IN, CUT_CHARACTER_ONE_IN = 5, 15
#: The last bound, where the hash never cuts (constant bytes).
MOST_BYTES = 1024
#: The gear hash looks back over so many bytes (its bit width).
GEAR_BITS = 32
_CHARACTER_BYTES = 4
#: Shorter spans are no repeated passages.
MIN_BYTES = 64

_GEAR = (tx.random64(256, 53) >> np.uint64(32)).astype(np.uint32)
#: A run's row: its place packs first byte, length and whether the same run stands earlier in its text, its chunks pack the
#: number of the first one in the text and their count.
_TYPE = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("digest2", pa.int64()), ("place", pa.int64()), ("chunks", pa.int64())])
_AGAIN, _LENGTH, _COUNT = 2, 1 << 25, 1 << 24
#: Runs hold less than this many bytes, so that their length fits into its place.
_MOST_RUN = _LENGTH // _AGAIN
#: A digest has two halves of 64 bits, each a polynomial in its own step over the chunks' own halves.
_STEPS = [int(x) for x in tx.random64(2, 61)]
_STEPS_BACK = [pow(x, -1, 1 << 64) for x in _STEPS]


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """h[i] = (h[i - 1] << 1) + gear[raw[i]] modulo 2 ** 32, by doubling: 32 bytes decide each value."""
    h = _GEAR[raw]
    width = 1
    while width < GEAR_BITS:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def _own_hash(h: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The hashes without what the first bytes of a text (from each place of own on) take from the text before."""
    at = own[own > 0][:, None] + np.arange(GEAR_BITS - 1)
    lent = h[at[:, :1] - 1] << np.arange(1, GEAR_BITS, dtype=np.uint32)
    inside = at < np.append(own[own > 0][1:], len(h))[:, None]
    h[at[inside]] -= lent[inside]
    return h


def _inner(raw: np.ndarray) -> np.ndarray:
    """Whether a byte continues a UTF-8 character."""
    return (raw & 0xC0) == 0x80


def chunks(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of every chunk, number of chunks of each text)."""
    begin = np.zeros(len(raw), bool)
    if len(raw):
        own = at[:-1][np.diff(at) > 0]
        h, space, inner = _own_hash(gear_hash(raw), own), tx._SPACE[raw], _inner(raw)
        cut = space & (h < np.uint32((1 << 32) // CUT_ONE_IN))
        begin[1:] = cut[:-1]
        bars = space.copy()
        bars[own] = True
        spaces = np.concatenate([np.zeros(1, np.int64), np.cumsum(bars)])
        stretch = np.flatnonzero(spaces[GEAR_BITS:] == spaces[:-GEAR_BITS]) + GEAR_BITS
        stretch = stretch[stretch < len(raw)]
        begin[stretch] |= ~inner[stretch] & ~space[stretch] & (h[stretch - 1] < np.uint32((1 << 32) // CUT_CHARACTER_ONE_IN))
        begin[own] = True
    first = np.flatnonzero(begin)
    length = np.diff(np.append(first, len(raw)))
    if len(length) and length.max() > MOST_BYTES:
        pieces = -(-length // MOST_BYTES)
        first = np.repeat(first, pieces) + MOST_BYTES * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        for _ in range(_CHARACTER_BYTES - 1):
            first = first - inner[first]
    return first, np.diff(np.searchsorted(first, at))


def runs(first: np.ndarray, end: np.ndarray, owner: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(first chunk, last chunk) of the shortest runs of a text's chunks with min_bytes from each chunk on and up to each chunk."""
    n = len(first)
    last = np.searchsorted(end, first + min_bytes)
    ahead = np.flatnonzero(last < n)
    ahead = ahead[owner[last[ahead]] == owner[ahead]]
    begin = np.searchsorted(first, end - min_bytes, "right") - 1
    back = np.flatnonzero(begin >= 0)
    back = back[owner[begin[back]] == owner[back]]
    back = back[last[begin[back]] != back]
    return np.concatenate([ahead, begin[back]]), np.concatenate([last[ahead], back])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _chunked(min_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
            for row, raw, at in tx.slices(batch.column(1)):
                first, number = chunks(raw, at)
                if not len(first):
                    continue
                length = np.diff(np.append(first, len(raw)))
                inner = np.arange(len(raw), dtype=np.int64) - np.repeat(first, length)
                owner = np.repeat(np.arange(len(number)), number)
                a, b = runs(first, first + length, owner, min_bytes)
                if not len(a):
                    continue
                size = first[b] + length[b] - first[a]
                halves = []
                for seed, step, back in zip((59, 67), _STEPS, _STEPS_BACK, strict=True):
                    values = tx.random64(MOST_BYTES + _CHARACTER_BYTES, seed)[inner] * (raw.astype(np.uint64) + np.uint64(1))
                    own = tx.mix64(np.add.reduceat(values, first) + length.astype(np.uint64))
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * _powers(step, len(own)), dtype=np.uint64)])
                    halves.append(tx.mix64((sums[b + 1] - sums[a]) * _powers(back, len(own))[a] + size.astype(np.uint64)))
                digest, of = halves[0], owner[a]
                # the earliest of a text's equal runs is no repeat; runs come in two ascending series
                order = np.argsort(a, kind="stable")
                again = np.ones(len(a), np.int64)
                again[order[np.unique(tx.mix64(digest + of.astype(np.uint64))[order], return_index=True)[1]]] = 0
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[row : row + len(number)][of]), pa.array(digest.view(np.int64)), pa.array(halves[1].view(np.int64)), pa.array((first[a] - at[:-1][of]) * _LENGTH + size * _AGAIN + again),
                    pa.array((a - (np.cumsum(number) - number)[of]) * _COUNT + b + 1 - a),
                ], schema=_TYPE)

    return work


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """One row per repeated span: doc_id, start, n_bytes (UTF-8 bytes of the text), n_chunks, first_doc_id.

    A span is made of runs of chunks that hold at least min_bytes and each stand as a whole elsewhere. The first occurrence
    of a run, by doc_id and place, is no repeat; first_doc_id is the smallest doc_id that holds a run of the span. Null and
    empty texts have no spans; copies of a text of min_bytes are spans over all of it; rows without a doc_id are left out,
    repeated rows count as one. doc_id is the key: different texts of one doc_id share their spans. Texts are cut whole,
    whatever their length. Other columns are ignored; an empty table gives an empty result.
    """
    if not 0 < min_bytes < _MOST_RUN - 2 * MOST_BYTES:
        raise ValueError(f"min_bytes must be positive and below {_MOST_RUN - 2 * MOST_BYTES}")
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = rows.mapInArrow(_chunked(min_bytes), "doc_id long, digest long, digest2 long, place long, chunks long")
    same = Window.partitionBy("digest", "digest2")  # one shuffle of the runs counts them and finds their first
    runs_of = pieces.withColumn("n", F.count("*").over(same)).withColumn("first_doc_id", F.min("doc_id").over(same)).filter("n > 1")
    again = F.col("place") % _AGAIN == 1
    start, chunk = F.floor(F.col("place") / _LENGTH), F.floor(F.col("chunks") / _COUNT)
    repeats = runs_of.filter(again | (F.col("doc_id") != F.col("first_doc_id"))).select(
        "doc_id", start.alias("start"), (start + F.floor(F.col("place") % _LENGTH / _AGAIN)).alias("end"),
        chunk.alias("chunk"), (chunk + F.col("chunks") % _COUNT).alias("chunk_end"), "first_doc_id",
    ).distinct()
    by_doc = Window.partitionBy("doc_id").orderBy("start", "end")
    before = by_doc.rowsBetween(Window.unboundedPreceding, -1)
    marked = repeats.withColumn("_new", F.when(F.max("end").over(before) >= F.col("start"), 0).otherwise(1))
    marked = marked.withColumn("_chunks", F.greatest(F.lit(0), F.col("chunk_end") - F.greatest("chunk", F.coalesce(F.max("chunk_end").over(before), F.lit(0)))))
    marked = marked.withColumn("_span", F.sum("_new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy("doc_id", "_span").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("n_bytes"), F.sum("_chunks").alias("n_chunks"), F.min("first_doc_id").alias("first_doc_id"))
    return spans.drop("_span")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw, kept, at = (text or "").encode(), [], 0
            for s in sorted(spans or [], key=lambda s: s["start"]):
                kept.append(raw[at : s["start"]])
                at = s["start"] + s["n_bytes"]
            out.append(b"".join([*kept, raw[at:]]).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def without_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id and text of every row of docs, the repeated spans cut out of the texts."""
    spans = written(repeated_spans(docs, min_bytes)).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n_bytes")).alias("spans"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(spans, "doc_id", "left").mapInArrow(_cut, "doc_id long, text string")
