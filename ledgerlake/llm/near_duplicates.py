"""MinHash near-duplicates verified with odd sketches.

Equal shingle sets are one class. Classes that agree on a band of MinHash values are candidates; the parity bitmap of all
MinHash samples (an odd sketch, Mitzenmacher, Pagh and Pham) gives the similarity of high pairs closely by the population
count of an exclusive or, and what it lets through is confirmed on the full sets.

A bucket's members are first compared with a few of them, and the links join most of a group. Members of buckets that hold
more than one component then still have to be compared, however crowded the bucket: for them an exact filter takes the
buckets' place. Two sets of the wanted similarity share a shingle among the rarest few of each (the first
(1 - similarity) * size + 1 in one order of all shingles), so only members that share one of those are compared: a crowd of
texts that share a template, but no rare words, meets no more. Links within a component aren't looked for again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import small_side, written
from .components import components

BANDS, ROWS = 32, 6
SAMPLES = BANDS * ROWS
BITS = 512
#: A sketch may be so far below the threshold and still be confirmed on the sets: over four standard errors.
MARGIN = 0.13
WORDS, PERCENT = 3, 85
#: Members of a bucket that all others are compared with first.
CENTRES = 4
#: Up to so many ids (of a bucket of two or more) are broadcast to fetch their texts; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Shingles are counted in so many cells, whose counts order them from rare to frequent (a table of this size a task).
COUNT_BITS = 20
#: A rare shingle's members outside its largest component meet all of them in so many parts for each PART_ROWS of them.
PART_ROWS = 2000

_TYPE = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64()))])


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted shingle set of each row) by slices."""
    for row, raw, at in tx.slices(texts):
        hashes, _, word_at = tx.words(raw, at)
        found, ends = tx.shingles(hashes, word_at, k)
        yield row, [np.unique(found[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES MinHash values of each non-empty set."""
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    keys = tx.random64(2 * SAMPLES, 23)
    factor, shift = (keys[:SAMPLES] >> np.uint64(31)).astype(np.uint32) | np.uint32(1), (keys[SAMPLES:] >> np.uint64(32)).astype(np.uint32)
    out = np.empty((SAMPLES, len(sets)), np.uint32)
    for i in range(SAMPLES):
        out[i] = np.minimum.reduceat(values * factor[i] + shift[i], start)
    return out.T


def bands_and_sketches(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(signature)
    wide = signature.astype(np.uint64)
    keys = tx.random64(ROWS, 31)
    banded = tx.mix64((wide.reshape(n, BANDS, ROWS) * keys).sum(axis=2, dtype=np.uint64) + tx.random64(BANDS, 37))
    bit = tx.mix64(wide + tx.random64(SAMPLES, 41)) % np.uint64(BITS)
    flips = np.bincount((bit.astype(np.int64) + np.arange(n)[:, None] * BITS).ravel(), minlength=n * BITS) & 1
    odd = np.packbits(flips.astype(np.uint8).reshape(n, BITS), axis=1).view(np.int64)
    return banded.view(np.int64), odd


def _features(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, sets in _sets(batch.column(1), k):
                full = [s for s in sets if len(s)]
                banded, odd = bands_and_sketches(signatures(full)) if full else (np.zeros((0, BANDS), np.int64), np.zeros((0, BITS // 64), np.int64))
                place = np.cumsum([0, *(len(s) > 0 for s in sets)])
                has = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(row, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if h else None for s, h in zip(sets, has, strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(place * BANDS, pa.int32()), pa.array(banded.ravel())),
                    pa.ListArray.from_arrays(pa.array(place * (BITS // 64), pa.int32()), pa.array(odd.ravel())),
                ], schema=_TYPE)

    return work


def _full_sets(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, sets in _sets(batch.column(1), k):
                members = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                place = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(sets)), pa.ListArray.from_arrays(place, pa.array(members))], names=["id", "members"])

    return work


def _cells(members: np.ndarray) -> np.ndarray:
    return (tx.mix64(members.view(np.uint64)) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _by_members(batch: pa.RecordBatch, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batch (id, members, ...) in pieces of about that many shingles; a larger set is a piece of its own."""
    ends, row = np.cumsum(batch.column("members").value_lengths().to_numpy()), 0
    while row < len(batch):
        end = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + most, "right")))
        yield batch.slice(row, end - row)
        row = end


def _shingle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << COUNT_BITS, np.int64)
    for batch in (piece for whole in batches for piece in _by_members(whole)):
        total += np.bincount(_cells(batch.column(0).flatten().to_numpy()), minlength=len(total))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["cell", "n"])


def _rarest(counts: np.ndarray, percent: int):
    """The shingles of each set of which a similar set must share one: its rarest, by cell count, then value; with the set's
    size and how many of its shingles come from that one onward."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _by_members(whole)):
            members, size = batch.column(1).flatten().to_numpy(), batch.column(1).value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((members, counts[_cells(members)], owner))
            take = size - (size * percent + 99) // 100 + 1
            place = np.arange(len(members)) - np.repeat(np.cumsum(size) - size, size)
            chosen = place < np.repeat(take, size)
            of = owner[order[chosen]]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(of)), batch.column(2).take(pa.array(of)), pa.array(members[order[chosen]]),
                pa.array(size[of].astype(np.int64)), pa.array((size[of] - place[chosen]).astype(np.int64)),
            ], names=["id", "at", "shingle", "n", "onward"])

    return work


def close_sketches(one: Column, other: Column, percent: int) -> Column:
    """Whether the sketches' similarity is at least the threshold less MARGIN."""
    most = math.floor(BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - percent / 100 + MARGIN) / BITS)))
    differing = sum((F.bit_count(one[i].bitwiseXOR(other[i])) for i in range(1, BITS // 64)), F.bit_count(one[0].bitwiseXOR(other[0])))
    return differing <= most


def _sizes_fit(one: Column, other: Column, percent: int) -> Column:
    return F.least(one, other) * 100 >= F.greatest(one, other) * percent


def _linked(one: Column, other: Column, percent: int) -> Column:
    """Whether two full sets are similar enough."""
    both = F.size(F.array_intersect(one, other))
    return both * 100 >= (F.size(one) + F.size(other) - both) * percent


def near_duplicate_classes(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set is its distinct k-word shingles,
    or its whole sequence where it has fewer words. Documents with 100 * intersection >= percent * union are linked;
    component_id is the smallest doc_id reachable. Null and empty texts are linked with nothing. doc_id is the key: rows
    that share one count as one document. A row without a doc_id links with nothing but equal sets: it gets the component of
    a row with its set, if there is one, or null, and is kept only in the latter case. Texts of any length are read whole.
    Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = written(docs.mapInArrow(tx.freed(_features(k)), "doc_id long, n_shingles long, digest binary, bands array<long>, odd array<long>"))
    classes = written(
        features.filter("digest is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    )
    sketch = lambda name: classes.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("odd").alias(f"odd_{name}"))
    fits = _sizes_fit(F.col("n_a"), F.col("n_b"), percent) & close_sketches(F.col("odd_a"), F.col("odd_b"), percent)

    places = classes.select("id", F.explode("bands").alias("band"))
    crowded = places.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1").select("band")
    shared = written(places.join(crowded, "band"))
    centres = [F.min(F.struct(F.xxhash64(F.lit(j), "id"), "id"))["id"] for j in range(CENTRES)]
    centres = written(shared.groupBy("band").agg(F.array_distinct(F.array(*centres)).alias("centres")))
    ids = written(shared.select(F.col("id").alias("doc_id")).distinct())
    sets = written(docs.join(small_side(ids, BROADCAST_IDS), "doc_id", "left_semi").mapInArrow(tx.freed(_full_sets(k)), "id long, members array<long>"))
    full = lambda name: sets.select(F.col("id").alias(name), F.col("members").alias(f"set_{name}"))

    stars = shared.join(centres, "band").select("id", F.explode("centres").alias("centre")).filter("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    close = written(stars.join(sketch("b"), "b").join(sketch("a"), "a").filter(fits).select("a", "b"))
    links = written(close.join(full("a"), "a").join(full("b"), "b").filter(_linked(F.col("set_a"), F.col("set_b"), percent)).select("a", "b"))
    found = components(links)

    at = shared.join(found, "id", "left").select("band", "id", F.coalesce("component", "id").alias("at"))
    mixed = at.groupBy("band").agg(F.min("at").alias("least"), F.max("at").alias("most")).filter("least <> most").select("band")
    open_ids = written(at.join(mixed, "band").groupBy("id").agg(F.first("at").alias("at")))
    if not open_ids.isEmpty():
        open_sets = sets.join(small_side(open_ids, BROADCAST_IDS), "id")
        counts = open_sets.select("members").mapInArrow(tx.freed(_shingle_counts), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        table = np.zeros(1 << COUNT_BITS, np.int64)
        table[counts["cell"].to_numpy()] = counts["n"].to_numpy()
        rare = written(open_sets.select("id", "members", "at").mapInArrow(tx.freed(_rarest(table, percent)), "id long, at long, shingle long, n long, onward long"))
        by_at = rare.groupBy("shingle", "at").agg(F.count("*").alias("rows"))
        by_shingle = by_at.groupBy("shingle").agg(F.max(F.struct("rows", "at"))["at"].alias("most"), F.sum("rows").alias("rows"), F.count("*").alias("ats"))
        met = written(rare.join(by_shingle.filter("ats > 1").drop("ats"), "shingle").withColumn("parts", F.ceil(F.col("rows") / PART_ROWS).cast("int")))
        side = lambda df, name: df.select("shingle", "part", *(F.col(c).alias(f"{c}_{name}") for c in ("id", "at", "most", "n", "onward")))
        p = side(met.filter("at <> most").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "p")
        q = side(met.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), "q")
        # where the first shared shingle stands, no more than what comes from it onward can be shared
        enough = F.least("onward_p", "onward_q") * (100 + percent) >= (F.col("n_p") + F.col("n_q")) * percent
        apart = (F.col("at_p") != F.col("at_q")) & ((F.col("at_q") == F.col("most_q")) | (F.col("id_p") < F.col("id_q")))
        pairs = p.join(q, ["shingle", "part"]).filter(apart & enough & _sizes_fit(F.col("n_p"), F.col("n_q"), percent))
        pairs = pairs.select(F.least("id_p", "id_q").alias("a"), F.greatest("id_p", "id_q").alias("b")).distinct()
        close = written(pairs.join(sketch("b"), "b").join(sketch("a"), "a").filter(fits).select("a", "b"))
        more = written(close.join(full("a"), "a").join(full("b"), "b").filter(_linked(F.col("set_a"), F.col("set_b"), percent)).select("a", "b"))
        if not more.isEmpty():
            found = components(links.union(more))

    named = classes.join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    return features.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.col("component_id").isNull()).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the documents that a smaller doc_id of their class stands for."""
    dropped = written(near_duplicate_classes(docs).filter("not kept and doc_id is not null").select("doc_id").distinct())
    return docs.join(small_side(dropped, BROADCAST_IDS), "doc_id", "left_anti").select(*docs.columns)
