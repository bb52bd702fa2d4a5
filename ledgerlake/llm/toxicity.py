"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The features of a text are the hashed n-grams it holds (presence, not counts), each scaled by the log ratio of its
smoothed frequencies in toxic and other training texts; a logistic regression is fitted on them (Wang and Manning's
NBSVM with a logistic loss). The training sample is bounded by PER_CLASS texts a class of MOST_BYTES (labelled.py) each;
its n-grams are counted and chosen on Spark, and the driver gets what the chosen ones leave of it. Every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import written
from .labelled import fold, training_sample

PER_CLASS = 2000
PARTS, HELD_OUT = 4, 2
THRESHOLD = 0.3
ORDERS = (4, 5, 6)
BUCKET_BITS = 22
#: n-grams of fewer training texts, or of a log-count ratio of fewer standard errors, carry no weight.
LEAST_TEXTS, LEAST_ERRORS = 3, 3.0
ROUNDS, RATE, DECAY = 150, 0.1, 0.1
#: Texts are worked on in slices of so many bytes.
SLICE = 1 << 18

_KEYS = {n: (tx.random64(n, 61 + n) >> np.uint64(32)).astype(np.uint32) | np.uint32(1) for n in ORDERS}


@dataclass
class ToxicityModel:
    buckets: np.ndarray  # those of the chosen n-grams
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        """The weight of every bucket."""
        out = np.zeros(1 << BUCKET_BITS, np.float32)
        out[self.buckets] = self.weights
        return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every character n-gram of the lower-cased texts, white space as one blank."""
    joined = [f" {' '.join(t.lower().split())} " for t in texts]
    size = np.array([len(t) for t in joined])
    points = np.frombuffer("".join(joined).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), size)
    buckets, owners = [], []
    for n in ORDERS:
        if len(points) < n:
            continue
        h = np.zeros(len(points) - n + 1, np.uint32)
        for j in range(n):
            h += points[j : j + len(h)] * _KEYS[n][j]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        inside = owner[: len(h)] == owner[n - 1 :]
        buckets.append((h >> np.uint32(32 - BUCKET_BITS))[inside])
        owners.append(owner[: len(h)][inside])
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def _pieces(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in order, by slices; null texts are empty."""
    for row, _, at in tx.slices(texts, SLICE):
        yield [t or "" for t in texts.slice(row, len(at) - 1).to_pylist()]


def _held(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct buckets of each text."""
    for part in _pieces(texts):
        bucket, owner = _grams(part)
        key = np.unique(owner << BUCKET_BITS | bucket)
        for x in np.split(key, np.searchsorted(key, np.arange(1, len(part)) << BUCKET_BITS)):
            yield x & ((1 << BUCKET_BITS) - 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of texts (text, y) of either label that hold a bucket, for those of LEAST_TEXTS; the bounded sample is one task's."""
    seen = np.zeros((2, 1 << BUCKET_BITS), np.int32)
    for batch in batches:
        for y, held in zip(batch.column(1).to_pylist(), _held(batch.column(0)), strict=True):
            seen[y, held] += 1
    used = np.flatnonzero(seen[0] + seen[1] >= LEAST_TEXTS)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(seen[0, used]), pa.array(seen[1, used])], names=["bucket", "other", "toxic"])


def log_count_ratios(sample: DataFrame, n_other: int, n_toxic: int) -> DataFrame:
    """bucket and ratio of the n-grams of enough texts and a ratio of enough standard errors (sample: text, y)."""
    other, toxic = F.col("other") + 1, F.col("toxic") + 1
    counts = sample.coalesce(1).mapInArrow(tx.freed(_counted), "bucket int, other int, toxic int")
    ratio = F.log(toxic / F.lit(n_toxic + 2.0)) - F.log(other / F.lit(n_other + 2.0))
    strong = F.abs("ratio") >= LEAST_ERRORS * F.sqrt(1 / other + 1 / toxic)
    return counts.withColumn("ratio", ratio).filter(strong).select("bucket", "ratio")


def fit(kept: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """(weight of each chosen n-gram with its scale, bias) by adaptive gradient descent on the logistic loss; kept: the numbers
    of the chosen n-grams that each training text holds."""
    index, owner = np.concatenate([np.zeros(0, np.int64), *kept]), np.repeat(np.arange(len(y)), [len(p) for p in kept])
    scale = ratio / 4
    w, bias, seen_w, seen_b = np.zeros(len(ratio)), float(np.log(y.sum() / (1 - y).sum())), np.full(len(ratio), 1e-8), 1e-8
    x = scale[index]
    for _ in range(ROUNDS):
        margin = np.bincount(owner, x * w[index], len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y) / len(y)
        g, gb = np.bincount(index, x * error[owner], len(ratio)) + DECAY * w / len(y), error.sum()
        seen_w, seen_b = seen_w + g * g, seen_b + gb * gb
        w, bias = w - RATE * g / np.sqrt(seen_w), bias - RATE * gb / np.sqrt(seen_b)
    return w * scale, float(bias)


def _score(model: ToxicityModel, text: Column) -> Column:
    """The score of each text; rows stay where they are, only texts go to Python and only numbers come back."""

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = model.table()
        for texts in batches:
            out = []
            for part in _pieces(texts):
                bucket, owner = _grams(part)
                hit = weights[bucket] != 0
                key = np.unique(owner[hit] << BUCKET_BITS | bucket[hit])
                total = np.bincount(key >> BUCKET_BITS, weights[key & ((1 << BUCKET_BITS) - 1)], len(part))
                out.append(1 / (1 + np.exp(-np.clip(total + model.bias, -50, 50))))
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
        tx.give_back()

    return scores(text)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    sample = written(training_sample(docs, labels, "toxic", PARTS, HELD_OUT, per_class).select("text", "y"))
    n_toxic, n = (v or 0 for v in sample.agg(F.sum("y"), F.count("*")).first())
    if n_toxic in (0, n):
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0, np.float32), 20.0 if n_toxic else -20.0)
    chosen = log_count_ratios(sample, n - n_toxic, n_toxic).toArrow()
    bucket, ratio = chosen["bucket"].to_numpy(), chosen["ratio"].to_numpy()
    order = np.argsort(bucket)
    bucket, ratio = bucket[order], ratio[order]

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(1 << BUCKET_BITS, -1, np.int32)
        number[bucket] = np.arange(len(bucket))
        for batch in batches:
            held = [number[h] for h in _held(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([h[h >= 0].tobytes() for h in held], pa.binary())], names=["y", "kept"])

    rows = sample.mapInArrow(tx.freed(numbers), "y int, kept binary").toArrow()
    kept = [np.frombuffer(k.as_buffer(), np.int32) for chunk in rows["kept"].chunks for k in chunk]
    w, bias = fit(kept, np.array(rows["y"].to_pylist(), float), ratio)
    return ToxicityModel(bucket, w.astype(np.float32), bias)


def toxicity_scores(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= THRESHOLD).

    Labels are learned outside the held-out fold (checksum of doc_id modulo PARTS). Null and empty texts get the score
    of a text without any known n-gram. Labels other than 0 and 1 are ignored; without training rows of both labels the
    score is constant. Rows are scored one by one, repeats alike, so there are no ties; a very long text is scored whole, in
    some tens of bytes of a task's memory a character. Other columns are ignored; an empty table gives an empty result.
    """
    model = model or train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.select("doc_id", _score(model, F.col("text")).alias("score"))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), PARTS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """docs without the rows whose text the classifier rejects; every row passes through once, nothing is shuffled."""
    return docs.filter(_score(model or train(docs, labels), F.col("text")) < THRESHOLD)
