"""Quality: a linear-chain conditional random field labels every line of a text good or bad.

Each line is described by its own figures and those of the lines before and after it; the field's weights and its
transitions are fitted by gradient ascent on the lines of labelled documents (a line takes its document's label). A text's
quality is the mean of its lines' forward-backward marginals, weighted by line length, mapped to a probability by a
one-variable logistic fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .labelled import fold, training_sample

PER_CLASS = 2000
PARTS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: The fit sees so many lines of a label at most: documents are taken in the order of their hash as long as their lines fit.
LINES_PER_CLASS = 100_000
ROUNDS, RATE, DECAY = 60, 0.25, 1e-3


def _byte_class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars)] = 1
    return table


#: Byte classes whose shares of a line are features.
_CLASSES = np.stack([
    _byte_class(bytes(range(65, 91))), _byte_class(bytes(range(97, 123)) + bytes(range(128, 256))), _byte_class(b"0123456789"),
    _byte_class(b".,;:'\"-?()"), _byte_class(b"#$%&*+/<=>@[\\]^_`{}~"), _byte_class(b"|"), _byte_class(b"!"), _byte_class(b" \t\r\v\f"),
])
OWN = len(_CLASSES) + 7


def _figures(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, line lengths, offsets of each text's lines); an empty text has no line."""
    begin = np.zeros(len(raw), bool)
    if len(raw):
        begin[1:] = raw[:-1] == 10
        begin[at[:-1][np.diff(at) > 0]] = True
    first = np.flatnonzero(begin)
    line_at = np.searchsorted(first, at)
    if not len(first):
        return np.zeros((0, 3 * OWN + 1)), np.zeros(0), line_at
    size = np.diff(np.append(first, len(raw))).astype(float)
    share = np.stack([np.add.reduceat(c[raw], first, dtype=np.int64) for c in _CLASSES], 1) / size[:, None]

    hashes, places, _ = tx.words(raw, at)
    line = np.searchsorted(first, places, "right") - 1
    n_words = np.bincount(line, minlength=len(first)).astype(float)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(line_at))
    line_key = np.zeros(len(first), np.uint64)
    np.add.at(line_key, line, hashes)
    def distinct(owner, n):
        key = np.unique((owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        return np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=n)
    in_line = distinct(line, len(first)) / np.maximum(n_words, 1)
    of_doc = (distinct(doc[line], len(at) - 1) / np.maximum(np.bincount(doc[line], minlength=len(at) - 1), 1))[doc]
    _, back, times = np.unique(np.stack([doc.astype(np.uint64), line_key]), axis=1, return_inverse=True, return_counts=True)
    ends = raw[np.maximum(np.append(first[1:], len(raw)) - 2, 0)]
    own = np.column_stack([
        share, np.log1p(size) / 8, np.log1p(n_words) / 6, np.minimum(size / np.maximum(n_words, 1), 30) / 10,
        in_line, of_doc, np.log(times[back.ravel()]) / 3, np.isin(ends, list(b".!?:;")),
    ])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[line_at[:-1][np.diff(line_at) > 0]] = 0
    after[line_at[1:][np.diff(line_at) > 0] - 1] = 0
    return np.column_stack([own, before, after, np.ones(len(own))]), size, line_at


@dataclass
class QualityModel:
    weights: np.ndarray
    moves: np.ndarray  # log weight of label i followed by label j
    slope: float = 1.0
    shift: float = 0.0
    centre: np.ndarray | float = 0.0
    scale: np.ndarray | float = 1.0

    def marginals(self, x: np.ndarray, line_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability that each line is good, pairwise marginals with the line after it), all texts side by side."""
        unit = np.zeros((len(x), 2))
        unit[:, 1] = ((x - self.centre) / self.scale) @ self.weights
        return _forward_backward(unit, self.moves, line_at)


def _forward_backward(unit: np.ndarray, moves: np.ndarray, line_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(line_at)
    order = np.argsort(-count, kind="stable")
    start, count = line_at[:-1][order], count[order]
    ahead, back = unit.copy(), np.zeros_like(unit)
    steps = int(count[0]) if len(count) else 0
    live = np.searchsorted(-count, -np.arange(1, steps + 1), "right")  # texts with more than t lines
    for t in range(1, steps):
        i = start[: live[t]] + t
        prior = ahead[i - 1]
        prior = prior - prior.max(1, keepdims=True)
        ahead[i] += np.logaddexp(prior[:, :1] + moves[0], prior[:, 1:] + moves[1])
    for t in range(steps - 2, -1, -1):
        i = start[: live[t + 1]] + t
        nxt = back[i + 1] + unit[i + 1]
        nxt = nxt - nxt.max(1, keepdims=True)
        back[i] = np.logaddexp(nxt[:, :1] + moves[:, 0], nxt[:, 1:] + moves[:, 1])
    both = ahead + back
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))
    follows = np.ones(len(unit), bool)
    follows[line_at[1:][np.diff(line_at) > 0] - 1] = False
    i = np.flatnonzero(follows)
    pair = ahead[i][:, :, None] + moves + (unit[i + 1] + back[i + 1])[:, None, :]
    pair = np.exp(pair - pair.max((1, 2), keepdims=True))
    return good, pair / pair.sum((1, 2), keepdims=True)


def fit(x: np.ndarray, size: np.ndarray, line_at: np.ndarray, y: np.ndarray) -> QualityModel:
    """y: the label of each text. Texts weigh alike, however many lines they have."""
    count = np.diff(line_at)
    model = QualityModel(np.zeros(x.shape[1]), np.zeros((2, 2)))
    if not len(y) or y.min() == y.max() or not len(x):
        model.weights[-1], model.slope = 0.0, 0.0
        model.shift = 20.0 * (2 * float(y.mean()) - 1) if len(y) else 0.0
        return model
    owner = np.repeat(np.arange(len(y)), count)
    share = 1 / np.maximum(count, 1)[owner] / len(y)
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-6
    model.centre[-1], model.scale[-1] = 0, 1
    z, label = (x - model.centre) / model.scale, y[owner]
    inner = np.ones(len(x), bool)
    inner[line_at[1:][count > 0] - 1] = False
    weight = share[inner]
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = weight[label[inner] == k].sum()
    grown_w, grown_m = np.full(len(model.weights), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(ROUNDS):
        good, pair = model.marginals(x, line_at)
        g = z.T @ ((label - good) * share) - DECAY * model.weights
        gm = seen - (pair * weight[:, None, None]).sum(0) - DECAY * model.moves
        grown_w, grown_m = grown_w + g * g, grown_m + gm * gm
        model.weights = model.weights + RATE * g / np.sqrt(grown_w)
        model.moves = model.moves + RATE * gm / np.sqrt(grown_m)
    quality = model_quality(model, x, size, line_at)
    a, b, ga, gb = 0.0, 0.0, 1e-8, 1e-8
    for _ in range(400):
        error = (1 / (1 + np.exp(-(a * quality + b))) - y) / len(y)
        da, db = (error * quality).sum(), error.sum()
        ga, gb = ga + da * da, gb + db * db
        a, b = a - da / np.sqrt(ga), b - db / np.sqrt(gb)
    model.slope, model.shift = float(a), float(b)
    return model


def model_quality(model: QualityModel, x: np.ndarray, size: np.ndarray, line_at: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal of each text, less one half; 0 for a text without lines."""
    good, _ = model.marginals(x, line_at) if len(x) else (np.zeros(0), None)
    owner = np.repeat(np.arange(len(line_at) - 1), np.diff(line_at))
    total = np.bincount(owner, size, len(line_at) - 1)
    return np.where(total > 0, np.bincount(owner, good * size, len(line_at) - 1) / np.maximum(total, 1) - 0.5, 0.0)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, raw, at in tx.slices(batch.column(0)):
            x, size, line_at = _figures(raw, at)
            cut = line_at[1:-1]
            yield pa.RecordBatch.from_arrays([
                batch.column(1).slice(row, len(at) - 1),
                pa.array([np.ascontiguousarray(p, np.float32).tobytes() for p in np.split(x, cut)], pa.binary()),
                pa.array([p.astype(np.float32).tobytes() for p in np.split(size, cut)], pa.binary()),
            ], names=["y", "x", "size"])


def _scores(model: QualityModel):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw, at in tx.slices(batch.column(1)):
                quality = model_quality(model, *_figures(raw, at))
                score = 1 / (1 + np.exp(-np.clip(model.slope * quality + model.shift, -50, 50)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(score)), pa.array(score)], names=["doc_id", "score"])

    return work


def _few_lines(sample: DataFrame, most: int) -> DataFrame:
    """The sample (doc_id, text, y; at most PER_CLASS rows a label) without what exceeds so many lines of a label."""
    lines = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")) + 1
    before = F.sum(lines).over(Window.partitionBy("y").orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id"))
    return sample.withColumn("_lines", before).filter(F.col("_lines") <= most).drop("_lines")


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, lines: int = LINES_PER_CLASS) -> QualityModel:
    sample = _few_lines(training_sample(docs, labels, "quality", PARTS, HELD_OUT, per_class), lines)
    rows = sample.select("text", "y").mapInArrow(_described, "y int, x binary, size binary").toArrow()
    size = [np.frombuffer(s, np.float32) for s in rows["size"].to_pylist()]
    x = [np.frombuffer(v, np.float32).reshape(len(s), -1) for v, s in zip(rows["x"].to_pylist(), size, strict=True) if len(s)]
    line_at = np.concatenate([[0], np.cumsum([len(s) for s in size])]).astype(np.int64)
    return fit(np.concatenate(x).astype(float) if x else np.zeros((0, 3 * OWN + 1)), np.concatenate([*size, np.zeros(0)]), line_at, np.array(rows["y"].to_pylist(), float))


def quality_scores(docs: DataFrame, labels: DataFrame, model: QualityModel | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= THRESHOLD).

    Labels are learned outside the held-out fold (checksum of doc_id modulo PARTS) from at most PER_CLASS documents of
    MOST_BYTES (labelled.py) and LINES_PER_CLASS lines a label, 184 bytes each on the driver; a line takes its document's label, none has its own. Null and empty texts have no line
    and get the score of undecided lines. Labels other than 0 and 1 are ignored; without training rows of both labels the
    score is constant. Rows are scored one by one, repeats alike, so there are no ties; a very long text is scored whole, in
    about 1 KB of a task's memory a line. Other columns are ignored; an empty table gives an empty result.
    """
    model = model or train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(_scores(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), PARTS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
