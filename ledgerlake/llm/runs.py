"""Periodic runs of words by a sparse dynamic program over diagonals.

A diagonal is a lag: its match length at a word is one more than at the word before if the word equals the one that many
words earlier, else none. A diagonal that ends with 3 periods matched is a run of 4 periods or more. Trying every earlier
occurrence of a word costs the square of its count, so a word meets its earlier occurrences in windows of k = 1, 2, 4, ...
words, and only the nearest one counts: inside a run of smallest period q, a window of q to 2q words recurs exactly q words
later and no sooner, so the nearest occurrence names the diagonal, each run is found in one window size, and every diagonal
that lasts 4 periods there is a run. Windows of 2k words start only where both halves recur, so that prose soon has none
left. Time and memory are words times the window sizes that still recur, whatever repeats.

Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import WORD

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Digests and texts leave a task in batches of so many rows.
ROWS = 1024

_NEXT = np.uint64(0x9E3779B97F4A7C15)


def find_runs(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period), ordered by all four, of texts whose word hashes lie at at[t] to at[t + 1]."""
    size = np.diff(at)
    owner = np.repeat(np.arange(len(size)), size)
    i = np.flatnonzero(size[owner] >= LEAST_WORDS)
    key = tx.mix64(words[i] + tx.mix64(owner[i].astype(np.uint64) + np.uint64(1)))
    where, found, k = np.full(len(words) + 1, -1, np.int64), [np.zeros((0, 4), np.int64)], 1
    while len(i):
        order = np.argsort(key, kind="stable")
        again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        later, earlier = order[again + 1], order[again]
        lag = np.zeros(len(i), np.int64)
        lag[later] = i[later] - i[earlier]

        on = np.flatnonzero((lag > k // 2) & (lag <= k))
        goes_on = np.zeros(len(on) + 1, bool)
        goes_on[1:-1] = (i[on[1:]] == i[on[:-1]] + 1) & (lag[on[1:]] == lag[on[:-1]])
        first, last = on[~goes_on[:-1]], on[~goes_on[1:]]
        period, length = lag[first], i[last] - i[first] + k + lag[first]
        start = i[first] - period
        ends = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        text = owner[start[ends]]
        found.append(np.stack([text, start[ends] - at[text], length[ends], period[ends]], axis=1))

        recurs = np.zeros(len(i), bool)
        recurs[later] = recurs[earlier] = True
        where[i] = np.where(recurs, np.arange(len(i)), -1)
        half = np.flatnonzero(recurs & (i + 2 * k <= at[1:][owner[i]]))
        other = where[i[half] + k]
        where[i] = -1
        half, other = half[other >= 0], other[other >= 0]
        i, key, k = i[half], tx.mix64(key[half] * _NEXT + key[other]), 2 * k
    rows = np.concatenate(found)
    return rows[np.lexsort(rows.T[::-1])]


def _dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Whether each of a text's n words lies in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] > 0


def _each(texts: pa.Array) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(words, rows of start, length and period) of every text."""
    for _, raw, at in tx.slices(texts):
        hashes, _, word_at = tx.words(raw, at, lower=False)
        runs = find_runs(hashes, word_at)
        cut = np.searchsorted(runs[:, 0], np.arange(len(at)))
        for t in range(len(at) - 1):
            yield raw[at[t] : at[t + 1]].tobytes().split(), runs[cut[t] : cut[t + 1], 1:]


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    return b" ".join(words if not len(runs) else [w for w, out in zip(words, _dropped(runs, len(words)), strict=True) if not out])


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, (_, runs) in enumerate(_each(batch.column(1))):
            if len(runs):
                ids = batch.column(0).take(pa.array(np.full(len(runs), k)))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(runs[:, c]) for c in range(3))], names=["doc_id", "start", "length", "period"])


_DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(r, ROWS) for r in range(0, len(whole), ROWS)):
            out = []
            for words, runs in _each(batch.column(1)):
                rows = runs.tolist()
                best = max(rows, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(rows, key=lambda r: (r[0], r[2])))
                out.append((len(rows), *best, 1000 * best[1] // best[2] if rows else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(_collapsed(words, runs)).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[c.split()[0] for c in _DIGESTS.split(", ")])


def _ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per run of a document's words: doc_id, start (word number from 0), length and period in words.

    Words are runs of anything but ASCII white space, compared as they are. Null, empty and short texts have no runs;
    repeated rows give their runs each, null ids too; a text of any length is one task's, at some 60 bytes a word. Other
    columns are ignored; an empty table gives an empty result.
    """
    return _ids_and_texts(docs).mapInArrow(tx.freed(_run_rows), "doc_id long, start long, length long, period long")


def without_periodic_runs(docs: DataFrame) -> DataFrame:
    """docs, of every run only its first period kept: words joined by one space. Texts without a run, null too, stay as they are."""
    place = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(place)
            new = [_collapsed(words, runs).decode() if len(runs) else old[k].as_py() for k, (words, runs) in enumerate(_each(old))]
            yield batch.set_column(place, batch.schema.field(place), pa.array(new, old.type))

    return docs.mapInArrow(tx.freed(work), docs.schema)


def run_digests(docs: DataFrame) -> DataFrame:
    """One row per document: its number of runs, the run of greatest length / period (ties: smallest start, then period; null
    without a run), and digests of all runs and of the collapsed text. Edge cases as in periodic_runs, a row for each row."""
    return _ids_and_texts(docs).mapInArrow(tx.freed(_digest_rows), _DIGESTS)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the checksum of one doc_id in ten makes a stretch of its text repeat from some word on.

    With h the checksum, g = h / 10 and n words, the words from a = g % n on repeat the next p = 1 + (n - a) / (3 + g % 8).
    Texts without words, null texts and null ids stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.when((h % 10 == 0) & F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    parts = _ids_and_texts(docs).withColumn("words", words).withColumn("n", F.size("words")).withColumn("g", F.floor(h / 10))
    parts = parts.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    parts = parts.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int")))
    said = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), left)), " ")
    return parts.select("doc_id", F.when(F.col("a").isNotNull(), said).otherwise(F.col("text")).alias("text"))
