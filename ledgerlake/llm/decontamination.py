"""Benchmark decontamination by latent semantic retrieval.

Passages and benchmark items are TF-IDF vectors over the items' vocabulary (document frequencies over all documents). A
distributed randomised SVD of the passages gives the latent space; passages near an item by cosine are candidates. Their
texts are read again, and a candidate counts as a leak if a longest common subsequence covers enough of the item's words
and of its answer, the item's last part: all words take part, frequent ones too.

Retrieval looks at the rarer terms only. Passages are windows of twice an item's length class, half overlapping, so that any
item lies wholly in one. An item that shares LCS_SHARE of its words with a passage keeps all its terms but as many as the
other words; so an index from terms to items finds the pairs that may, and cosines are taken of those alone.

The SVD has two stages over the passages A (by terms) and a random W of signs: the range A W is made orthonormal by the
Cholesky factor R of its Gram matrix, and with Q = A W / R the small matrix Q'A gives singular values and the terms'
directions by its own Gram matrix. Both Gram matrices have RANK + OVERSAMPLE rows and are summed over the tasks; the rows of
A'A W, one for each term, are summed by term in a shuffle. The signs follow from a term's number, so no task holds W.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import WORD, small_side, written

#: Retrieval leaves out terms of more than this share of documents (and more than FEW_DOCS), but for an item's LEAST_TERMS rarest.
MOST_SHARE, FEW_DOCS, LEAST_TERMS = 0.02, 50, 8
#: A candidate passage holds at least this share of an item's terms, and two of them.
TERM_SHARE = 0.25
RANK, OVERSAMPLE = 128, 32
#: Passage length for the SVD, and the shortest length class of items, in words.
SVD_WORDS, SHORTEST = 64, 16
COSINE, LCS_SHARE = 0.3, 0.6
#: The last so much of an item is its answer, of which so much must be in the common subsequence.
ANSWER_PART, ANSWER_SHARE = 0.25, 0.5
#: The items' side is broadcast: more distinct text or terms than these are an error (give the benchmark in parts then).
MOST_BYTES, MOST_TERMS = 64 << 20, 250_000
#: A table of the common subsequence has at most so many cells.
MOST_CELLS = 1 << 20
#: Sums of so many terms are held in a task before they are passed on.
HELD_TERMS = 50_000
#: Up to so many ids of leaking documents are broadcast to take them out; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Candidates of up to so many documents are broadcast to the texts; more are joined by shuffle.
BROADCAST_FOUND = 100_000


@dataclass
class Items:
    """The benchmark's distinct texts and the sorted hashes of the terms that are kept."""

    words: list[np.ndarray]  # hashes of all words, in order
    terms: np.ndarray
    idf: np.ndarray

    def sequences(self) -> list[np.ndarray]:
        at = [np.searchsorted(self.terms, w) for w in self.words]
        return [i[(i < len(self.terms)) & (self.terms[np.minimum(i, len(self.terms) - 1)] == w)] if len(self.terms) else i[:0] for i, w in zip(at, self.words, strict=True)]


def _counts(vocabulary: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for _, raw, at in tx.slices(batch.column(0)):
                owner, term, _ = _terms_of(raw, at, vocabulary)
                n += len(at) - 1
                total += np.bincount((np.unique(owner * len(vocabulary) + term) % max(1, len(vocabulary))).astype(np.int64), minlength=len(vocabulary))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))], names=["term", "n"])

    return work


def _terms_of(raw: np.ndarray, at: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, word number in the text) of every word that is a term."""
    hashes, _, word_at = tx.words(raw, at)
    low = (hashes & np.uint64(0xFFFF)).astype(np.int64)
    some = np.zeros(1 << 16, bool)
    some[(terms & np.uint64(0xFFFF)).astype(np.int64)] = True
    i = np.flatnonzero(some[low])
    place = np.minimum(np.searchsorted(terms, hashes[i]), max(0, len(terms) - 1))
    hit = terms[place] == hashes[i] if len(terms) else np.zeros(len(i), bool)
    i, place = i[hit], place[hit]
    owner = np.searchsorted(word_at, i, "right") - 1
    return owner, place, i - word_at[owner]


def _term_rows(terms: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw, at in tx.slices(batch.column(1)):
                owner, term, place = _terms_of(raw, at, terms)
                cut = pa.array(np.searchsorted(owner, np.arange(len(at))), pa.int32())
                out = pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, len(at) - 1),
                    pa.ListArray.from_arrays(cut, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(place.astype(np.int32))),
                ], names=["doc_id", "terms", "places"])
                yield out.filter(pa.array(np.diff(np.asarray(cut)) > 0))

    return work


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, place) of a batch of term rows."""
    count = batch.column(1).value_lengths().to_numpy()
    return np.repeat(np.arange(len(batch)), count), batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy().astype(np.int64)


def _small(batch: pa.RecordBatch, most: int = 25_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about that many terms."""
    ends = np.cumsum(batch.column(1).value_lengths().to_numpy())
    row = 0
    while row < len(batch):
        base = ends[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(row, end - row)
        row = end


def _units(row: np.ndarray, place: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first term of every stretch of words that holds a term, whether the next stretch follows it directly)."""
    number = place // words
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(new)
    joined = np.zeros(len(first), bool)
    joined[:-1] = (row[first[1:]] == row[first[:-1]]) & (number[first[1:]] == number[first[:-1]] + 1)
    return first, joined


def _projected(batch: pa.RecordBatch, idf: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, passage and weight of every term of the batch, the passages' rows of A W)."""
    row, term, place = _flat(batch)
    first, _ = _units(row, place, SVD_WORDS)
    passage = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(term))))
    weight = idf[term].astype(np.float32)
    weight = weight / np.sqrt(np.bincount(passage, weight**2))[passage].astype(np.float32)
    own, number = np.unique(term, return_inverse=True)
    return term, passage, weight, np.add.reduceat(_signs(own, width)[number] * weight[:, None], first)


def _signs(terms: np.ndarray, width: int) -> np.ndarray:
    """The terms' rows of W: width random signs each."""
    words = np.arange((width + 63) // 64, dtype=np.uint64)
    bits = tx.mix64(terms.astype(np.uint64)[:, None] * np.uint64(len(words)) + words + np.uint64(5))
    return np.unpackbits(bits.view(np.uint8), axis=1)[:, :width].astype(np.float32) * 2 - 1


def _rows(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    cut = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.ListArray.from_arrays(cut, pa.array(values.ravel()))], names=["i", "parts"])


def _range_gram(idf: np.ndarray, width: int):
    """Each task's share of (A W)'(A W)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for whole in batches:
            for batch in _small(whole):
                y = _projected(batch, idf, width)[3].astype(float)
                total += y.T @ y
        yield _rows(np.arange(width), total)

    return work


def _merged(terms: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate(terms)
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
    return key[order][start], np.add.reduceat(np.concatenate(sums)[order], start)


def _range_by_term(idf: np.ndarray, width: int):
    """Shares of the rows of A'(A W); a task holds about twice HELD_TERMS of them at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, sums = [], []
        for whole in batches:
            for batch in _small(whole):
                term, passage, weight, y = _projected(batch, idf, width)
                order = np.argsort(term, kind="stable")
                start = np.flatnonzero(np.append(True, np.diff(term[order]) != 0))
                total = np.zeros((len(start), width))
                for k, (a, b) in enumerate(zip(start, np.append(start[1:], len(order)), strict=True)):
                    total[k] = weight[order[a:b]] @ y[passage[order[a:b]]]
                terms.append(term[order][start])
                sums.append(total)
                if sum(map(len, terms)) > HELD_TERMS:
                    one = _merged(terms, sums)
                    terms, sums = ([], []) if len(one[0]) > HELD_TERMS // 2 else ([one[0]], [one[1]])
                    if not terms:
                        yield _rows(*one)
        if terms:
            yield _rows(*_merged(terms, sums))

    return work


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if len(batch):
            x = batch.column(1).flatten().to_numpy().reshape(len(batch), -1)
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield _rows(np.arange(len(total)), total)


def _summed(rows: DataFrame, width: int) -> DataFrame:
    return rows.groupBy("i").agg(F.array(*(F.sum(F.col("parts")[j]) for j in range(width))).alias("parts"))


def _matrix(rows: DataFrame, n: int, width: int, kind=np.float64) -> np.ndarray:
    out = np.zeros((n, width), kind)
    for batch in rows.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).flatten().to_numpy().reshape(len(batch), -1)
    return out


_SHARES = "i int, parts array<double>"


def latent_basis(term_rows: DataFrame, idf: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors of the passages by terms, one row a term; singular values), by randomised SVD."""
    width = min(rank + OVERSAMPLE, len(idf))
    gram = _matrix(_summed(term_rows.mapInArrow(tx.freed(_range_gram(idf, width)), _SHARES), width), width, width)
    value, vector = np.linalg.eigh(gram)
    sound = value > 1e-9 * value.max(initial=1e-300)  # a range of lower rank than width has a singular Gram matrix
    whiten = vector[:, sound] / np.sqrt(value[sound])  # A W whiten is orthonormal
    by_term = written(_summed(term_rows.mapInArrow(tx.freed(_range_by_term(idf, width)), _SHARES), width))
    inner = whiten.T @ _matrix(_summed(by_term.mapInArrow(_gram, _SHARES), width), width, width) @ whiten
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-value)[:rank]
    order = order[value[order] > 1e-9 * value.max(initial=1e-300)]
    singular = np.sqrt(value[order])
    turn = whiten @ vector[:, order] / singular

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield _rows(batch.column(0).to_numpy(), (batch.column(1).flatten().to_numpy().reshape(len(batch), -1) @ turn).astype(np.float32))

    return _matrix(by_term.mapInArrow(turned, "i int, parts array<float>"), len(idf), len(order), np.float32), singular


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of x with every beginning of y."""
    out = np.zeros(len(y) + 1, np.int64)
    for v in x:
        out[1:] = np.maximum.accumulate(np.maximum(out[1:], np.where(y == v, out[:-1] + 1, 0)))
    return out


def common(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places in x of a longest common subsequence with y; long ones are halved (Hirschberg), so memory stays bounded."""
    if len(x) * len(y) > MOST_CELLS and len(x) > 1:
        half = len(x) // 2
        at = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        return common(x[:half], y[:at]) + [half + i for i in common(x[half:], y[at:])]
    if len(x) == 1:
        return [0] if (y == x[0]).any() else []
    best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    same = x[:, None] == y[None, :]
    for i in range(len(x) - 1, -1, -1):
        diagonal = np.where(same[i], best[i + 1, 1:] + 1, 0)
        best[i, :-1] = np.maximum.accumulate(np.maximum(best[i + 1, :-1], diagonal)[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if same[i, j] and best[i, j] == best[i + 1, j + 1] + 1:
            out.append(i)
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def check(item: np.ndarray, passage: np.ndarray) -> tuple[float, float]:
    """(share of the item's terms in the longest common subsequence, share of its answer's terms there)."""
    found = common(item, passage)
    answer = len(item) - max(1, round(len(item) * ANSWER_PART))
    return len(found) / len(item), sum(p >= answer for p in found) / (len(item) - answer)


def _candidates(known: Items, basis: np.ndarray):
    """(doc_id, item, at, cosine) of passages near an item: at is the number of the passage's first word.

    basis: the terms' idf-weighted places in the latent space.
    """
    sequences, lengths = known.sequences(), np.array([len(w) for w in known.words])
    own = [np.unique(s) for s in sequences]
    kept = np.array([len(t) for t in own])
    need = np.maximum.reduce([np.minimum(2, kept), np.ceil(TERM_SHARE * kept).astype(int), kept - np.floor((1 - LCS_SHARE) * lengths).astype(int)])
    unit = np.stack([basis[s].sum(0) for s in sequences])
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    classes: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of each length class, the items of every term
    for words in sorted({_class(n) for n in lengths}):
        some = [k for k in range(len(own)) if kept[k] and _class(lengths[k]) == words]
        term, item = np.concatenate([np.zeros(0, np.int64), *(own[k] for k in some)]), np.repeat(np.array(some, np.int64), kept[some])
        order = np.argsort(term, kind="stable")
        classes[words] = np.searchsorted(term[order], np.arange(len(basis) + 1)), item[order]

    def near(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, ...]:
        at, items = classes[words]
        row, term, place = _flat(batch)
        first, joined = _units(row, place, words)
        count = np.diff(np.append(first, len(term)))
        passage = np.repeat(np.arange(len(first)), count)
        also = joined[passage - 1] & (passage > 0)  # a unit's terms belong to the passage that begins a unit earlier too
        held = np.unique(np.concatenate([passage, passage[also] - 1]) * len(basis) + np.concatenate([term, term[also]]))
        passage, held = held // len(basis), held % len(basis)
        n = at[held + 1] - at[held]
        item = items[np.repeat(at[held] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        pair, shared = np.unique(np.repeat(passage, n) * len(own) + item, return_counts=True)
        enough = shared >= need[pair % len(own)]
        passage, item = pair[enough] // len(own), pair[enough] % len(own)
        which, back = np.unique(passage, return_inverse=True)
        until = np.append(first[1:], len(term))
        until[:-1][joined[:-1]] = until[1:][joined[:-1]]
        sums = np.stack([basis[term[first[p] : until[p]]].sum(0) for p in which]) if len(which) else np.zeros((0, basis.shape[1]))
        sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        cosine = np.einsum("ij,ij->i", sums[back], unit[item])
        hit = cosine >= COSINE
        return row[first[passage[hit]]], item[hit], place[first[passage[hit]]] // words * words, cosine[hit]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _small(whole):
                for words in classes if len(batch) else ():
                    row, item, at, cosine = near(batch, words)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(item), pa.array(at), pa.array(cosine.astype(float))], names=["doc_id", "item", "at", "cosine"])

    return work


def _class(n: int) -> int:
    return max(SHORTEST, 1 << (max(1, int(n)) - 1).bit_length())


def best_window(item: np.ndarray, passage: np.ndarray) -> tuple[float, float]:
    """check() of the best stretch of the passage of twice the item's length, from any multiple of that length on."""
    n, need, best = len(item), np.ceil(LCS_SHARE * len(item)), (0.0, 0.0)
    held = np.append(0, np.cumsum(np.isin(passage, item)))
    for start in range(0, max(1, len(passage) - n), n):
        end = min(start + 2 * n, len(passage))
        if held[end] - held[start] >= need and np.isin(item, passage[start:end]).sum() >= need:
            best = max(best, check(item, passage[start:end]))
    return best


def _verified(words: list[np.ndarray]):
    """Leaks among the candidates (doc_id, text, found: item, at, cosine) by all words of passage and item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, raw, at in tx.slices(batch.column(1)):
                hashes, _, word_at = tx.words(raw, at)
                for t in range(len(at) - 1):
                    text, doc = hashes[word_at[t] : word_at[t + 1]], batch.column(0)[row + t].as_py()
                    for c in batch.column(2)[row + t].as_py():
                        item, size = words[c["item"]], _class(len(words[c["item"]]))
                        # a unit without terms may stand before the first that has some
                        begin = max(0, c["at"] - size) // len(item) * len(item)
                        share, answer = best_window(item, text[begin : c["at"] + 2 * size])
                        if share >= LCS_SHARE and answer >= ANSWER_SHARE:
                            out.append((doc, c["item"], c["cosine"], share, answer))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "item", "cosine", "lcs_share", "answer_share"])

    return work


_NEAR = "doc_id long, item long, at long, cosine double"
_FOUND = "doc_id long, item long, cosine double, lcs_share double, answer_share double"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, cosine, lcs_share, answer_share (of the best
    passage; ties by the higher answer_share, then cosine).

    Words are runs of anything but ASCII white space, A-Z lower-cased; texts are read whole, whatever their length. Items
    without words match nothing, nor do null and empty texts; items of equal text are searched once and reported each, null
    ids too; repeated rows and texts give one row per doc_id and item. Documents without a doc_id are left out. Other columns
    are ignored; an empty side gives an empty result. The items (not the documents) are broadcast: more than MOST_BYTES of
    distinct text or MOST_TERMS terms are an error before any is read to the driver.
    """
    spark = docs.sparkSession
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = written(benchmark.filter(F.col("text").rlike(WORD)).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct())
    texts = written(items.select("text").distinct())
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of distinct text; at most {MOST_BYTES} can be broadcast")
    rows = sorted(r["text"] for r in texts.collect())
    words = []
    for _, raw, at in tx.slices(pa.array(rows, pa.string())):
        hashes, _, word_at = tx.words(raw, at)
        words += [hashes[a:b] for a, b in zip(word_at[:-1], word_at[1:], strict=True)]
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]))
    if not len(vocabulary):
        return spark.createDataFrame([], "doc_id long, item_id long, cosine double, lcs_share double, answer_share double")
    if len(vocabulary) > MOST_TERMS:
        raise ValueError(f"the benchmark has {len(vocabulary)} terms; at most {MOST_TERMS} can be broadcast")

    counted = docs.select("text").mapInArrow(tx.freed(_counts(vocabulary)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = dict(zip(counted["term"].to_pylist(), counted["n"].to_pylist(), strict=True))
    n_docs = max(1, df.pop(-1, 0))
    frequency = np.zeros(len(vocabulary))
    frequency[list(df)] = list(df.values())
    kept = frequency <= max(MOST_SHARE * n_docs, FEW_DOCS)
    for w in words:
        own = np.searchsorted(vocabulary, np.unique(w))
        kept[own[np.argsort(frequency[own], kind="stable")[:LEAST_TERMS]]] = True
    known = Items(words, vocabulary[kept], np.log((n_docs + 1) / (frequency[kept] + 1)) + 0.1)

    term_rows = written(docs.mapInArrow(tx.freed(_term_rows(known.terms)), "doc_id long, terms array<int>, places array<int>"))
    basis, _ = latent_basis(term_rows, known.idf)
    near = term_rows.mapInArrow(tx.freed(_candidates(known, (basis * known.idf[:, None]).astype(np.float32))), _NEAR)
    near = near.groupBy("doc_id", "item", "at").agg(F.max("cosine").alias("cosine"))
    near = written(near.groupBy("doc_id").agg(F.collect_list(F.struct("item", "at", "cosine")).alias("found")))  # no more than a text's passages
    found = docs.join(small_side(near, BROADCAST_FOUND), "doc_id").mapInArrow(tx.freed(_verified(known.words)), _FOUND)
    best = F.max(F.struct("lcs_share", "answer_share", "cosine")).alias("best")
    found = found.groupBy("doc_id", "item").agg(best)
    numbers = spark.createDataFrame(list(enumerate(rows)), "item long, text string")
    named = F.broadcast(items.join(numbers, "text").select("item", "item_id"))  # two numbers an item, texts of MOST_BYTES at most
    return found.join(named, "item").select("doc_id", "item_id", "best.cosine", "best.lcs_share", "best.answer_share")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item."""
    dropped = written(leaks(docs, benchmark).select("doc_id").distinct())
    return docs.join(small_side(dropped, BROADCAST_IDS), "doc_id", "left_anti").select(*docs.columns)
