"""Near-duplicate embeddings by product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank.

Coarse centroids and residual codebooks are fitted on a bounded sample, for each length of vectors by itself; every vector
is indexed. A query reads the lists whose centroids lie nearest. Each code keeps its own quantisation error, so the
table-lookup distance rules out only vectors that the triangle inequality rules out; the rest are reranked by exact cosine
in double precision. A pair that either end finds counts for both.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

THRESHOLD = 0.93
#: Bounds of the fit: vectors in the sample, lists, and list members aimed at (over all labels); a length's share of the
#: sample is that of its rows, but this many at least.
SAMPLE, MOST_LISTS, LIST_ROWS, LEAST_SAMPLE = 16_384, 4096, 1024, 256
PROBES, SUBSPACES, CODES, ROUNDS = 12, 8, 256, 8
#: Members and queries of a list meet in blocks of at most about this many rows; distances to centroids are taken for so many at a time.
BLOCK = 1024


@dataclass
class Codebook:
    coarse: np.ndarray  # lists x dimension
    codes: np.ndarray  # subspaces x codes x dimension / subspaces
    probes: int

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        if len(x) > BLOCK:
            return np.concatenate([self.nearest(x[i : i + BLOCK], n) for i in range(0, len(x), BLOCK)])
        d = (self.coarse**2).sum(1) - 2 * x @ self.coarse.T
        n = min(n, len(self.coarse))
        part = np.argpartition(d, n - 1, axis=1)[:, :n]
        return np.take_along_axis(part, np.take_along_axis(d, part, 1).argsort(1), 1)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, quantisation error) of each residual."""
        parts = residual.reshape(len(residual), len(self.codes), -1)
        out = np.empty(parts.shape[:2], np.uint8)
        for s, book in enumerate(self.codes):
            out[:, s] = ((book**2).sum(1) - 2 * parts[:, s] @ book.T).argmin(1)
        back = self.codes[np.arange(len(self.codes)), out]
        return out, np.sqrt(((parts - back) ** 2).sum((1, 2)))

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Squared distances from each residual's parts to the codes."""
        parts = residual.reshape(len(residual), len(self.codes), -1)
        return np.stack([((parts[:, s, None] - book) ** 2).sum(2) for s, book in enumerate(self.codes)], 1)


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        length = (centres**2).sum(1)
        near = np.concatenate([(length - 2 * x[i : i + BLOCK] @ centres.T).argmin(1) for i in range(0, len(x), BLOCK)])
        order = np.argsort(near, kind="stable")
        used, start = np.unique(near[order], return_index=True)
        centres[used] = np.add.reduceat(x[order], start) / np.diff(np.append(start, len(x)))[:, None]
    return centres


def fit(sample: np.ndarray, n_lists: int) -> Codebook:
    """sample: unit vectors of one length, about SAMPLE at most."""
    coarse = _kmeans(sample, n_lists, 1)
    book = Codebook(coarse, np.zeros((0, 0, 0)), PROBES)
    residual = sample - coarse[book.nearest(sample, 1)[:, 0]]
    subspaces = math.gcd(SUBSPACES, sample.shape[1])
    parts = residual.reshape(len(sample), subspaces, -1)
    books = [_kmeans(parts[:, s], CODES, 2 + s) for s in range(subspaces)]
    return Codebook(coarse, np.stack(books), PROBES)


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether usable, all parts, offsets of the rows in them) of a list column; usable: not empty, no null, finite, not all zero."""
    size = column.value_lengths().fill_null(0).to_numpy()
    at = np.concatenate([[0], np.cumsum(size)])
    parts = column.flatten().cast(pa.float64())
    bad = parts.is_null().to_numpy(zero_copy_only=False)
    parts = parts.fill_null(0.0).to_numpy() + 0.0
    bad |= ~np.isfinite(parts)
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    return (size > 0) & (sums(bad) == 0) & (sums(parts != 0) > 0), parts, at


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok, parts, at = _vectors(batch.column(2))
        ok &= batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        raw = [parts[a:b].tobytes() if k else None for a, b, k in zip(at[:-1], at[1:], ok, strict=True)]
        digest = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in raw]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "label", "digest", "raw"])


def _matrix(raw: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), float).reshape(len(raw), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _of_one_width(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        widths = np.asarray(batch.column(4))
        for width in np.unique(widths).tolist():
            yield width, batch.filter(pa.array(widths == width))


def _index(books: dict[int, Codebook]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, batch in _of_one_width(batches):
            book, x = books[width], _unit(_matrix(batch.column(3)))
            probes = book.nearest(x, book.probes)
            codes, error = book.encode(x - book.coarse[probes[:, 0]])
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:5],
                pa.array(probes[:, 0], pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * probes.shape[1], pa.int32()), pa.array(probes.ravel(), pa.int32())),
                pa.array([c.tobytes() for c in codes], pa.binary()),
                pa.array(error, pa.float64()),
            ], names=["id", "label", "n", "raw", "width", "list", "probes", "codes", "error"])

    return work


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a bipartite block: as many (row, column) links as keep its components."""
    rows, columns = linked.shape
    free_row, free_column, out = linked.any(1), np.ones(columns, bool), []
    while free_row.any():
        todo = [int(free_row.argmax())]
        free_row[todo[0]] = False
        while todo:
            r = todo.pop()
            for c in np.flatnonzero(linked[r] & free_column):
                free_column[c] = False
                out.append((r, int(c)))
                more = np.flatnonzero(linked[:, c] & free_row)
                free_row[more] = False
                out += [(int(m), int(c)) for m in more]
                todo += more.tolist()
    return out


def _search(books: dict[int, Codebook], threshold: float):
    reach = math.sqrt(2 - 2 * threshold)

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        book = books[table["width"][0].as_py()]
        asks = np.asarray(table["is_query"].to_pylist(), bool)
        members, queries = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
        out_a, out_b, out_n = [], [], []
        if len(members) and len(queries):
            m_id, q_id = np.asarray(members["id"]), np.asarray(queries["id"])
            x, q = _unit(_matrix(members["raw"])), _unit(_matrix(queries["raw"]))
            codes = np.frombuffer(b"".join(members["codes"].to_pylist()), np.uint8).reshape(len(x), -1)
            tables = book.tables(q - book.coarse[table["list"][0].as_py()])
            seen = np.zeros((len(q), len(x)))
            for s in range(codes.shape[1]):
                seen += tables[:, s][:, codes[:, s]]
            near = np.sqrt(seen) <= reach + np.asarray(members["error"]) + 1e-9
            near &= q_id[:, None] != m_id[None, :]
            linked = np.zeros(near.shape, bool)
            r, c = np.nonzero(near)
            for at in range(0, len(r), 65536):
                i, j = r[at : at + 65536], c[at : at + 65536]
                linked[i, j] = np.einsum("ij,ij->i", q[i], x[j]) >= threshold
            # a member counts the query too, unless the member's own probes lead it to the query's list
            probes = members["probes"].combine_chunks().flatten().to_numpy().reshape(len(x), -1)
            unseen = linked & ~(probes[None, :, :] == np.asarray(queries["own"])[:, None, None]).any(2)
            for ids, total in ((q_id, linked @ np.asarray(members["n"], float)), (m_id, np.asarray(queries["n"], float) @ unseen)):
                hit = total > 0
                out_a += ids[hit].tolist()
                out_b += [None] * int(hit.sum())
                out_n += total[hit].astype(int).tolist()
            pairs = _forest(linked)
            out_a += [int(q_id[i]) for i, _ in pairs]
            out_b += [int(m_id[j]) for _, j in pairs]
            out_n += [None] * len(pairs)
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64()), "n": pa.array(out_n, pa.int64())})

    return work


def embedding_duplicate_classes(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null label and equal length link when their cosine is at least threshold. Vectors that are null,
    empty, zero or hold null or non-finite parts link with nothing, nor do those without label or id. Equal vectors of a
    label are compared once and counted as often as they occur, repeated rows too. vec_id is the key: rows that share one
    are linked through it only if their vectors are. Vectors of any length are compared whole; other columns are ignored.
    An empty table gives an empty result.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding"))
    kind = dict(vectors.dtypes)["label"]
    read = written(vectors.mapInArrow(_digests, f"vec_id long, label {kind}, digest binary, raw binary"))
    usable = read.filter("digest is not null")
    classes = usable.groupBy("label", "digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("raw").alias("raw"))
    classes = written(classes.withColumn("width", F.octet_length("raw")))
    counts = {r["width"]: r["count"] for r in classes.groupBy("width").count().collect()}
    if not counts:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    total, books = sum(counts.values()), {}
    shares = [(w, int(min(1.0, max(LEAST_SAMPLE, SAMPLE * c / total) / c) * (1 << 30))) for w, c in counts.items()]
    of_width = F.broadcast(vectors.sparkSession.createDataFrame(shares, "width int, share long"))
    sample = classes.join(of_width, "width").filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= F.col("share")).select("width", "raw", "id").orderBy("id")
    rows = {w: [] for w in counts}
    for r in sample.collect():
        rows[r["width"]].append(np.frombuffer(r["raw"], float))
    for w, c in counts.items():
        n_lists = min(MOST_LISTS, 2 ** max(4, round(math.log2(c / LIST_ROWS + 1))))
        books[w] = fit(_unit(np.stack(rows.pop(w))), n_lists)

    index = written(classes.select("id", "label", "n", "raw", "width").mapInArrow(_index(books), f"id long, label {kind}, n long, raw binary, width int, list int, probes array<int>, codes binary, error double"))
    queries = index.select("id", "label", "width", "raw", F.explode("probes").alias("list"), "n", F.col("list").alias("own"))
    sizes = index.groupBy("label", "width", "list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    sizes = written(sizes.join(queries.groupBy("label", "width", "list").agg(F.ceil(F.count("*") / BLOCK).alias("ask_blocks")), ["label", "width", "list"]))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    no_codes, no_error = F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error")
    stored = index.join(sizes, ["label", "width", "list"]).select("id", "label", "width", "list", "n", "raw", "probes", F.lit(None).cast("int").alias("own"), "codes", "error", F.lit(False).alias("is_query"), block("blocks").alias("at"), spread("ask_blocks").alias("ask"))
    asked = queries.join(sizes, ["label", "width", "list"]).select("id", "label", "width", "list", "n", "raw", F.lit(None).cast("array<int>").alias("probes"), "own", no_codes, no_error, F.lit(True).alias("is_query"), spread("blocks").alias("at"), block("ask_blocks").alias("ask"))
    found = written(stored.unionByName(asked).groupBy("label", "width", "list", "at", "ask").applyInArrow(_search(books, threshold), "a long, b long, n long"))

    links = found.filter("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("linked"))
    joined = components(found.filter("b is not null").select("a", "b"))
    facts = classes.select("label", "digest", "id", "n").join(links, "id", "left").join(joined, "id", "left")
    facts = facts.select("label", "digest", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    of_usable = usable.select("vec_id", "label", "digest").join(facts, ["label", "digest"]).select("vec_id", "n_links", "component_id")
    other = read.filter("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return of_usable.unionByName(other).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
