"""Vectorised byte-level helpers that run inside Arrow batches: words, hashes and slices of whole texts."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about this many bytes; a single longer text is a slice of its own.
SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def give_back() -> None:
    """Returns to the system what Arrow's and the C library's allocators hold unused; a reused Python worker would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


def freed(work):
    """work, for mapInArrow, after which a reused Python worker gives memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random64(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    _, ends, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(raw: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, offsets of each text's words) for the runs of anything but ASCII white space."""
    n_texts = len(at) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n_texts + 1, np.int64)
    text = _LOWER[raw] if lower else raw
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    own = at[:-1][np.diff(at) > 0]
    begins[own] = inside[own]
    first = np.flatnonzero(begins)
    if not len(first):
        return np.zeros(0, np.uint64), first, np.zeros(n_texts + 1, np.int64)
    length = np.diff(np.append(first, len(raw)))
    place = np.arange(first[0], len(raw), dtype=np.int64) - np.repeat(first, length)
    values = random64(int(length.max()), 7)[place]
    values *= text[first[0] :].astype(np.uint64) + np.uint64(1)
    values *= inside[first[0] :]
    return mix64(np.add.reduceat(values, first - first[0])), first, np.searchsorted(first, at)


def shingles(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, offsets of each text's) k-word shingles; a text of fewer words has its whole sequence as one."""
    keys, count = random64(k, 11), np.diff(at)
    n = len(hashes) - k + 1
    full = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        full += hashes[j : j + n] * keys[j]
    short = np.flatnonzero((count > 0) & (count < k))
    number = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    ends = np.concatenate([[0], np.cumsum(number)])
    out = np.empty(ends[-1], np.uint64)
    owner = np.repeat(np.arange(len(count)), number)
    start = at[:-1][owner] + (np.arange(len(out)) - ends[:-1][owner])
    long = count[owner] >= k
    out[long] = full[start[long]]
    for t in short:
        part = hashes[at[t] : at[t + 1]]
        out[ends[t]] = (part * keys[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
    return mix64(out), ends
