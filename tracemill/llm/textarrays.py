"""Words and lines of a batch of texts as numpy arrays over the UTF-8 bytes, without a Python object per word."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once, and bytes whose letters are hashed at once, also within one long text.
CHUNK_BYTES = 1 << 20
PIECE_BYTES = 256 << 10

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mix64(np.arange(1, 257, dtype=np.uint64))
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B]  # A-Z count as a-z
_LETTER_EXACT = mix64(np.arange(1, 257, dtype=np.uint64))
_LETTER[_SEP] = 0
_LETTER_EXACT[_SEP] = 0


def _powers(step: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, step)])


_LOW = _powers(_BASE, 1024)
_HIGH_STEP = (_LOW[-1:] * _BASE)[0]


class Words(NamedTuple):
    start: np.ndarray  # byte position
    hash: np.ndarray
    doc: np.ndarray
    count: np.ndarray  # words per text


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about CHUNK_BYTES of text each; a longer text is a slice of its own."""
    _, offsets = text_bytes(batch.column(text))
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def slices(batch: pa.RecordBatch, columns: tuple[int, ...], limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes in the given binary columns together; a larger row is a slice of its own."""
    sizes = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0), np.int64) for c in columns)
    ends = np.r_[0, np.cumsum(sizes)]
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def trim() -> None:
    """Give memory that a task has freed back to the system: Spark keeps its Python processes for tasks of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def words(data: np.ndarray, offsets: np.ndarray, fold_case: bool = True) -> Words:
    """All words (runs without ASCII white space) with a 64-bit hash of their bytes, A-Z folded if asked."""
    n_docs = len(offsets) - 1
    if not data.size:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n_docs, np.int64))
    sep = _SEP[data]
    begins = ~sep
    begins[1:] &= sep[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = ~sep[edges]
    start = np.flatnonzero(begins)
    doc = np.searchsorted(offsets, start, "right") - 1
    if not start.size:
        return Words(start, np.zeros(0, np.uint64), doc, np.zeros(n_docs, np.int64))
    return Words(start, _hashes(data, start, _LETTER if fold_case else _LETTER_EXACT), doc, np.bincount(doc, minlength=n_docs))


def _hashes(data: np.ndarray, start: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """The hash of every word, piece by piece: a piece ends before a word, so only a word may be longer than PIECE_BYTES."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        end = max(at + 1, int(np.searchsorted(start, start[at] + PIECE_BYTES)))
        stop = int(start[end]) if end < len(start) else data.size
        own = start[at:end] - start[at]
        span = data[start[at] : stop]
        pos = np.arange(len(span)) - np.repeat(own, np.diff(np.r_[own, len(span)]))
        longest = int(pos.max())
        power = _LOW[pos & 1023]
        if longest > 1023:
            power = power * _powers(_HIGH_STEP, (longest >> 10) + 1)[pos >> 10]
        out[at:end] = mix64(np.add.reduceat(letter[span] * power, own))
        at = end
    return out
