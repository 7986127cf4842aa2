"""Vectorised text helpers for Arrow batches.

A batch's texts are looked at as one byte buffer with document borders, so
that splitting into words and hashing them are a few numpy passes over the
buffer instead of a Python loop over words.  Pieces of at most ``PIECE_BYTES``
(or one longer document) are handled at a time, which bounds memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE_BYTES = 1 << 20
_POWERS = 4096                       # byte positions in a word that have a multiplier of their own

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in UTF-8 (every non-ASCII byte belongs to a word)
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def free_name(columns, name: str) -> str:
    """``name``, or with underscores after it until no column (whatever its case) is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim                # glibc's; other C libraries have none
    except (AttributeError, OSError, TypeError):
        return None


def give_back() -> None:
    """Hand freed memory of this worker back to the system."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` over batches; what it freed goes back to the system after it, as the worker stays up beside later stages."""
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return tidied


def tidy_group(run: Callable) -> Callable:
    """``tidy`` for a function of a key and the key's rows."""
    def tidied(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        try:
            return run(key, rows)
        finally:
            give_back()
    return tidied


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _multipliers(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_POW = _multipliers(_POWERS, 1)
_ORDER = _multipliers(64, 2)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents holding about ``size`` bytes each (at least one document)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``member`` bytes that lie in one document.

    Returns (starts, ends, first): byte positions, and for each document the
    number of its first run (``first[-1]``: how many there are).
    """
    inside = member[data]
    borders = offsets[:-1][offsets[:-1] < len(data)]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[borders] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    after[borders[borders > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes (a function of its bytes alone)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = (ends - starts).astype(np.int64)
    first = np.cumsum(lengths) - lengths                  # where a run starts among run bytes
    within = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    values = data[within + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    values *= _POW[within & (_POWERS - 1)]
    out = mix64(np.add.reduceat(values, first))
    for k in np.flatnonzero(lengths > _POWERS):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k]:ends[k]].tobytes())
    return out


def hashes_of(words: list[bytes]) -> np.ndarray:
    """``word_hashes`` of given words (none of them empty)."""
    ends = np.cumsum([len(w) for w in words])
    return word_hashes(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each ``width``-word window.

    A document with fewer words (one at least) has its whole sequence as one
    shingle; a document without words has none.
    """
    words = np.diff(first)
    n = len(hashes)
    out = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        out += hashes[j:j + len(out)] * _ORDER[j]
    doc = np.repeat(np.arange(len(words)), words)
    whole = np.zeros(n, bool)
    if len(out):
        whole[:len(out)] = doc[:len(out)] == doc[width - 1:]
    at = np.flatnonzero(whole)
    tokens, owner = mix64(out[at] + np.uint64(width)), doc[at]
    short = np.flatnonzero((words > 0) & (words < width))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for k, d in enumerate(short):
            h = hashes[first[d]:first[d + 1]]
            extra[k] = np.add.reduce(h * _ORDER[:len(h)]) + np.uint64(len(h))
        tokens = np.concatenate([tokens, mix64(extra)])
        owner = np.concatenate([owner, short])
    return tokens, owner


def doc_batches(batches, text: str = "text", size: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches whose texts hold about ``size`` bytes, with their bytes and offsets."""
    for batch in batches:
        data, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
        for i, j in pieces(offsets, size):
            lo, hi = offsets[i], offsets[j]
            yield batch.slice(i, j - i), data[lo:hi], offsets[i:j + 1] - lo
